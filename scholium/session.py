"""Session helpers shared by all operators: table access, parallelism and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_STORED: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "scholium") -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; only the columns a query uses are read from it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Repartition only when the scan gives fewer partitions than there are cores to feed.

    Large inputs already come in many splits and pass through untouched; a small table stored in one
    file would otherwise run its Python stage in a single task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(per_core * cores)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitioned by keys into spark.sql.shuffle.partitions parts that AQE does not merge.

    For few rows with much work a row; the windows and groupings on the same keys behind it need no other shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Only where it is unset and the session is local (tests) a temporary folder is made and removed at exit.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    given = sc._jsc.sc().getCheckpointDir()
    if named or not given.isEmpty():
        return named or given.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="scholium-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so the rows survive the loss of an executor."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, tidy: bool = False) -> DataFrame:
    """A table written to the shared folder and read again: smaller than a checkpoint for repeating values.

    The file system deletes it when the application ends; release() does so at once. tidy: the shuffle files
    of the writing are deleted when it is over, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/scholium-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if tidy:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy and before is None:
            spark.conf.unset(CLEANUP)
        elif tidy:
            spark.conf.set(CLEANUP, before)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes the tables that stored() wrote; nothing that reads them may run afterwards."""
    while _STORED:
        where = spark._jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
