"""Versioned index tables with a live pointer: build aside, switch at once, never delete what is live.

The pointer is a small file beside the tables, replaced whole, so it survives the process that wrote it.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.functions.analysis import stems
from scholium.functions.text import word_runs
from scholium.operators.state import delete_by_paper

# fixed values: the fields of an index document; others are refused
FIELDS = """chunk_id string, content_hash string, text string, chunk_index int, section string, subsection string, section_kind string, token_count int, char_count long, arxiv_id string,
 version int, title string, authors array<string>, abstract string, published_at timestamp, updated_at timestamp, primary_category string, categories array<string>, abs_url string,
 pdf_url string, embedding array<double>, embedding_model string, indexed_at timestamp"""


def conform(docs: DataFrame, dimensions: int | None = None) -> DataFrame:
    """docs in the index's fields, missing ones null, with the words of the analysed fields; unknown fields raise.

    Embeddings of another length than dimensions make a row refused (column refused says why).
    """
    known = [f.strip().split(" ", 1) for f in FIELDS.replace("\n", "").split(",")]
    if extra := sorted(set(docs.columns) - {n for n, _ in known}):
        raise ValueError(f"the index has no field {extra}")
    cols = [(F.col(n) if n in docs.columns else F.lit(None)).cast(t).alias(n) for n, t in known]
    size = F.col("embedding").isNotNull() & (F.size("embedding") != dimensions) if dimensions else F.lit(False)
    why = F.when(F.col("chunk_id").isNull(), F.lit("no chunk_id")).when(size, F.lit("embedding length"))
    return docs.select(*cols).withColumn("refused", why).withColumns({"text_exact": word_runs(F.col("text")), "text_stems": stems(F.col("text")), "title_stems": stems(F.col("title"))})


class IndexStore:
    """Index versions as Parquet folders under one root; a temporary view names the live one."""

    def __init__(self, spark: SparkSession, root: str, prefix: str = "chunks"):
        self.spark, self.root, self.prefix = spark, root.rstrip("/"), prefix

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    @property
    def live(self) -> str | None:
        files, pointer = self._path(f"{self.prefix}.live")
        if not files.exists(pointer):
            return None
        return self.spark.read.text(f"{self.root}/{self.prefix}.live").first()[0]

    def new_name(self, now: datetime | None = None) -> str:
        return f"{self.prefix}-v1-{(now or datetime.now(UTC)).strftime('%Y%m%d%H%M%S')}-{uuid.uuid4().hex[:6]}"

    def build(self, docs: DataFrame, name: str | None = None) -> tuple[str, DataFrame]:
        """(name, refused rows): one row per chunk_id is written, rows without one or marked refused are given back."""
        name = name or self.new_name()
        bad = F.col("chunk_id").isNull() | (F.col("refused").isNotNull() if "refused" in docs.columns else F.lit(False))
        newest = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc_nulls_last("indexed_at")))
        docs.where(~bad).withColumn("r", newest).where("r = 1").drop("r", "refused").write.parquet(f"{self.root}/{name}")
        return name, docs.where(bad)

    def ensure_ready(self, empty: DataFrame) -> str:
        """The live index's name; where there is none, an empty one is built and switched to."""
        if not (live := self.live):
            live, _ = self.build(empty.limit(0))
            self.switch(live)
        return live

    def switch(self, name: str) -> None:
        self.read(name).createOrReplaceTempView(f"{self.prefix}_current")
        files, pointer = self._path(f"{self.prefix}.live")
        out = files.create(pointer, True)
        out.write(bytearray(name.encode()))
        out.close()

    def read(self, name: str | None = None) -> DataFrame:
        if (name := name or self.live) is None:
            raise LookupError("no index is live")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def count(self, name: str | None = None) -> int:
        return self.read(name).count()

    def delete_paper(self, paper: str, version: int | None = None) -> str:
        """A new live version without a paper, or one version of it; the old one stays until it is deleted."""
        rest = delete_by_paper(self.read(), F.lit(paper), None if version is None else F.lit(version))
        name, _ = self.build(rest)
        self.switch(name)
        return name

    def delete(self, name: str) -> bool:
        if name == self.live:
            raise ValueError("the live index is not deleted")
        files, path = self._path(name)
        return files.delete(path, True)
