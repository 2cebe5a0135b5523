"""History of changing entity attributes, stored as checkpoints and deltas.

A *store* holds one row per change of an entity's state. Every ``every``-th change of an entity is a
checkpoint with all attributes; the changes between carry a patch with the changed attributes only.
Validity rows come back by folding the patches of a block forward from its checkpoint: values from the
patches, the end of a period from the change behind it, that of a block's last from ``block_to``, where the
next checkpoint begins. So a block is rebuilt alone, the history of one huge entity spreads over many tasks,
and a question about one moment reads one block an entity. A store is a table of a few plain columns:
write_store() and read_store() keep it on disk, append() adds later records to it.

No window in here is partitioned by the entity alone over raw rows. Rows are ordered inside
(entity, calendar bucket) and stitched with one summary row per bucket, so an entity that owns a third
of the table is still cut into as many pieces as it has buckets.

Defined results: rows with a null key, a null order column or a null in a required attribute take no
part. Among rows of equal key and time the one with the greatest rank columns counts (null ranks last),
then the one with the greatest attributes. Repeated rows change nothing, an empty table gives no rows,
and columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.session import stored


def squeeze(name: str) -> Column:
    """A text without its white space, so that texts differing only in white space are equal."""
    return F.regexp_replace(F.col(name), r"[\s\p{Z}]+", "")


def build_store(
    records: DataFrame,
    key: str,
    at: str,
    attributes: Sequence[str],
    rank: Sequence[str] = (),
    required: Sequence[str] = (),
    compare: Mapping[str, Column] | None = None,
    every: int = 16,
    bucket: str = "month",
) -> DataFrame:
    """The checkpoint-delta store: key, seq, block, kind, valid_from, block_to and a patch_<a> per attribute.

    compare: per attribute the expression that decides whether two values are equal (default: itself).
    """
    # stored before its block ends are joined to it, so the changes are found once
    return _with_block_ends(stored(_changes(records, key, at, attributes, rank, required, compare, every, bucket)), key)


def _changes(records: DataFrame, key: str, at: str, attributes: Sequence[str], rank: Sequence[str], required: Sequence[str], compare: Mapping[str, Column] | None, every: int, bucket: str = "month", base: DataFrame | None = None) -> DataFrame:
    """The store's rows without block_to. base: (key, base), from which an entity's changes are numbered."""
    compare = dict(compare or {})
    rows = records.select(
        F.col(key).alias("k"),
        F.col(at).alias("t"),
        F.struct(*[F.col(c) for c in rank], *[F.col(a).alias(f"v_{a}") for a in attributes], *[compare.get(a, F.col(a)).alias(f"c_{a}") for a in attributes]).alias("s"),
        *[F.col(a).isNotNull().alias(f"has_{i}") for i, a in enumerate(required)],
    ).where(F.col("k").isNotNull() & F.col("t").isNotNull())
    for i, _ in enumerate(required):
        rows = rows.where(F.col(f"has_{i}"))
    # one row per entity and time: combined map-side before the only shuffle of the raw rows
    states = rows.groupBy("k", "t").agg(F.max("s").alias("s")).select("k", "t", F.date_trunc(bucket, "t").alias("b"), F.struct(*[F.col(f"s.v_{a}") for a in attributes]).alias("v"), F.struct(*[F.col(f"s.c_{a}") for a in attributes]).alias("c"))

    inside = Window.partitionBy("k", "b").orderBy("t")
    across = Window.partitionBy("k").orderBy("b")
    seams = states.groupBy("k", "b").agg(F.max_by("c", "t").alias("c")).select("k", "b", F.lag("c").over(across).alias("before"))
    changes = (
        states.withColumn("prev", F.lag("c").over(inside))
        .join(seams, ["k", "b"])
        .withColumn("prev", F.coalesce("prev", "before"))
        .where(F.col("prev").isNull() | ~F.col("c").eqNullSafe(F.col("prev")))
        .select("k", "b", "t", "v", "c", "prev")
    )
    counts = changes.groupBy("k", "b").agg(F.count(F.lit(1)).alias("n")).select("k", "b", F.coalesce(F.sum("n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    if base is not None:
        counts = counts.join(base.select(F.col(key).alias("k"), "base"), "k", "left").select("k", "b", (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
    numbered = (
        changes.withColumn("i", F.row_number().over(inside))
        .join(counts, ["k", "b"])
        .withColumn("seq", (F.col("offset") + F.col("i") - 1).cast("long"))
        .withColumn("full", F.col("seq") % every == 0)
    )
    patches = [F.when(F.col("full") | ~F.col(f"c.c_{a}").eqNullSafe(F.col(f"prev.c_{a}")), F.struct(F.col(f"v.v_{a}").alias("value"))).alias(f"patch_{a}") for a in attributes]
    return numbered.select(F.col("k").alias(key), "seq", F.floor(F.col("seq") / every).cast("long").alias("block"), F.when(F.col("full"), "full").otherwise("patch").alias("kind"), F.col("t").alias("valid_from"), *patches)


def _with_block_ends(rows: DataFrame, key: str) -> DataFrame:
    """block_to: where the entity's next block begins, null for its last. Joined by (entity, block), so no entity is one task."""
    starts = rows.where(F.col("kind") == "full").select(key, (F.col("block") - 1).alias("block"), F.col("valid_from").alias("block_to"))
    return rows.join(starts, [key, "block"], "left")


def write_store(store: DataFrame, path: str) -> None:
    """The store as a table; it is read through read_store()."""
    store.write.mode("overwrite").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append(
    store: DataFrame, records: DataFrame, key: str, at: str, attributes: Sequence[str], rank: Sequence[str] = (), required: Sequence[str] = (), compare: Mapping[str, Column] | None = None, every: int = 16
) -> tuple[DataFrame, DataFrame]:
    """(the store with later records, the records that come too late for it).

    A record is late if it is not after the entity's last stored change: it may alter what the store has settled, so
    it is given back and the entity is built anew from its records. Only the last state of the touched entities is
    folded, and only their last block is numbered on; other rows stay as they are. Late is decided by changes: an
    observation between the last change and a new record that repeated the state is no part of the store.
    """
    usable = records.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    for a in required:
        usable = usable.where(F.col(a).isNotNull())
    open_ = store.where(F.col("block_to").isNull())
    last = reconstruct(open_, key, attributes).where(F.col("valid_to").isNull())
    told = usable.join(last.select(key, F.col("valid_from").alias("last_from")), key, "left")
    late = told.where(F.col(at) <= F.col("last_from")).drop("last_from")
    fresh = told.where(F.col("last_from").isNull() | (F.col(at) > F.col("last_from"))).drop("last_from")
    # the last stored state goes in front of the new records, so that a record that repeats it is no change
    touched = last.join(fresh.select(key).distinct(), key, "left_semi")
    front = touched.select(key, F.col("valid_from").alias(at), *attributes)
    base = touched.select(key, F.col("seq").alias("base"))
    both = fresh.select(key, at, *dict.fromkeys([*rank, *attributes])).unionByName(front, allowMissingColumns=True)
    grown = _changes(both, key, at, attributes, rank, (), compare, every, base=base)
    rows = grown.join(base, key, "left").where(F.col("base").isNull() | (F.col("seq") > F.col("base"))).drop("base")
    return _with_block_ends(store.drop("block_to").unionByName(rows), key), late


def reconstruct(store: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Validity rows (key, seq, valid_from, valid_to, attributes): patches folded forward inside each block."""
    fold = Window.partitionBy(key, "block").orderBy("seq")
    values = [F.last(f"patch_{a}", ignorenulls=True).over(fold)["value"].alias(a) for a in attributes]
    return store.select(key, "seq", "valid_from", F.coalesce(F.lead("valid_from").over(fold), F.col("block_to")).alias("valid_to"), *values)


def as_of(store: DataFrame, key: str, attributes: Sequence[str], moment: Column) -> DataFrame:
    """The state of every entity at a moment, from the one block that holds it: two plain comparisons that reach the scan."""
    block = store.where((F.col("valid_from") <= moment) & (F.col("block_to").isNull() | (F.col("block_to") > moment)))
    rows = reconstruct(block, key, attributes)
    return rows.where(F.col("valid_to").isNull() | (F.col("valid_to") > moment))
