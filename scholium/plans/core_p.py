"""The p5_ queries: history of paper attributes, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.operators.history import as_of, build_store, reconstruct, squeeze
from scholium.session import table

STATE = ("version", "title")


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checkpoints and deltas of all papers, stored as a table and read back."""
    return build_store(table(spark, sf_dir, "arxiv_papers"), "arxiv_id", "updated_at", STATE, rank=("harvested_at",), required=("title",), compare={"title": squeeze("title")})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reconstruct(_store(spark, sf_dir), "arxiv_id", STATE)
    return rows.select("arxiv_id", F.col("version").cast("int").alias("version"), F.unix_seconds(F.col("valid_from").cast("timestamp")).alias("valid_from"))


def p5_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reconstruct(_store(spark, sf_dir), "arxiv_id", STATE)
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp")).alias(c)
    return rows.select("arxiv_id", "seq", F.col("version").cast("int").alias("version"), F.sha2(squeeze("title"), 256).alias("title_key"), seconds("valid_from"), seconds("valid_to"))


def p5_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every paper at the start of 2024."""
    rows = as_of(_store(spark, sf_dir), "arxiv_id", STATE, F.lit("2024-01-01 00:00:00+00:00").cast("timestamp"))
    return rows.select("arxiv_id", "seq", F.col("version").cast("int").alias("version"), F.sha2(squeeze("title"), 256).alias("title_key"))


_CHANGES = r"""
WITH d AS (
  SELECT arxiv_id, version, regexp_replace(title, '[\s\p{Z}]+', '', 'g') AS t, updated_at
  FROM arxiv_papers WHERE title IS NOT NULL AND updated_at IS NOT NULL AND arxiv_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY arxiv_id, updated_at ORDER BY harvested_at DESC NULLS LAST, version DESC NULLS LAST, title DESC) = 1),
c AS (SELECT *, lag(version) OVER w AS pv, lag(t) OVER w AS pt FROM d WINDOW w AS (PARTITION BY arxiv_id ORDER BY updated_at)),
h AS (SELECT * FROM c WHERE pt IS NULL OR pt <> t OR pv IS DISTINCT FROM version)
"""

QUERIES = {"p5_found": p5_found, "p5_history": p5_history, "p5_as_of": p5_as_of}

SQL = {
    "p5_found": _CHANGES + "SELECT arxiv_id, CAST(version AS INTEGER) AS version, CAST(floor(epoch(updated_at)) AS BIGINT) AS valid_from FROM h",
    "p5_history": _CHANGES
    + """SELECT arxiv_id, CAST(row_number() OVER w - 1 AS BIGINT) AS seq, CAST(version AS INTEGER) AS version, sha256(t) AS title_key,
       CAST(floor(epoch(updated_at)) AS BIGINT) AS valid_from, CAST(floor(epoch(lead(updated_at) OVER w)) AS BIGINT) AS valid_to
       FROM h WINDOW w AS (PARTITION BY arxiv_id ORDER BY updated_at)""",
    "p5_as_of": _CHANGES
    + """SELECT arxiv_id, CAST(row_number() OVER w - 1 AS BIGINT) AS seq, CAST(version AS INTEGER) AS version, sha256(t) AS title_key FROM h
       WINDOW w AS (PARTITION BY arxiv_id ORDER BY updated_at) QUALIFY updated_at <= TIMESTAMPTZ '2024-01-01 00:00:00+00' AND coalesce(lead(updated_at) OVER w > TIMESTAMPTZ '2024-01-01 00:00:00+00', true)""",
}
