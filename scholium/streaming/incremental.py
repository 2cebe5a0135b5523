"""Incremental ingestion as a stream: new files in batches, each upserted once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, source: str, schema: StructType | str, checkpoint: str, handle: Callable[[DataFrame, int], None], files_per_batch: int = 100) -> StreamingQuery:
    """Hands every new Parquet file under source to handle(batch, number), then ends; started again it goes on after them."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watermarked_counts(events: DataFrame, at: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per key and window; events later than the bound are left out, so state stays bounded."""
    from pyspark.sql import functions as F

    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
