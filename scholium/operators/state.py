"""State of incremental runs as DataFrames: versioned upserts, checkpoints, retries and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.functions.text import author_key, backoff, content_hash


def upsert(stored: DataFrame, fetched: DataFrame, key: str, version: str, arrival: str) -> DataFrame:
    """The stored rows after an upsert: columns of fetched plus outcome (null for rows that were there) and is_latest.

    A version that is stored is SKIPPED; a new key is CREATED; any other new version is UPDATED, also an
    older one that arrives late. Repeated fetched rows count once, the first arrival.
    """
    one = fetched.where(F.col(key).isNotNull()).withColumn("r", F.row_number().over(Window.partitionBy(key, version).orderBy(arrival))).where("r = 1").drop("r")
    fresh = one.join(stored.select(key, version), [key, version], "left_anti")
    known = stored.select(key).distinct().withColumn("known", F.lit(True))
    marked = fresh.join(known, key, "left").withColumn("outcome", F.when(F.col("known"), "UPDATED").when(F.row_number().over(Window.partitionBy(key).orderBy(arrival, version)) == 1, "CREATED").otherwise("UPDATED")).drop("known")
    both = stored.withColumn("outcome", F.lit(None).cast("string")).unionByName(marked, allowMissingColumns=True)
    return mark_latest(both, key, version)


def mark_latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """is_latest for the greatest version of each key; the maximum is aggregated, so a hot key is not sorted in one task."""
    most = df.groupBy(key).agg(F.max(version).alias("most"))
    return df.join(most, key).withColumn("is_latest", F.col(version) == F.col("most")).drop("most")


def get_or_create_authors(papers: DataFrame, key: str, authors: str, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new authors, positions). New authors: normalized_name, full_name of the first spelling met. Positions follow de-duplication."""
    rows = papers.select(key, F.posexplode(authors).alias("pos", "full_name")).withColumn("normalized_name", author_key(F.col("full_name"))).where(F.col("normalized_name") != "")
    first = rows.groupBy("normalized_name").agg(F.min(F.struct(key, "pos", "full_name")).alias("f")).select("normalized_name", "f.full_name")
    fresh = first.join(stored.select("normalized_name"), "normalized_name", "left_anti")
    places = rows.groupBy(key, "normalized_name").agg(F.min("pos").alias("pos"))
    return fresh, places.select(key, "normalized_name", (F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).cast("long").alias("position"))


def replace_rows(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Delete-then-insert by key: stored rows of the keys in fresh go, fresh rows come."""
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def advance(checkpoints: DataFrame, batch: DataFrame, key: str, at: str, item: str, arrival: str) -> DataFrame:
    """Checkpoints after a batch: monotone, the item travels with the greatest time; of equal times the first arrival counts."""
    newest = F.max_by(item, F.struct(F.col(at), -F.col(arrival)))
    seen = batch.where(F.col(at).isNotNull()).groupBy(key).agg(F.max(at).alias("new_at"), newest.alias("new_item"))
    both = checkpoints.select(key, F.col(at).alias("old_at"), F.col(item).alias("old_item")).join(seen, key, "full")
    ahead = F.col("new_at").isNotNull() & (F.col("old_at").isNull() | (F.col("new_at") > F.col("old_at")))
    return both.select(key, F.when(ahead, F.col("new_at")).otherwise(F.col("old_at")).alias(at), F.when(ahead, F.col("new_item")).otherwise(F.col("old_item")).alias(item))


def read_checkpoint(checkpoints: DataFrame, keys: DataFrame, key: str, at: str) -> DataFrame:
    """The mark of every asked key; null means it never ran."""
    return keys.select(key).distinct().join(checkpoints.select(key, at), key, "left")


def backfill(df: DataFrame, submitted: str, since: Column, until: Column) -> DataFrame:
    """Rows submitted in a closed window, at minute granularity; no checkpoint moves."""
    minute = lambda c: F.date_trunc("minute", c)
    return df.where((F.col(submitted) >= minute(since)) & (F.col(submitted) < minute(until) + F.expr("INTERVAL 1 MINUTE")))


def due_since(df: DataFrame, at: str, mark: Column) -> DataFrame:
    """Rows updated since a mark, inclusive at minute granularity."""
    return df.where(F.col(at) >= F.date_trunc("minute", mark))


def settled(stage: Column) -> Column:
    return stage.isin("INDEXED", "FAILED")


def needs_work(stage: Column, attempts: Column, most: Column, next_retry: Column, now: Column) -> Column:
    """Neither settled nor exhausted, and due."""
    return ~settled(stage) & (attempts < most) & (next_retry.isNull() | (next_retry <= now))


def after_failure(df: DataFrame, error: str, now: Column, base: float = 60.0, longest: float = 3600.0) -> DataFrame:
    """attempts, stage, last_error and next_retry_at after a failed attempt; the wait counts earlier attempts."""
    tries = F.col("attempts") + 1
    done = tries >= F.col("max_attempts")
    return df.select(
        *[c for c in df.columns if c not in ("attempts", "stage", "next_retry_at", error)],
        tries.alias("attempts"),
        F.when(done, F.lit("FAILED")).otherwise(F.col("stage")).alias("stage"),
        F.left(F.col(error), F.lit(2000)).alias(error),
        F.when(~done, F.timestamp_add("SECOND", backoff(F.col("attempts"), base, longest).cast("int"), now)).alias("next_retry_at"),
    )


def dead_letters(df: DataFrame, error: str, stored: str | None = None) -> DataFrame:
    """Rows whose attempts are used up, with the message cut to 4000 characters.

    stored: a column that says whether the paper was stored; if it never was, one attempt is enough.
    """
    spent = F.col("attempts") >= F.col("max_attempts")
    if stored:
        spent = spent | (~F.coalesce(F.col(stored), F.lit(False)) & (F.col("attempts") >= 1))
    return df.where(spent).withColumn(error, F.left(F.col(error), F.lit(4000)))


def advance_stage(status: DataFrame, reached: DataFrame, key: str) -> DataFrame:
    """Status rows after stages were reached (key, new_stage): new keys begin with no attempts; INDEXED clears errors and retries.

    status: key, stage, attempts, max_attempts, next_retry_at, last_error. A key reached twice takes the greatest stage name given.
    """
    step = reached.groupBy(key).agg(F.max("new_stage").alias("new_stage"))
    both = status.join(step, key, "full")
    done = F.coalesce(F.col("new_stage") == "INDEXED", F.lit(False))
    return both.select(
        key, F.coalesce("new_stage", "stage").alias("stage"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("max_attempts", F.lit(3)).alias("max_attempts"),
        F.when(~done, F.col("next_retry_at")).alias("next_retry_at"), F.when(~done, F.col("last_error")).alias("last_error"),
    )


def start_run(spark: SparkSession, run_id: str, run_type: str, now: Column, config: str = "{}") -> DataFrame:
    """One RUNNING row of a run, its counters 0."""
    counters = [F.lit(0).cast("long").alias(c) for c in ("fetched", "accepted", "updated", "skipped", "failed", "chunks_indexed")]
    return spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(run_type).alias("run_type"), F.lit("RUNNING").alias("status"), now.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), *counters, F.lit(config).alias("config_snapshot"))


def finish_run(runs: DataFrame, run_id: str, counters: dict[str, int], now: Column, error: str | None = None) -> DataFrame:
    """runs with one run closed: never before it began, its status from the error and the failures."""
    mine = F.col("run_id") == run_id
    status = run_status(F.lit(error).cast("string"), F.lit(counters.get("failed", 0)))
    put = {c: F.when(mine, F.lit(n).cast("long")).otherwise(F.col(c)) for c, n in counters.items()}
    return runs.withColumns(put | {"status": F.when(mine, status).otherwise(F.col("status")), "finished_at": F.when(mine, F.greatest(now, F.col("started_at"))).otherwise(F.col("finished_at"))})


def pipeline_status(papers: DataFrame, chunks: DataFrame, failures: DataFrame, status: DataFrame) -> DataFrame:
    """One row of counts: papers, latest, chunks, unindexed, unresolved, indexed_documents; each table is read once."""
    count = lambda df, **of: df.agg(*[F.count_if(c).cast("long").alias(n) for n, c in of.items()])
    every = F.lit(True)
    parts = [
        count(papers, papers=every, latest=F.col("is_latest")), count(chunks, chunks=every, unindexed=F.col("indexed_at").isNull()),
        count(failures, unresolved=F.col("resolved_at").isNull()), count(status, indexed_documents=F.col("stage") == "INDEXED"),
    ]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each


def recent_runs(runs: DataFrame, most: int = 5) -> DataFrame:
    """The latest runs; the cut is the feature."""
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(most)


# ---- texts, chunks and index documents ---------------------------------------------------------
def save_texts(stored: DataFrame, fresh: DataFrame, key: str, text: str) -> DataFrame:
    """Texts replaced by key, with their number of characters (null for a null text)."""
    return replace_rows(stored, fresh.withColumn("char_count", F.length(text).cast("long")), [key])


def replace_chunks(stored: DataFrame, fresh: DataFrame, paper: list[str]) -> DataFrame:
    """All chunks of the papers in fresh replaced; they are not indexed yet."""
    return replace_rows(stored, fresh.withColumn("indexed_at", F.lit(None).cast("timestamp")), paper)


def mark_indexed(chunks: DataFrame, acknowledged: DataFrame, now: Column) -> DataFrame:
    """chunks with indexed_at = now for the chunk_ids that were acknowledged; others keep theirs."""
    ids = acknowledged.select("chunk_id").where(F.col("chunk_id").isNotNull()).distinct().withColumn("acked", F.lit(True))
    return chunks.join(ids, "chunk_id", "left").withColumn("indexed_at", F.when(F.col("acked"), now).otherwise(F.col("indexed_at"))).drop("acked")


def count_unindexed(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count_if(F.col("indexed_at").isNull()).cast("long").alias("unindexed"))


def chunk_documents(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """Index documents: chunks (arxiv_id, version, chunk_index, text, ...) with their paper's columns, chunk_id and content_hash.

    A chunk whose paper is unknown has no document. Columns of papers that chunks also has are the chunk's.
    """
    keys = ["arxiv_id", "version"]
    own = papers.select(*keys, *[c for c in papers.columns if c not in chunks.columns]).dropDuplicates(keys)
    made = chunks.join(own, keys)
    name = F.concat(F.col("arxiv_id"), F.lit("v"), F.col("version").cast("string"), F.lit(":"), F.col("chunk_index").cast("string"))
    return made.withColumns({"chunk_id": name, "content_hash": content_hash(F.col("text")), "char_count": F.length("text").cast("long")})


def delete_by_paper(index: DataFrame, paper: Column, version: Column | None = None) -> DataFrame:
    """The index without a paper, or without one version of it; rows without an id stay."""
    gone = F.col("arxiv_id") == paper
    return index.where(~F.coalesce(gone if version is None else gone & (F.col("version") == version), F.lit(False)))


def parse_failures(responses: DataFrame, item: str = "item") -> DataFrame:
    """chunk_id, reason, status, retryable from the JSON entries of a bulk response.

    An entry has one object per operation; one that is no object is itself the reason. Missing ids are <unknown>,
    missing reasons unspecified error. An entry of several operations has a row for each.
    """
    ops = F.from_json(F.col(item), "map<string, string>")
    rows = responses.select(F.col(item).alias("raw"), F.explode_outer(F.coalesce(ops, F.create_map().cast("map<string,string>"))).alias("op", "body"))
    get = lambda path: F.get_json_object("body", path)
    whole = rows.select("raw", "op", get("$._id").alias("id"), F.coalesce(get("$.error.reason"), F.when(~F.startswith(get("$.error"), F.lit("{")), get("$.error"))).alias("why"), get("$.status").try_cast("int").alias("status"))
    bare = F.col("op").isNull()
    out = whole.select(F.coalesce("id", F.lit("<unknown>")).alias("chunk_id"), F.when(bare, F.col("raw")).otherwise(F.coalesce(F.nullif("why", F.lit("")), F.lit("unspecified error"))).alias("reason"), "status")
    return out.withColumn("retryable", retryable(F.col("status")))


def run_status(error: Column, failed: Column) -> Column:
    return F.when(error.isNotNull(), "FAILED").when(failed > 0, "PARTIAL").otherwise("SUCCEEDED")


def count_outcomes(df: DataFrame, by: str) -> DataFrame:
    """Run counters in one pass: failed, accepted, updated, skipped."""
    bad = F.col("error").isNotNull()
    of = lambda x: F.count_if(~bad & (F.col("outcome") == x)).cast("long")
    return df.groupBy(by).agg(F.count_if(bad).cast("long").alias("failed"), of("CREATED").alias("accepted"), of("UPDATED").alias("updated"), F.count_if(~bad & ~F.coalesce(F.col("outcome").isin("CREATED", "UPDATED"), F.lit(False))).cast("long").alias("skipped"))


def retryable(status: Column) -> Column:
    return F.coalesce((status == 429) | (status >= 500), F.lit(True))
