"""From questions to cited context: search, re-rank or cut, pack and render, in one plan for all questions."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.functions.models import Reranker, score_pairs
from scholium.operators import context
from scholium.operators.retrieval import Search, rerank, search


def gather(chunks: DataFrame, questions: DataFrame, how: Search = Search(), reranker: Reranker | None = None, budget: int = 3000) -> tuple[DataFrame, DataFrame]:
    """(packed passages, contexts) of all questions.

    chunks: chunk_id, arxiv_id, version, title, authors, published_at, section, subsection, text and vector, one row a
    chunk_id. questions: query_id, query, vector. A pool of candidates is retrieved; the reranker, if there is one, orders
    it by the pairs' scores, and the how.k best are packed. contexts: query_id, question, context, supplied labels and
    whether anything was left out; a question without passages has a null context.
    """
    pool = search(chunks, questions, dataclasses.replace(how, k=how.pool))
    if reranker is None:
        ranked = pool.where(F.col("rank") <= how.k)
    else:
        pairs = pool.join(chunks.select("chunk_id", "text"), "chunk_id").join(questions.select("query_id", "query"), "query_id")
        scored = score_pairs(pairs.select("query_id", "chunk_id", "rank", "query", "text"), "query", "text", reranker)
        ranked = rerank(scored, "rerank_score", how.k).select("query_id", "chunk_id", F.col("new_rank").alias("rank"))
    offered = context.costed(chunks).select("chunk_id", "arxiv_id", "version", "place", "cost").join(ranked.select("query_id", "chunk_id", "rank"), "chunk_id")
    packed = context.pack(offered, budget)
    labels = packed.groupBy("query_id").agg(F.array_sort(F.collect_set(F.regexp_extract("label", r"\d+", 0).cast("int"))).alias("n"))  # labels within the budget
    labels = labels.select("query_id", F.transform("n", lambda n: F.concat(F.lit("P"), n.cast("string"))).alias("supplied"))
    told = questions.select("query_id", F.col("query").alias("question")).join(context.render(packed, chunks), "query_id", "left").join(labels, "query_id", "left")
    left_out = context.totals(offered, packed).select("query_id", "truncated")
    return packed, told.join(left_out, "query_id", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
