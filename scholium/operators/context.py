"""Cited context for answers: greedy packing under a token budget, labels, citations and answer checks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions.text import citation_labels, location, malformed_labels, token_estimate
from scholium.session import by_key

# fixed value: what a model answers when the context does not suffice
REFUSAL = "INSUFFICIENT_EVIDENCE"
NO_EVIDENCE, MODEL_DECLINED = "no_evidence", "model_declined"


def author_summary(authors: Column) -> Column:
    n = F.size(F.coalesce(authors, F.array()))
    return F.when(n == 0, F.lit("unknown")).when(n == 1, F.element_at(authors, 1)).otherwise(F.concat(F.element_at(authors, 1), F.lit(" et al.")))


def passage(label: Column, title: Column, authors: Column, published: Column, place: Column, text: Column) -> Column:
    head = F.concat(F.lit("["), label, F.lit("] "), F.coalesce(title, F.lit("")), F.lit(" ("), author_summary(authors), F.lit(", "), F.coalesce(F.left(published, F.lit(4)), F.lit("n.d.")), F.lit(")"))
    return F.concat(head, F.lit(" — "), place, F.lit("\n"), F.coalesce(text, F.lit("")))


def _drawn(label: Column) -> Column:
    return passage(label, F.col("title"), F.col("authors"), F.col("published_at"), location(F.col("section"), F.col("subsection")), F.col("text"))


def costed(chunks: DataFrame) -> DataFrame:
    """chunks with place and cost, the tokens of the rendered passage. Any label costs the same.

    Made where the texts are scanned, so that ranking and packing move ids and numbers only.
    """
    return chunks.withColumn("place", location(F.col("section"), F.col("subsection"))).withColumn("cost", token_estimate(_drawn(F.lit("P1"))))


def pack(ranked: DataFrame, budget: int = 3000) -> DataFrame:
    """Chunks kept under a token budget, in rank order: query_id, chunk_id, arxiv_id, version, place, rank, label, cost, used.

    ranked: query_id, rank, chunk_id, arxiv_id, version, place, cost. A chunk that does not fit is skipped, later
    ones may still fit. Labels number the papers that keep a passage, by first appearance; used counts up. The whole
    list streams past; a task holds the labels of one query.
    """
    names = ["query_id", "chunk_id", "arxiv_id", "version", "place", "rank", "cost"]
    rows = by_key(ranked.select(*names), "query_id").sortWithinPartitions("query_id", "rank", "chunk_id")
    kinds = dict(rows.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, used, labels = None, 0, {}
        for batch in batches:
            at, label, total = [], [], []
            for i, (q, paper, version, cost) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("query_id", "arxiv_id", "version", "cost")), strict=True)):
                if q != query:
                    query, used, labels = q, 0, {}
                if used + cost > budget:
                    continue
                used += cost
                at.append(i)
                label.append(f"P{labels.setdefault((paper, version), len(labels) + 1)}")
                total.append(used)
            own = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in names), pa.array(label, pa.string()), pa.array(total, pa.int64())], names=[*names, "label", "used"])

    return rows.mapInArrow(fold, ", ".join(f"{c} {kinds[c]}" for c in names) + ", label string, used long")


def render(packed: DataFrame, chunks: DataFrame) -> DataFrame:
    """The context of every query: its passages in pack order, a blank line between.

    chunks: one row a chunk_id with title, authors, published_at, section, subsection and text. Only packed chunks are read from it.
    """
    drawn = packed.select("query_id", "chunk_id", "rank", "label").join(chunks.select("chunk_id", "title", "authors", "published_at", "section", "subsection", "text"), "chunk_id")
    xs = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", _drawn(F.col("label")).alias("passage"))))  # within the budget
    return drawn.groupBy("query_id").agg(F.array_join(F.transform(xs, lambda x: x["passage"]), "\n\n").alias("context"))


def citations(packed: DataFrame) -> DataFrame:
    """One row per cited paper: label, its sections and chunks in pack order."""
    xs = F.array_sort(F.collect_list(F.struct("rank", "place", "chunk_id")))
    return packed.groupBy("query_id", "label", "arxiv_id", "version").agg(F.array_join(F.array_distinct(F.transform(xs, lambda x: x["place"])), "; ").alias("sections"), F.array_join(F.transform(xs, lambda x: x["chunk_id"]), ",").alias("chunk_ids"))


def totals(ranked: DataFrame, packed: DataFrame) -> DataFrame:
    """included, dropped, truncated, used and labels of every query of ranked; nothing packed counts as 0."""
    kept = packed.groupBy("query_id").agg(F.count(F.lit(1)).alias("included"), F.sum("cost").cast("long").alias("used"), F.countDistinct("label").alias("labels"))
    both = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("offered")).join(kept, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = both.select("query_id", "offered", zero("included"), zero("used"), zero("labels"))
    dropped = F.col("offered") - F.col("included")
    return rows.select("query_id", "included", dropped.alias("dropped"), (dropped > 0).alias("truncated"), "used", "labels")


# ---- answers ----------------------------------------------------------------------------------
def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_refusal(answer: Column) -> Column:
    """The sentinel in a short answer; a null answer is none."""
    return F.coalesce(F.contains(answer, F.lit(REFUSAL)) & (F.length(_stripped(answer)) < len(REFUSAL) + 200), F.lit(False))


def check_answers(answers: DataFrame, supplied: str = "supplied", text: str = "text") -> DataFrame:
    """used (in supplied order), invented and malformed (by appearance), uncited, grounded and refused of each answer.

    A null answer cites nothing.
    """
    shown = F.coalesce(F.col(text), F.lit(""))
    rows = answers.withColumn("labels", citation_labels(shown))
    return (
        rows.withColumn("used", F.filter(supplied, lambda x: F.array_contains("labels", x)))
        .withColumn("invented", F.array_except("labels", supplied))
        .withColumn("malformed", malformed_labels(shown))
        .withColumn("uncited", F.array_except(supplied, "labels"))
        .withColumn("grounded", F.size("invented") == 0)
        .withColumn("refused", is_refusal(F.col(text)))
    )


def messages(question: Column, context: Column, system: str = "Answer from the numbered passages only and cite them.") -> Column:
    """The chat messages of a question; a blank context gives null, since there is nothing to answer from."""
    user = F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), _stripped(question))
    return F.when(F.length(_stripped(context)) > 0, F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))))


def answers(questions: DataFrame, replies: DataFrame) -> DataFrame:
    """The checked answer of every question.

    questions: query_id, question, context, supplied (labels), truncated. replies: query_id, text, finish_reason.
    Without context a question is refused (no_evidence) whatever the reply; a reply with the sentinel is refused
    (model_declined) and keeps its sources; else labels are checked. Blank questions have no row, a question
    without a reply a null text.
    """
    asked = questions.where(F.length(_stripped(F.col("question"))) > 0)
    rows = asked.join(replies.select("query_id", "text", "finish_reason"), "query_id", "left")
    empty = F.coalesce(F.length(_stripped(F.col("context"))) == 0, F.lit(True))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("supplied", F.when(empty, none).otherwise(F.coalesce("supplied", none))).withColumn("text", F.when(~empty, F.col("text")))
    judged = check_answers(rows)
    refused = empty | F.col("refused")
    off = lambda c: F.when(refused, none).otherwise(F.col(c))
    judged = judged.select(
        "query_id", F.when(refused, F.lit(None).cast("string")).otherwise(_stripped(F.col("text"))).alias("text"), "supplied", off("used").alias("used"), off("invented").alias("invented"), off("malformed").alias("malformed"),
        F.array_except("supplied", off("used")).alias("uncited"), refused.alias("refused"), F.when(empty, NO_EVIDENCE).when(F.col("refused"), MODEL_DECLINED).alias("refusal_reason"),
        F.coalesce(~refused & (F.col("finish_reason") == "length"), F.lit(False)).alias("hit_token_limit"), F.coalesce(F.col("truncated") & ~empty, F.lit(False)).alias("truncated_context"),
    )
    judged = judged.withColumn("grounded", F.size("invented") == 0).withColumn("has_problems", (F.size("invented") > 0) | (F.size("malformed") > 0) | F.col("hit_token_limit"))
    return judged.withColumn("summary", answer_summary())


def answer_summary() -> Column:
    """One line about an answer, with what is wrong with it."""
    listed = lambda word, c: F.when(F.size(c) > 0, F.concat(F.lit(word + " "), F.array_join(c, " ")))
    line = F.concat_ws(
        ", ", F.format_string("%d chars", F.length(F.coalesce("text", F.lit("")))), F.format_string("%d/%d sources cited", F.size("used"), F.size("supplied")),
        listed("INVENTED", "invented"), listed("malformed", "malformed"), F.when(F.col("hit_token_limit"), F.lit("hit token limit")),
    )
    return F.when(F.col("refused"), F.format_string("refused (%s)", F.col("refusal_reason"))).otherwise(line)
