"""Retrieval metrics as aggregations over ranked lists and relevance judgements."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.session import cut


def paper_ranking(ranked: DataFrame, paper: str = "arxiv_id") -> DataFrame:
    """query_id, doc, rank: the first occurrence of each paper counts, ranks are dense."""
    first = ranked.groupBy("query_id", F.col(paper).alias("doc")).agg(F.min("rank").alias("r"))
    return first.select("query_id", "doc", F.row_number().over(Window.partitionBy("query_id").orderBy("r", "doc")).cast("long").alias("rank"))


def query_metrics(ranked: DataFrame, relevant: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Per query of relevant: precision, recall, ndcg and hit rate at each k, and the reciprocal rank.

    A query without results has zeros. Precision divides by k, not by the number returned.
    """
    qrels = relevant.select("query_id", "doc").distinct()
    hits = qrels.join(ranked.select("query_id", "doc", "rank"), ["query_id", "doc"], "left")
    n = F.count(F.lit(1))

    def ideal(k: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + F.lit(1.0)))

    columns = []
    for k in ks:
        found = F.count_if(F.col("rank") <= k)
        gain = F.coalesce(F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0))
        columns += [F.round(found / k, 6).alias(f"precision_{k}"), F.round(found / n, 6).alias(f"recall_{k}"), F.round(gain / ideal(k), 6).alias(f"ndcg_{k}"), F.when(found > 0, 1.0).otherwise(0.0).alias(f"hit_{k}")]
    return hits.groupBy("query_id").agg(*columns, F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 6).alias("mrr"))


def long_form(metrics: DataFrame) -> DataFrame:
    names = [c for c in metrics.columns if c != "query_id"]
    return metrics.unpivot("query_id", names, "metric", "value")


def macro(metrics: DataFrame, category: DataFrame | None = None) -> DataFrame:
    """Means over queries, overall (category null) and by category in one pass."""
    names = [c for c in metrics.columns if c != "query_id"]
    means = [F.round(F.avg(F.coalesce(F.col(c), F.lit(0.0))), 6).alias(c) for c in names]
    if category is None:
        return metrics.agg(F.count(F.lit(1)).alias("queries"), *means)
    return metrics.join(category, "query_id").rollup("category").agg(F.count(F.lit(1)).alias("queries"), *means)


def misses(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Queries none of whose relevant documents was found."""
    found = ranked.join(relevant, ["query_id", "doc"], "left_semi").select("query_id").distinct()
    return relevant.select("query_id").distinct().join(found, "query_id", "left_anti")


def latency(rows: DataFrame, group: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """Count, mean, median, least, most and nearest-index 90th percentile of each group, exactly.

    A sketch (one aggregation, combined before the shuffle) brackets each wanted position by values whose rank
    is off by at most n / accuracy. A second scan counts what lies below a bracket and shuffles only the values
    inside, a few in ten thousand, so no task sorts a whole group. Null values do not count.
    """
    v = rows.select(F.col(group).alias("grp"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    slack = 2.0 / accuracy
    bounds = [min(1.0, max(0.0, p + d)) for p in (0.5, 0.9) for d in (-slack, slack)]
    n = F.count(F.lit(1))
    whole = v.groupBy("grp").agg(n.alias("n"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", bounds, accuracy).alias("q"))
    # the sketch never misses by more than slack; small groups are bracketed whole
    small = F.col("n") <= accuracy
    lo = lambda i: F.when(small, F.col("least")).otherwise(F.col("q")[i])
    hi = lambda i: F.when(small, F.col("most")).otherwise(F.col("q")[i])
    at = [F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2), F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(0.9)))]
    marks = whole.select("*", F.explode(F.array(*[F.struct(F.lit(x).alias("what"), p.alias("position"), lo(a).alias("lo"), hi(a + 1).alias("hi")) for x, p, a in (("low", at[0], 0), ("high", at[1], 0), ("p90", at[2], 2))])).alias("m")).select("grp", "m.*")
    marks = cut(marks)  # three rows a group
    few = marks.count() <= 300_000
    seen = v.withColumnRenamed("grp", "g").join((F.broadcast if few else lambda x: x)(marks), F.col("g").eqNullSafe(F.col("grp")) & (F.col("v") <= F.col("hi")))
    counted = seen.groupBy("grp", "what", "position", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("x")).agg(n.alias("k"))
    upto = counted.withColumn("upto", F.sum("k").over(Window.partitionBy("grp", "what").orderBy(F.asc_nulls_first("x")))).where((F.col("upto") > F.col("position")) & F.col("x").isNotNull())
    taken = upto.groupBy(F.col("grp").alias("g")).agg(*[F.min(F.when(F.col("what") == x, F.col("x"))).alias(x) for x in ("low", "high", "p90")])
    both = whole.join(taken, F.col("grp").eqNullSafe(F.col("g")))
    return both.select("grp", "n", *[F.round(c, 6).alias(c) for c in ("mean", "least", "most", "p90")], F.round((F.col("low") + F.col("high")) / 2, 6).alias("median"))


def candidate_labels(ranked: DataFrame, relevant: DataFrame, depth: int = 10) -> DataFrame:
    """Documents near the top of any configuration that no one has judged: the depth best of each query by best rank, then id.

    ranks: the rank in each configuration, as configuration=rank joined by blanks.
    """
    near = ranked.where(F.col("rank") <= depth).join(relevant.select("query_id", "doc"), ["query_id", "doc"], "left_anti")
    listed = F.array_sort(F.collect_set(F.format_string("%s=%d", F.col("config"), F.col("rank").cast("long"))))  # one entry a configuration
    best = near.groupBy("query_id", "doc").agg(F.min("rank").alias("best_rank"), F.countDistinct("config").cast("long").alias("configs"), F.array_join(listed, " ").alias("ranks"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("best_rank", "doc"))
    return best.withColumn("place", order.cast("long")).where(F.col("place") <= depth)


def missing_labels(relevant: DataFrame, corpus: DataFrame) -> DataFrame:
    """Judged documents that the corpus does not hold, with the number of queries that name them."""
    return relevant.select("query_id", "doc").distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("queries")).join(corpus.select("doc"), "doc", "left_anti")


def score_examples(ranked: DataFrame, examples: DataFrame, relevant: DataFrame, paper: str = "arxiv_id") -> DataFrame:
    """Metrics of every example (query_id, category) that has judgements, with the number of papers retrieved."""
    papers = paper_ranking(ranked, paper)
    count = papers.groupBy("query_id").agg(F.count(F.lit(1)).alias("retrieved"))
    scored = query_metrics(papers, relevant)
    return examples.select("query_id", "category").join(scored, "query_id").join(count, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.lit(0)).cast("long"))


def sweep(runs: Mapping[str, DataFrame], examples: DataFrame, relevant: DataFrame, paper: str = "arxiv_id") -> DataFrame:
    """Macro means of several configurations, overall (category null) and by category: one plan for all of them.

    runs: ranked chunks (query_id, rank and the paper column) by configuration name.
    """
    parts = []
    for name, ranked in runs.items():
        scored = score_examples(ranked, examples, relevant, paper).drop("retrieved")
        parts.append(macro(scored.drop("category"), scored.select("query_id", "category")).withColumn("config", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def config_snapshot(name: str, search: object, **more: object) -> str:
    """JSON of all that is needed to repeat a run: its name, the search settings, the versions it ran on."""
    import platform

    import pyspark

    settings = dataclasses.asdict(search) if dataclasses.is_dataclass(search) else search
    return json.dumps({"configuration": name, "retrieval": settings, "environment": {"python": platform.python_version(), "spark": pyspark.__version__}, **more}, sort_keys=True, default=str)


def write_results(scored: DataFrame, folder: str) -> None:
    """Every query's row of a run as JSON lines, partitioned by configuration if there is such a column."""
    out = scored.write.mode("overwrite")
    (out.partitionBy("config") if "config" in scored.columns else out).json(folder)


def report(means: DataFrame, review: str, metrics: Sequence[str] = ("recall_5", "recall_10", "ndcg_10", "mrr", "hit_5")) -> str:
    """Markdown tables of a sweep: overall and by category, headed by the review status. One row a configuration and category."""
    rows = sorted((r.asDict() for r in means.select("config", "category", "queries", *metrics).collect()), key=lambda r: (r["category"] or "", r["config"]))
    out = ["# Retrieval evaluation", "", review, ""]
    for category in sorted({r["category"] or "" for r in rows}):
        out += [f"## {category or 'overall'}", "", "| configuration | queries | " + " | ".join(metrics) + " |", "|-" * (len(metrics) + 2) + "|"]
        out += [f"| {r['config']} | {r['queries']} | " + " | ".join(f"{r[m]:.3f}" for m in metrics) + " |" for r in rows if (r["category"] or "") == category] + [""]
    return "\n".join(out)


def review_line(items: int, reviewed: int) -> str:
    """The review status in one line; an empty set is never fully reviewed."""
    if items and items == reviewed:
        return f"{items} examples, all human-reviewed"
    return f"{items} examples, {reviewed} human-reviewed, {items - reviewed} unreviewed: results are provisional"


def review_summary(items: DataFrame, by: str, reviewed: str) -> DataFrame:
    """Items and reviewed items of each group; a group is fully reviewed only if it has items."""
    n, done = F.count(F.lit(1)), F.count_if(F.col(reviewed))
    return items.groupBy(by).agg(n.cast("long").alias("items"), done.cast("long").alias("reviewed_items"), ((n > 0) & (n == done)).alias("fully_reviewed"))
