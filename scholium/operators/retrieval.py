"""Retrieval over whole batches of queries: BM25, nearest vectors, fusion and shaping of ranked lists.

All rankings break ties as their docstrings say, so results do not depend on partitioning. Queries are a
stated set and go to the tasks in blocks of ``QUERY_BLOCK``, however many there are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scholium.functions.analysis import stems
from scholium.functions.text import word_runs
from scholium.session import by_key, spread, stored

QUERY_BLOCK = 20_000
FUSED_MOST = 200_000  # rows of ids and ranks, about 10 MB
CELLS = 4_000_000  # scores held at once, rows times queries


def top(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group with their rank (bigint); partial limits run before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


class Best:
    """The k best scores of each query so far, ties by the smaller id, over blocks of scored rows."""

    def __init__(self, queries: int, k: int):
        self.k, self.ids, self.scores = k, [np.empty(0, object)] * queries, [np.empty(0)] * queries
        self.least = np.full(queries, -np.inf)

    def add(self, ids: np.ndarray, scores: np.ndarray, usable: np.ndarray) -> None:
        """ids of the rows, scores (rows x queries), and which of them count."""
        hopeful = usable & (scores >= self.least)
        for q in np.flatnonzero(hopeful.any(axis=0)):
            at = np.flatnonzero(hopeful[:, q])
            own, values = np.concatenate([self.ids[q], ids[at]]), np.concatenate([self.scores[q], scores[at, q]])
            if len(values) > self.k:  # what lies below the k-th score is out; ties at it are settled by id
                keep = values >= np.partition(values, -self.k)[-self.k]
                own, values = own[keep], values[keep]
            by_id = np.argsort(own, kind="stable")
            order = by_id[np.argsort(-values[by_id], kind="stable")][: self.k]
            self.ids[q], self.scores[q] = own[order], values[order]
            if len(order) == self.k:
                self.least[q] = self.scores[q][-1]

    def batch(self, query_ids: list, query_type: pa.DataType, id_type: pa.DataType) -> pa.RecordBatch:
        whose = [x for q, own in zip(query_ids, self.ids, strict=True) for x in [q] * len(own)]
        ids = [x for own in self.ids for x in own.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(whose, query_type), pa.array(ids, id_type), pa.array(np.concatenate([np.empty(0), *self.scores]))], names=["query_id", "doc_id", "score"])


def _in_blocks(queries: DataFrame, run: Callable[[list[dict]], DataFrame]) -> DataFrame:
    """run(queries) for blocks of about QUERY_BLOCK queries; the driver holds one block at a time.

    The results of several blocks are stored one after another, so nothing grows with the number of queries.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    if blocks == 1:
        return run([r.asDict() for r in queries.collect()])
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    done = [stored(run([r.asDict() for r in queries.where(part == b).collect()])) for b in range(blocks)]
    return reduce(DataFrame.unionByName, done)


def _postings(lists: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the wanted terms in lists of words, and the length of every list."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    code = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    both, counts = np.unique(row[code >= 0] * max(1, len(terms)) + code[code >= 0], return_counts=True)
    return both // max(1, len(terms)), both % max(1, len(terms)), counts, lengths


def bm25(docs: DataFrame, doc: str, fields: Mapping[str, tuple[Column, float]], queries: DataFrame, query: str, query_fields: Mapping[str, Column], k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score (rounded to 6 digits), rank of the k best documents of each query, ties by doc_id.

    fields: words of a document and boost by field name; query_fields: words of a query in that field. The score
    is the boosted sum over fields, statistics are per field. One scan counts the query terms (a row a term and
    task), one scores every document inside its own row and keeps k rows a query and task, which alone are
    shuffled. Null and empty fields count for nothing; a term repeated in the query counts as often.
    """
    names = list(fields)
    words = spread(docs.select(F.col(doc).alias("doc_id"), *[c.alias(f"w{i}") for i, (c, _) in enumerate(fields.values())]).where(F.col("doc_id").isNotNull()))
    asked = queries.select(F.col(query).alias("query_id"), *[query_fields[f].alias(f"w{i}") for i, f in enumerate(names)]).where(F.col("query_id").isNotNull())
    kinds = dict(words.dtypes) | dict(asked.dtypes)
    query_type, id_type = to_arrow_type(asked.schema["query_id"].dataType), to_arrow_type(words.schema["doc_id"].dataType)

    def one(listed: list[dict]) -> DataFrame:
        terms = [pa.array(sorted({t for r in listed for t in r[f"w{i}"] or []}), pa.string()) for i in range(len(names))]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, docs_, length = [np.zeros(len(t) + 1, np.int64) for t in terms], [0] * len(terms), [0] * len(terms)
            for batch in batches:
                for i, t in enumerate(terms):
                    _, term, _, lengths = _postings(batch.column(i + 1), t)
                    seen[i] += np.bincount(term, minlength=len(t) + 1)
                    docs_[i] += int((lengths > 0).sum())
                    length[i] += int(lengths.sum())
            rows = [(i, j, int(n), 0) for i, s in enumerate(seen) for j, n in enumerate(s) if n] + [(i, -1, n, x) for i, (n, x) in enumerate(zip(docs_, length, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["field", "term", "n", "length"])

        total, df = {}, [np.zeros(len(t)) for t in terms]
        for r in words.mapInArrow(count, "field long, term long, n long, length long").groupBy("field", "term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).collect():
            if r["term"] < 0:
                total[r["field"]] = (r["n"], r["length"] / max(1, r["n"]))
            else:
                df[r["field"]][r["term"]] = r["n"]
        idf, users = [], []
        for i, t in enumerate(terms):
            n = total.get(i, (0, 0.0))[0]
            idf.append(np.log(1 + (n - df[i] + 0.5) / (df[i] + 0.5)))
            at = {x: j for j, x in enumerate(t.to_pylist())}
            who: list[list[tuple[int, int]]] = [[] for _ in at]
            for q, r in enumerate(listed):
                for x, times in Counter(r[f"w{i}"] or []).items():
                    who[at[x]].append((q, times))
            users.append([(np.array([q for q, _ in w], int), np.array([n for _, n in w], float)) for w in who])
        boosts, step = [x for _, x in fields.values()], max(1, CELLS // max(1, len(listed)))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(listed), k)
            for batch in (x.slice(a, step) for x in batches for a in range(0, x.num_rows, step)):
                sums = np.zeros((batch.num_rows, len(listed)))
                for i, t in enumerate(terms):
                    row, term, tf, lengths = _postings(batch.column(i + 1), t)
                    part = boosts[i] * idf[i][term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[row] / max(total[i][1], 1e-9)))
                    by_term = np.argsort(term, kind="stable")
                    for own in np.split(by_term, np.flatnonzero(np.diff(term[by_term])) + 1) if len(term) else []:
                        q, times = users[i][term[own[0]]]
                        sums[np.ix_(row[own], q)] += np.outer(part[own], times)
                best.add(np.array(batch.column(0).to_pylist(), object), np.round(sums, 6), sums > 0)
            yield best.batch([r["query_id"] for r in listed], query_type, id_type)

        return words.mapInArrow(score, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")

    return top(_in_blocks(asked, one), "query_id", k, F.desc("score"), F.asc("doc_id"))


def nearest(vectors: DataFrame, vec: str, embedding: str, queries: DataFrame, query: str, query_vec: str, k: int = 10, exclude_self: bool = True) -> DataFrame:
    """The k most similar vectors (cosine) of each query, exactly: query_id, vec_id, score, rank.

    The queries are a stated set and meet the vectors in blocks of rows, by matrix products; each task keeps k a
    query, which alone are shuffled. Null and zero vectors, and such of another length than the queries, have no score.
    """
    q = queries.select(F.col(query).alias("query_id"), F.col(query_vec).cast("array<double>").alias("v")).where(F.col("query_id").isNotNull() & (F.size("v") > 0))
    v = spread(vectors.select(F.col(vec).alias("doc_id"), F.col(embedding).cast("array<double>").alias("v")).where(F.col("doc_id").isNotNull() & (F.size("v") > 0)))
    kinds = dict(v.dtypes) | dict(q.dtypes)
    query_type, id_type = to_arrow_type(q.schema["query_id"].dataType), to_arrow_type(v.schema["doc_id"].dataType)

    def one(listed: list[dict]) -> DataFrame:
        sizes = {len(r["v"]) for r in listed}
        if len(sizes) > 1:
            raise ValueError("the query vectors differ in length")
        dims = sizes.pop() if sizes else 0
        wanted = np.array([r["v"] for r in listed], float).reshape(len(listed), dims)
        with np.errstate(all="ignore"):
            wanted = wanted / np.linalg.norm(wanted, axis=1, keepdims=True)
        places: dict[object, list[int]] = {}
        for j, r in enumerate(listed):
            places.setdefault(r["query_id"], []).append(j)
        step = max(1, CELLS // max(1, len(listed)))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(listed), k)
            for batch in (x.slice(a, step) for x in batches for a in range(0, x.num_rows, step)):
                batch = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), dims))
                if not batch.num_rows:
                    continue
                own = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, dims)
                with np.errstate(all="ignore"):
                    cosine = np.round(own @ wanted.T / np.linalg.norm(own, axis=1, keepdims=True), 6)
                ids, usable = batch.column(0).to_pylist(), np.isfinite(cosine)
                if exclude_self:
                    for i, x in enumerate(ids):
                        if x in places:
                            usable[i, places[x]] = False
                best.add(np.array(ids, object), cosine, usable)
            yield best.batch([r["query_id"] for r in listed], query_type, id_type)

        return v.mapInArrow(score, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")

    found = _in_blocks(q, one).select("query_id", F.col("doc_id").alias("vec_id"), "score")
    return top(found, "query_id", k, F.desc("score"), F.asc("vec_id"))


def metadata_filter(df: DataFrame, equal: dict[str, Sequence] | None = None, overlap: dict[str, Sequence] | None = None, since: tuple[str, object] | None = None, until: tuple[str, object] | None = None) -> DataFrame:
    """AND over fields, OR within a field, both date bounds inclusive; applied before any ranking."""
    for c, values in (equal or {}).items():
        if values:
            df = df.where(F.col(c).isin(*values))
    for c, values in (overlap or {}).items():
        if values:
            df = df.where(F.arrays_overlap(F.col(c), F.array(*map(F.lit, values))))
    if since:
        df = df.where(F.col(since[0]) >= F.lit(since[1]))
    return df.where(F.col(until[0]) <= F.lit(until[1])) if until else df


def reciprocal_rank(lists: DataFrame, k: int = 60) -> DataFrame:
    """Fusion by reciprocal ranks. lists: query_id, chunk_id, li (number of the list), rank. Ties: first list, then its rank."""
    if k < 1:
        raise ValueError("k must be at least 1")
    fused = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), F.min(F.struct("li", "rank")).alias("first"))
    return _ordered(fused)


def weighted(lists: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Fusion by weighted scores, each list scaled to [0, 1] over what it returned; equal scores give 1."""
    w = Window.partitionBy("query_id", "li")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("li").cast("int"))
    part = F.when(hi == lo, weight).otherwise(weight * (F.col("score") - lo) / (hi - lo))
    fused = lists.withColumn("part", part).groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 9).alias("score"), F.min(F.struct("li", "rank")).alias("first"))
    return _ordered(fused)


def _ordered(fused: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first.li", "first.rank", "chunk_id")).cast("long")
    return fused.select("query_id", "chunk_id", "score", rank.alias("rank"))


def merge_lists(lists: DataFrame, *columns: str) -> DataFrame:
    """One row a query and chunk: the given columns as the first list has them, and all contributions in list order."""
    parts = F.array_sort(F.collect_list(F.struct("li", "retriever", "rank", "score")))  # one entry a list
    shown = F.transform(parts, lambda p: F.struct(p["retriever"].alias("retriever"), p["rank"].alias("rank"), p["score"].alias("score")))
    return lists.groupBy("query_id", "chunk_id").agg(*[F.min_by(c, F.struct("li", "rank")).alias(c) for c in columns], shown.alias("contributions"))


def explain(lists: DataFrame) -> DataFrame:
    """How each chunk was found: retriever#rank(score) joined by ' + ' in list order."""
    parts = F.array_sort(F.collect_list(F.struct("li", "retriever", "rank", "score")))  # one entry a list
    return lists.groupBy("query_id", "chunk_id").agg(F.array_join(F.transform(parts, lambda p: F.format_string("%s#%d(%.4f)", p["retriever"], p["rank"], p["score"])), " + ").alias("found_by"))


class Unlike:
    """Word sets of one query of which none is too like another, with an exact index to find a like one.

    Two sets as alike as threshold share a word among the first n - ceil(threshold * n) + 1 of each in any common
    order. Words are numbered as they come and ordered newest first: new words are the rare ones.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.numbers: dict[int, int] = {}
        self.kept: list[set[int]] = []
        self.by_word: dict[int, list[int]] = {}

    def add(self, words: list[int]) -> bool:
        """Whether the set is neither empty nor too like a kept one; then it is kept."""
        own = {self.numbers.setdefault(w, len(self.numbers)) for w in words}
        n = len(own)
        if not n or self.kept and self.threshold <= 0:
            return False
        first = sorted(own, reverse=True)[: max(0, n - math.ceil(self.threshold * n - 1e-9) + 1)]
        for k in {k for x in first for k in self.by_word.get(x, ())}:
            other = self.kept[k]
            if min(n, len(other)) >= (self.threshold - 1e-9) * max(n, len(other)):
                common = len(own & other)
                if common / (n + len(other) - common) >= self.threshold:
                    return False
        for x in first:
            self.by_word.setdefault(x, []).append(len(self.kept))
        self.kept.append(own)
        return True


def drop_alike(ranked: DataFrame, text: str = "text", threshold: float = 0.9, more: Sequence[str] = ()) -> DataFrame:
    """Greedy in rank order over a query's whole list: a chunk is dropped if its word set is too like that of a kept one, or empty.

    ranked: query_id, chunk_id, rank, text, and more columns to keep. Words travel as 64-bit hashes. Rows stream
    past in order; a task holds the word sets that one query keeps.
    """
    words = F.array_distinct(F.transform(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?U)\s+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    kept = ranked.select("query_id", "chunk_id", "rank", *more, words.alias("w"))
    rows = by_key(kept, "query_id").sortWithinPartitions("query_id", "rank", "chunk_id")
    kinds, names = dict(rows.dtypes), ["query_id", "chunk_id", *more]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, unlike = None, Unlike(threshold)
        for batch in batches:
            at, ranks = [], []
            for i, (q, w) in enumerate(zip(batch.column("query_id").to_pylist(), batch.column("w").to_pylist(), strict=True)):
                if q != query:
                    query, unlike = q, Unlike(threshold)
                if unlike.add(w):
                    at.append(i)
                    ranks.append(len(unlike.kept))
            own = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in names), pa.array(ranks, pa.int64())], names=[*names, "rank"])

    return rows.mapInArrow(fold, ", ".join(f"{c} {kinds[c]}" for c in names) + ", rank long")


def cap_per_paper(ranked: DataFrame, paper: str, most: int = 3) -> DataFrame:
    """At most ``most`` chunks of a paper in a query's list; ranks are given anew."""
    if most < 1:
        raise ValueError("most must be at least 1")
    kept = ranked.withColumn("n", F.row_number().over(Window.partitionBy("query_id", paper).orderBy("rank", "chunk_id"))).where(F.col("n") <= most).drop("n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id")).cast("long"))


def rerank(ranked: DataFrame, score: str, k: int, enabled: bool = True) -> DataFrame:
    """By the given scores, ties by the old rank; a query with any null score keeps its order. Adds applied and reason.

    reason: why the order was kept (disabled, missing_scores), null where the scores were applied.
    """
    w = Window.partitionBy("query_id")
    rows = ranked.withColumn("applied", F.min(F.col(score).isNotNull()).over(w) & F.lit(enabled))
    order = F.row_number().over(w.orderBy(F.when(F.col("applied"), F.col(score)).desc_nulls_last(), "rank", "chunk_id")).cast("long")
    reason = F.when(~F.col("applied"), F.lit("missing_scores" if enabled else "disabled"))
    return rows.withColumn("new_rank", order).where(F.col("new_rank") <= k).withColumn("reason", reason)


def identity_scores(ranked: DataFrame) -> DataFrame:
    """Scores that keep the order: n - position."""
    return ranked.withColumn("score", (F.count(F.lit(1)).over(Window.partitionBy("query_id")) - F.col("rank") + 1).cast("double"))


def hit_rows(hits: DataFrame, retriever: str) -> DataFrame:
    """Hits (query_id, chunk_id, score, rank) as result rows: a null score is 0, the finding is noted as a contribution."""
    score = F.coalesce(F.col("score"), F.lit(0.0))
    return hits.withColumn("score", score).withColumn("contributions", F.array(F.struct(F.lit(retriever).alias("retriever"), F.col("rank"), score.alias("score"))))


def result_summary(results: DataFrame, candidates: DataFrame, mode: str) -> DataFrame:
    """One line a query: mode, rows shown, and how many candidates there were; a query without results has 0."""
    shown = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("shown"))
    total = candidates.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("candidates"))
    both = total.join(shown, "query_id", "left").withColumn("shown", F.coalesce("shown", F.lit(0)))
    return both.withColumn("summary", F.format_string(f"{mode}: %d of %d candidates", F.col("shown"), F.col("candidates")))


@dataclass(frozen=True)
class Search:
    """What a search does; the boosts are of stemmed text, exact text and title."""

    mode: str = "hybrid"  # keyword, vector or hybrid
    k: int = 10
    pool: int = 50
    fusion: str = "rrf"  # or weighted
    rrf_k: int = 60
    weights: tuple[float, float] = (0.5, 0.5)
    boosts: tuple[float, float, float] = (1.0, 1.5, 2.0)
    stem: bool = True  # else all three are of exact words
    per_paper: int = 3
    deduplicate: bool = True
    threshold: float = 0.9


def keyword_search(chunks: DataFrame, questions: DataFrame, k: int, how: Search = Search()) -> DataFrame:
    """query_id, chunk_id, score, rank by BM25 over three fields. chunks: chunk_id, text, title. questions: query_id, query."""
    loose = stems if how.stem else word_runs
    made = {"stemmed": (loose, "text"), "exact": (word_runs, "text"), "title": (loose, "title")}
    fields = {f: (analyse(F.col(c)), w) for (f, (analyse, c)), w in zip(made.items(), how.boosts, strict=True)}
    asked = {f: analyse(F.col("query")) for f, (analyse, _) in made.items()}
    return bm25(chunks, "chunk_id", fields, questions, "query_id", asked, k).withColumnRenamed("doc_id", "chunk_id")


def vector_search(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank by cosine. chunks: chunk_id, vector. questions: query_id, vector."""
    return nearest(chunks, "chunk_id", "vector", questions, "query_id", "vector", k, exclude_self=False).withColumnRenamed("vec_id", "chunk_id")


def search(chunks: DataFrame, questions: DataFrame, how: Search = Search(), paper: str = "arxiv_id") -> DataFrame:
    """query_id, chunk_id, rank of the best chunks of every question (query_id, query, vector).

    chunks: chunk_id, text, title, vector and the paper column, already filtered by metadata. A hybrid search fuses
    both pools, drops near copies, caps each paper and cuts to k; the others give their k best as they are. Only the
    texts of fused candidates (two pools a question) are looked at again.
    """
    if how.mode == "keyword":
        return keyword_search(chunks, questions, how.k, how)
    if how.mode == "vector":
        return vector_search(chunks, questions, how.k)
    if how.mode != "hybrid":
        raise ValueError(f"unknown mode {how.mode}")
    pools = [keyword_search(chunks, questions, how.pool, how), vector_search(chunks, questions, how.pool)]
    lists = stored(reduce(DataFrame.unionByName, [p.select("query_id", "chunk_id", "rank", "score", F.lit(i).alias("li")) for i, p in enumerate(pools, 1)]))
    return hybrid(lists, chunks, how, paper)


def hybrid(lists: DataFrame, chunks: DataFrame, how: Search = Search(), paper: str = "arxiv_id") -> DataFrame:
    """Both pools (query_id, chunk_id, li 1 or 2, rank, score) fused, near copies dropped, capped per paper, cut to k."""
    pools = lists.where(F.col("rank") <= how.pool)
    fused = reciprocal_rank(pools, how.rrf_k) if how.fusion == "rrf" else weighted(pools, how.weights)
    few = pools.limit(FUSED_MOST + 1).count() <= FUSED_MOST  # else both sides are shuffled
    looked = chunks.select("chunk_id", "text", paper).join((F.broadcast if few else lambda x: x)(fused.select("query_id", "chunk_id", "rank")), "chunk_id")
    # the texts' words go with the paper through the fold, so no text is read twice
    kept = drop_alike(looked, threshold=how.threshold, more=[paper]) if how.deduplicate else looked.select("query_id", "chunk_id", "rank", paper)
    return cap_per_paper(kept, paper, how.per_paper).where(F.col("rank") <= how.k).select("query_id", "chunk_id", "rank")
