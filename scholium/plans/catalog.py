"""The queries for the core operators and the SQL they are compared with.

Outputs are flat scalar columns; doubles are rounded on both sides, ranks and counts are bigint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators import chunking, context, evaluation, retrieval, state
from scholium.session import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- text functions ---------------------------------------------------------------------------
def _tokens_sql(text: str) -> str:
    words = f"regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+')"
    kept = f"list_filter({words}, lambda x: regexp_full_match(x, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+'))"
    return f"""CASE WHEN {text} IS NULL THEN NULL WHEN regexp_full_match({text}, '[\\s\\p{{Z}}]*') THEN 0 ELSE CAST(greatest(1, round_even(len({kept}) * 1.35::DOUBLE
  + len(list_filter({kept}, lambda x: length(x) > 9)) * 0.8::DOUBLE + len(regexp_extract_all({text}, '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}\\x{{85}}\\x{{0b}}]|\\p{{Nd}}+')), 0)) AS BIGINT) END"""


@query(f"SELECT doc_id, {_tokens_sql('text')} AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("tokens"))


_DENSE = "length(regexp_replace(t, '[\\s\\p{Z}\\x{85}\\x{0b}]', '', 'g'))"
_QUALITY = f"""
WITH b AS (SELECT extraction_id, coalesce(text, '') AS t, page_count AS p FROM extractions),
m AS (SELECT extraction_id, p, {_DENSE} AS dense, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS letters,
  len(regexp_extract_all(t, '[^\\s\\p{{Z}}\\x{{85}}\\x{{0b}}]+')) AS words, length(t) - length(replace(t, chr(65533), '')) AS bad, length(t) AS size FROM b),
q AS (SELECT *, dense / p::DOUBLE AS cpp, letters / dense::DOUBLE AS alpha, dense / words::DOUBLE AS mwl, bad / size::DOUBLE AS rep FROM m WHERE dense > 0),
s AS (SELECT *, greatest(0, least(1, (alpha - 0.55) / (0.70::DOUBLE - 0.55))) * (CASE WHEN rep > 0.01 THEN 0.25 ELSE 1 END)
  * (0.6::DOUBLE * greatest(0, least(1, (cpp - 100) / 700.0::DOUBLE)) + 0.4::DOUBLE * (CASE WHEN mwl BETWEEN 2.5 AND 12 THEN 1 ELSE 0 END)) AS score FROM q)
"""


@query(_QUALITY + """SELECT extraction_id, round(coalesce(cpp, 0), 6) AS chars_per_page, round(coalesce(alpha, 0), 6) AS alpha_ratio, round(coalesce(mwl, 0), 6) AS mean_word_length,
  round(coalesce(rep, 0), 6) AS replacement_char_ratio, CAST(coalesce(s.words, 0) AS BIGINT) AS word_count, round(coalesce(score, 0), 6) AS score,
  CAST(CASE WHEN dense = 0 THEN 1 ELSE (cpp < 100)::INT + (alpha < 0.55)::INT + (mwl < 2.5)::INT + (mwl > 12)::INT + (rep > 0.01)::INT END AS BIGINT) AS reasons FROM m LEFT JOIN (SELECT * EXCLUDE (dense) FROM s) s USING (extraction_id)""")
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    q = spread(table(spark, d, "extractions").select("extraction_id", "text", "page_count")).select("extraction_id", T.quality_struct(F.col("text"), F.col("page_count")).alias("q"))
    doubles = ("chars_per_page", "alpha_ratio", "mean_word_length", "replacement_char_ratio", "score")
    return q.select("extraction_id", *[F.round(f"q.{c}", 6).alias(c) for c in doubles], "q.word_count", F.size("q.reasons").cast("long").alias("reasons"))


@query(_QUALITY + """SELECT extraction_id, coalesce(s.words, 0) = 0 OR coalesce(cpp, 0) < 100 OR (coalesce(score, 0) < 0.5 AND coalesce(cpp, 0) < 800) AS recognise FROM m LEFT JOIN s USING (extraction_id)""")
def ocr_decision(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "extractions").select("extraction_id", "text", "page_count")).select("extraction_id", T.quality_struct(F.col("text"), F.col("page_count")).alias("q"))
    return rows.select("extraction_id", T.needs_recognition({c: F.col(f"q.{c}") for c in ("word_count", "chars_per_page", "score")}).alias("recognise"))


@query(_QUALITY.replace("FROM extractions)", "FROM (SELECT extraction_id * 2 AS extraction_id, text, page_count FROM extractions UNION ALL SELECT extraction_id * 2 + 1, regexp_replace(text, '[^a-z \\n]', 'e', 'g'), page_count FROM extractions))") + """,
r AS (SELECT m.extraction_id // 2 AS extraction_id, m.extraction_id % 2 AS again, coalesce(s.words, 0) AS words, coalesce(cpp, 0) AS cpp, coalesce(score, 0) AS score FROM m LEFT JOIN s USING (extraction_id)),
t AS (SELECT n.*, o.score AS other, n.words = 0 OR n.cpp < 100 OR (n.score < 0.5 AND n.cpp < 800) AS wanted FROM r n JOIN r o USING (extraction_id) WHERE n.again = 0 AND o.again = 1)
SELECT extraction_id, CASE WHEN wanted AND other > score THEN 'ocr' WHEN wanted AND words = 0 THEN 'none' ELSE 'pymupdf' END AS method, round(CASE WHEN wanted AND other > score THEN other ELSE score END, 6) AS score,
  wanted AS ocr_attempted FROM t""")
def extraction_choice(spark: SparkSession, d: str) -> DataFrame:
    """The better of each text and a second reading of it, which is made here by writing e for all but small letters."""
    again = F.regexp_replace("text", "[^a-z \n]", "e")
    two = [T.quality_struct(t, F.col("page_count")).alias(name) for name, t in (("native", F.col("text")), ("other", again))]
    rows = spread(table(spark, d, "extractions").select("extraction_id", "text", "page_count")).select("extraction_id", *two)
    told = [{n: F.col(f"{name}.{n}") for n in ("score", "word_count", "chars_per_page")} for name in ("native", "other")]
    c = T.choose_extraction(*told, F.lit(True))
    return rows.select("extraction_id", c["method"].alias("method"), F.round(c["score"], 6).alias("score"), c["ocr_attempted"].alias("ocr_attempted"))


@query("""SELECT extraction_id, CAST(len(list_filter(string_split(coalesce(text, ''), chr(12)), lambda p: length(regexp_replace(p, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) >= 50)) AS BIGINT) AS full_pages,
  lower(coalesce(method, 'none')) <> 'none' AND length(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]', '', 'g')) > 0 AS usable FROM extractions""")
def page_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extractions").select("extraction_id", T.pages_with_text(F.col("text")).cast("long").alias("full_pages"), T.usable(F.col("method"), F.col("text")).alias("usable"))


@query("SELECT doc_id, sha256(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f]', '', 'g')) AS clean_hash, sha256(text) AS content_hash FROM documents")
def sanitise_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.content_hash(T.sanitise(F.col("text"))).alias("clean_hash"), T.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where(F.col("text").isNotNull()).select(T.content_hash(F.col("text")).alias("content_hash"), "doc_id")
    return rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("SELECT author_id, trim(regexp_replace(regexp_replace(lower(full_name), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS author_key FROM authors")
def author_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "authors").select("author_id", T.author_key(F.col("full_name")).alias("author_key"))


@query("SELECT record_id, regexp_extract(abs_url, '/abs/(.+?)(?:v(\\d+))?$', 1) AS id, CAST(coalesce(try_cast(regexp_extract(abs_url, '/abs/(.+?)(?:v(\\d+))?$', 2) AS INTEGER), 1) AS BIGINT) AS version, nullif(trim(regexp_replace(title, '[\\s\\p{Z}]+', ' ', 'g')), '') AS title FROM arxiv_papers")
def versioned_ids(spark: SparkSession, d: str) -> DataFrame:
    name, version = T.versioned_id(F.col("abs_url"))
    return table(spark, d, "arxiv_papers").select("record_id", name.alias("id"), version.cast("long").alias("version"), T.squeeze_blanks(F.col("title")).alias("title"))


@query("SELECT record_id, pdf_url IS NOT NULL AND regexp_matches(pdf_url, '^https?://([a-z0-9-]+\\.)*example\\.org(/|:|$)') AS allowed, coalesce(regexp_matches(replace(pdf_url, 'example.org', 'badexample.org'), '^https?://([a-z0-9-]+\\.)*example\\.org(/|:|$)'), false) AS lookalike FROM arxiv_papers")
def url_allowlist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "arxiv_papers").select("record_id", T.url_allowed(F.col("pdf_url"), ["example.org"]).alias("allowed"), T.url_allowed(F.replace("pdf_url", F.lit("example.org"), F.lit("badexample.org")), ["example.org"]).alias("lookalike"))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, list_transform(range(0, 64), lambda i: (('0x' || substr(h, (2 * (i % 32) + 1)::BIGINT, 2))::INTEGER - 127.5::DOUBLE) / 127.5) AS r FROM h)
SELECT doc_id, i, round(r[i] / sqrt(list_sum(list_transform(r, lambda x: x * x))), 6) AS value FROM (SELECT doc_id, r, unnest(range(1, 65)) AS i FROM r)""")
def stable_vectors(spark: SparkSession, d: str) -> DataFrame:
    """All 64 coordinates of every text's vector."""
    v = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.posexplode(T.stable_vector(F.col("text"), 64)).alias("i", "value"))
    return v.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), F.round("value", 6).alias("value"))


# ---- retrieval --------------------------------------------------------------------------------
def _bm25_sql(name: str, source: str, text: str, boost: float = 1.0) -> str:
    """Tables {name}_s: query_id, doc_id and the boosted score of one field, not rounded."""
    n = name
    return f"""
{n}_l AS (SELECT doc_id, w, len(w) AS dl FROM (SELECT doc_id, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {source}) WHERE len(w) > 0),
{n}_c AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a FROM {n}_l),
{n}_q AS (SELECT query_id, term, count(*)::DOUBLE AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM eval_examples) GROUP BY ALL),
{n}_p AS (SELECT doc_id, dl, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, dl, unnest(w) AS term FROM {n}_l) WHERE term IN (SELECT term FROM {n}_q) GROUP BY ALL),
{n}_d AS (SELECT term, count(*)::DOUBLE AS df FROM {n}_p GROUP BY term),
{n}_s AS (SELECT query_id, doc_id, {boost}::DOUBLE * sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))) AS score
  FROM {n}_p JOIN {n}_q USING (term) JOIN {n}_d USING (term), {n}_c GROUP BY ALL)"""


_BEST = "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(score), 6) AS score FROM s GROUP BY ALL)"
_TITLED = "docs AS (SELECT doc_id, text, regexp_extract(text, '^[^.!?]*') AS title FROM documents)"


def _titled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a title, their text up to the first full stop."""
    return table(spark, d, "documents").select("doc_id", "arxiv_id", "text", F.regexp_extract("text", r"^[^.!?]*", 0).alias("title"))


@query(f"WITH {_bm25_sql('t', 'documents', 'text')}, s AS (SELECT * FROM t_s) {_BEST} QUALIFY rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of each question; the cut is the feature."""
    words = {"text": (T.word_runs(F.col("text")), 1.0)}
    return retrieval.bm25(table(spark, d, "documents"), "doc_id", words, table(spark, d, "eval_examples"), "item_id", {"text": T.word_runs(F.col("query"))})


@query(f"WITH {_TITLED}, {_bm25_sql('t', 'docs', 'text', 1.5)}, {_bm25_sql('h', 'docs', 'title', 2.0)}, s AS (SELECT * FROM t_s UNION ALL SELECT * FROM h_s) {_BEST} QUALIFY rank <= 10")
def bm25_boosted(spark: SparkSession, d: str) -> DataFrame:
    """The ten best by exact words of text and title, boosted."""
    words, asked = {"text": (T.word_runs(F.col("text")), 1.5), "title": (T.word_runs(F.col("title")), 2.0)}, T.word_runs(F.col("query"))
    return retrieval.bm25(_titled(spark, d), "doc_id", words, table(spark, d, "eval_examples"), "item_id", {"text": asked, "title": asked})


def _searched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, questions) with vectors: documents and evaluation questions."""
    chunks = _titled(spark, d).select(F.col("doc_id").alias("chunk_id"), "arxiv_id", "text", "title", T.stable_vector(F.col("text")).alias("vector"))
    return chunks, table(spark, d, "eval_examples").select(F.col("item_id").alias("query_id"), "query", T.stable_vector(F.col("query"), prefix="query: ").alias("vector"))


@query()
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents by stemmed text, exact text and title; tested by brute force, since SQL has no stemmer."""
    return retrieval.search(*_searched(spark, d), retrieval.Search(mode="keyword"))


def _knn_sql(where: str = "true") -> str:
    return f"""SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0 AND {where} QUALIFY rank <= 10"""


def _knn(spark: SparkSession, d: str, **equal) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return retrieval.nearest(retrieval.metadata_filter(vectors, equal), "vec_id", "embedding", vectors.where("vec_id % 20 = 0"), "vec_id", "embedding")


@query(_knn_sql())
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of each query vector (ids divisible by 20), among all."""
    return _knn(spark, d)


@query(_knn_sql("v.label IN (1, 2, 3)"))
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    """As knn_topk, among the vectors that pass a filter, which is applied before the ranking."""
    return _knn(spark, d, label=[1, 2, 3])


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source IN ('thesis', 'arxiv_abstract') AND ingested_at >= TIMESTAMP '2015-01-01'")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = retrieval.metadata_filter(table(spark, d, "documents"), {"lang": ["en", "de"], "source": ["thesis", "arxiv_abstract"]}, since=("ingested_at", "2015-01-01 00:00:00"))
    return rows.select("doc_id", "lang", "source")


_CHUNKS = "SELECT DISTINCT query_id, chunk_id, arxiv_id, version, score, text, contributions FROM retrieved_chunks"
_LISTS = f"""l AS (SELECT DISTINCT query_id, chunk_id, CASE c.retriever WHEN 'keyword' THEN 1 ELSE 2 END AS li, c.retriever AS retriever, c.rank AS rank, c.score AS score
  FROM (SELECT query_id, chunk_id, unnest(contributions) AS c FROM retrieved_chunks))"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "retrieved_chunks").select("query_id", "chunk_id", F.explode("contributions").alias("c"))
    return rows.select("query_id", "chunk_id", F.when(F.col("c.retriever") == "keyword", 1).otherwise(2).alias("li"), "c.retriever", "c.rank", "c.score").distinct()


_ORDER = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f.li, f.rank, chunk_id) AS rank"


@query(f"""WITH {_LISTS}, s AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min({{'li': li, 'rank': rank}}) AS f FROM l GROUP BY ALL)
SELECT query_id, chunk_id, score, {_ORDER} FROM s""")
def fuse_rrf(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.reciprocal_rank(_lists(spark, d))


@query(f"""WITH {_LISTS}, m AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM l WINDOW w AS (PARTITION BY query_id, li)),
s AS (SELECT query_id, chunk_id, round(sum(CASE WHEN hi = lo THEN 0.5::DOUBLE ELSE 0.5::DOUBLE * (score - lo) / (hi - lo) END), 9) AS score, min({{'li': li, 'rank': rank}}) AS f FROM m GROUP BY ALL)
SELECT query_id, chunk_id, score, {_ORDER} FROM s""")
def fuse_weighted(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.weighted(_lists(spark, d), [0.5, 0.5])


@query(f"""WITH {_LISTS} SELECT query_id, chunk_id, string_agg(printf('%s#%d(%.4f)', retriever, rank, score), ' + ' ORDER BY li, retriever, rank, score) AS found_by FROM l GROUP BY ALL""")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.explain(_lists(spark, d))


_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, arxiv_id, max(score) AS score, max(rerank_score) AS rerank_score FROM retrieved_chunks GROUP BY ALL))"


def _ranked(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Each query's chunks once, by score: query_id, chunk_id, arxiv_id, rank and the given columns."""
    rows = table(spark, d, "retrieved_chunks")
    one = rows.groupBy("query_id", "chunk_id", "arxiv_id").agg(F.max("score").alias("score"), F.max("rerank_score").alias("rerank_score"), *[F.max(c).alias(c) for c in more])
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")).cast("long"))


@query(f"""WITH {_RANKED}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, arxiv_id ORDER BY rank) AS n FROM r QUALIFY n <= 3)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM k""")
def per_paper_cap(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.cap_per_paper(_ranked(spark, d), "arxiv_id").select("query_id", "chunk_id", "rank")


@query(f"""WITH {_RANKED}, u AS (SELECT *, min(CASE WHEN rerank_score IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY query_id) = 1 AS applied FROM r)
SELECT query_id, chunk_id, applied, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN applied THEN rerank_score END DESC NULLS LAST, rank) AS new_rank FROM u QUALIFY new_rank <= 5""")
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five best chunks after re-ranking; the cut is the feature."""
    return retrieval.rerank(_ranked(spark, d), "rerank_score", 5).select("query_id", "chunk_id", "applied", "new_rank")


@query(f"WITH {_RANKED} SELECT query_id, chunk_id, CAST(count(*) OVER (PARTITION BY query_id) - rank + 1 AS DOUBLE) AS score FROM r")
def rerank_identity(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.identity_scores(_ranked(spark, d)).select("query_id", "chunk_id", "score")


@query(f"""WITH RECURSIVE {_RANKED}, t AS (SELECT chunk_id, max(text) AS text FROM retrieved_chunks GROUP BY ALL),
x AS (SELECT query_id, chunk_id, rank, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\s\\p{{Z}}]+'), lambda w: w <> ''))) AS w FROM r JOIN t USING (chunk_id)),
walk AS (SELECT query_id, 0::BIGINT AS rank, []::VARCHAR[] AS ids, []::VARCHAR[][] AS kept FROM x GROUP BY query_id
 UNION ALL SELECT x.query_id, x.rank,
  CASE WHEN len(x.w) = 0 OR len(list_filter(walk.kept, lambda k: len(list_intersect(k, x.w)) / (len(k) + len(x.w) - len(list_intersect(k, x.w)))::DOUBLE >= 0.9)) > 0 THEN walk.ids ELSE list_append(walk.ids, x.chunk_id) END,
  CASE WHEN len(x.w) = 0 OR len(list_filter(walk.kept, lambda k: len(list_intersect(k, x.w)) / (len(k) + len(x.w) - len(list_intersect(k, x.w)))::DOUBLE >= 0.9)) > 0 THEN walk.kept ELSE list_append(walk.kept, x.w) END
 FROM walk JOIN x ON x.query_id = walk.query_id AND x.rank = walk.rank + 1),
e AS (SELECT query_id, ids FROM walk QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) = 1)
SELECT query_id, unnest(ids) AS chunk_id, unnest(range(1, len(ids) + 1)) AS rank FROM e""")
def dedup_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Near copies dropped from each query's whole list."""
    return retrieval.drop_alike(_ranked(spark, d, "text"))


_V = "list_transform(range(0, 64), lambda i: (('0x' || substr(h, (2 * (i % 32) + 1)::BIGINT, 2))::INTEGER - 127.5::DOUBLE) / 127.5)"


@query(f"""WITH RECURSIVE {_TITLED}, {_bm25_sql('t', 'docs', 'text', 2.5)}, {_bm25_sql('h', 'docs', 'title', 2.0)}, s AS (SELECT * FROM t_s UNION ALL SELECT * FROM h_s),
kw AS MATERIALIZED (SELECT query_id, doc_id, rank, 1 AS li FROM ({_BEST} QUALIFY rank <= 50)),
dv AS MATERIALIZED (SELECT doc_id, {_V} AS v FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL)),
qv AS MATERIALIZED (SELECT query_id, {_V} AS v FROM (SELECT item_id AS query_id, sha256('query: ' || query) AS h FROM eval_examples WHERE query IS NOT NULL)),
nn AS MATERIALIZED (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, 2 AS li FROM (SELECT query_id, doc_id, round(list_cosine_similarity(qv.v, dv.v), 6) AS score FROM qv, dv) QUALIFY rank <= 50),
fused AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f.li, f.rank, doc_id) AS rank
  FROM (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min({{'li': li, 'rank': rank}}) AS f FROM (SELECT * FROM kw UNION ALL SELECT * FROM nn) GROUP BY ALL)),
x AS MATERIALIZED (SELECT query_id, doc_id, arxiv_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, list_transform(list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\s\\p{{Z}}\\x{{85}}\\x0b]+'), lambda w: w <> '')), lambda w: hash(w)) AS w FROM fused JOIN documents USING (doc_id)),
walk AS (SELECT query_id, 0::BIGINT AS rank, []::BIGINT[] AS ids, []::UBIGINT[][] AS kept FROM x GROUP BY query_id
 UNION ALL SELECT x.query_id, x.rank, CASE WHEN bad THEN ids ELSE list_append(ids, x.doc_id) END, CASE WHEN bad THEN kept ELSE list_append(kept, x.w) END
 FROM (SELECT walk.query_id AS query_id, walk.ids AS ids, walk.kept AS kept, x AS x,
   len(x.w) = 0 OR len(list_filter(walk.kept, lambda k: len(list_intersect(k, x.w)) / (len(k) + len(x.w) - len(list_intersect(k, x.w)))::DOUBLE >= 0.9)) > 0 AS bad FROM walk JOIN x ON x.query_id = walk.query_id AND x.rank = walk.rank + 1)),
e AS (SELECT query_id, unnest(ids) AS chunk_id, unnest(range(1, len(ids) + 1)) AS rank FROM walk QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY walk.rank DESC) = 1),
c AS (SELECT e.*, row_number() OVER (PARTITION BY query_id, arxiv_id ORDER BY rank) AS n FROM e JOIN documents ON doc_id = chunk_id QUALIFY n <= 3)
SELECT query_id, chunk_id, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM c) WHERE place <= 10""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25 without stemming and nearest vectors, fused, without near copies, three a paper, the ten best."""
    chunks, questions = _searched(spark, d)
    return retrieval.search(chunks, questions, retrieval.Search(stem=False))


# ---- context and answers ----------------------------------------------------------------------
_PLACE = "CASE WHEN section IS NULL THEN 'body' ELSE concat_ws(' > ', section, subsection) END"
_DRAWN = f"""'[P1] ' || coalesce(title, '') || ' (' || (CASE coalesce(len(authors), 0) WHEN 0 THEN 'unknown' WHEN 1 THEN authors[1] ELSE authors[1] || ' et al.' END) || ', ' || coalesce(left(published_at, 4), 'n.d.') || ')' || ' — ' || {_PLACE} || chr(10) || coalesce(text, '')"""
_PACKED = f"""k AS (SELECT query_id, chunk_id, arxiv_id, version, score, {_PLACE} AS place, {_tokens_sql('drawn')} AS cost FROM (SELECT *, {_DRAWN} AS drawn FROM retrieved_chunks)),
one AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC NULLS LAST, cost DESC NULLS LAST, place DESC, arxiv_id DESC, version DESC) = 1),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id) AS rank FROM one),
walk AS (SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS used, false AS kept FROM x GROUP BY query_id
 UNION ALL SELECT x.query_id, x.rank, CASE WHEN walk.used + x.cost > 3000 THEN walk.used ELSE walk.used + x.cost END, walk.used + x.cost <= 3000 FROM walk JOIN x ON x.query_id = walk.query_id AND x.rank = walk.rank + 1),
f AS (SELECT x.*, walk.used, min(x.rank) OVER (PARTITION BY x.query_id, x.arxiv_id, x.version) AS first FROM walk JOIN x USING (query_id, rank) WHERE walk.kept),
packed AS (SELECT *, 'P' || dense_rank() OVER (PARTITION BY query_id ORDER BY first) AS label FROM f)"""


def _offered(spark: SparkSession, d: str) -> DataFrame:
    """Each query's chunks once, by score, with place and cost; texts are read and left behind."""
    names = ["score", "cost", "place", "arxiv_id", "version"]
    rows = context.costed(table(spark, d, "retrieved_chunks")).groupBy("query_id", "chunk_id").agg(F.max(F.struct(*names)).alias("x")).select("query_id", "chunk_id", "x.*")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")).cast("long"))


@query(f"WITH RECURSIVE {_PACKED} SELECT query_id, chunk_id, rank, label, cost, used FROM packed")
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    return context.pack(_offered(spark, d)).select("query_id", "chunk_id", "rank", "label", F.col("cost").cast("long").alias("cost"), "used")


@query(f"""WITH RECURSIVE {_PACKED}, s AS (SELECT query_id, label, place, min(rank) AS r FROM packed GROUP BY ALL)
SELECT query_id, label, arxiv_id, CAST(version AS INTEGER) AS version, string_agg(chunk_id, ',' ORDER BY rank) AS chunk_ids,
 (SELECT string_agg(place, '; ' ORDER BY r) FROM s WHERE s.query_id = p.query_id AND s.label = p.label) AS sections FROM packed p GROUP BY query_id, label, arxiv_id, version""")
def context_citations(spark: SparkSession, d: str) -> DataFrame:
    return context.citations(context.pack(_offered(spark, d)))


@query(f"""WITH RECURSIVE {_PACKED}, n AS (SELECT query_id, count(*) AS offered FROM x GROUP BY ALL), m AS (SELECT query_id, count(*) AS included, sum(cost)::BIGINT AS used, count(DISTINCT label) AS labels FROM packed GROUP BY ALL)
SELECT query_id, coalesce(included, 0) AS included, offered - coalesce(included, 0) AS dropped, offered > coalesce(included, 0) AS truncated, coalesce(used, 0) AS used, coalesce(labels, 0) AS labels FROM n LEFT JOIN m USING (query_id)""")
def context_totals(spark: SparkSession, d: str) -> DataFrame:
    offered = _offered(spark, d)
    return context.totals(offered, context.pack(offered))


# answers made from the questions: labels alone and shared, in other spellings, without a source, malformed, and refusals
_REPLY = """CASE WHEN item_id % 10 = 3 THEN ' INSUFFICIENT_EVIDENCE' WHEN item_id % 10 = 4 THEN NULL ELSE query || ' [P' || (item_id % 6) || '] and  [p 2, P0' || (item_id % 9) || '] see [note] or [P' || (item_id % 6) || ', P1] [' || (item_id % 7) || ']' END"""
_READ = f"""b AS (SELECT item_id, {_REPLY} AS text FROM eval_examples), br AS (SELECT item_id, text, regexp_extract_all(coalesce(text, ''), '\\[([^\\[\\]]{{1,60}})\\]', 1) AS br FROM b),
lb AS (SELECT item_id, text, list_transform(list_filter(flatten(list_transform(br, lambda x: regexp_extract_all(x, '(?i)\\bP\\s?(\\d+)\\b', 1))), lambda n: true), lambda n: 'P' || n::BIGINT) AS all_labels,
  list_filter(br, lambda x: regexp_full_match(x, '(?i)\\s*((paper|source|ref|reference|citation)\\s*)?\\d+\\s*')) AS malformed FROM br),
a AS (SELECT item_id, text, malformed, list_filter(all_labels, lambda x, i: list_position(all_labels, x) = i) AS labels, ['P1', 'P2', 'P3'] AS supplied FROM lb),
q AS (SELECT *, list_filter(supplied, lambda x: list_contains(labels, x)) AS used, list_filter(labels, lambda x: NOT list_contains(supplied, x)) AS invented, list_filter(supplied, lambda x: NOT list_contains(labels, x)) AS uncited,
  coalesce(contains(text, 'INSUFFICIENT_EVIDENCE') AND length(trim(text)) < 221, false) AS refused FROM a)"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    n = lambda m: (i % m).cast("string")
    text = F.concat(F.col("query"), F.lit(" [P"), n(6), F.lit("] and  [p 2, P0"), n(9), F.lit("] see [note] or [P"), n(6), F.lit(", P1] ["), n(7), F.lit("]"))
    text = F.when(i % 10 == 3, F.lit(" INSUFFICIENT_EVIDENCE")).when(i % 10 == 4, F.lit(None)).otherwise(text)
    return table(spark, d, "eval_examples").select("item_id", "query", text.alias("text"), F.array(F.lit("P1"), F.lit("P2"), F.lit("P3")).alias("supplied"))


_JOINED = ", ".join(f"array_to_string({c}, ',') AS {c}" for c in ("used", "invented", "malformed", "uncited"))


@query(f"WITH {_READ} SELECT item_id, {_JOINED}, len(invented) = 0 AS grounded, refused FROM q")
def citation_check(spark: SparkSession, d: str) -> DataFrame:
    rows = context.check_answers(_answers(spark, d))
    return rows.select("item_id", *[F.array_join(c, ",").alias(c) for c in ("used", "invented", "malformed", "uncited")], "grounded", "refused")


@query(f"""WITH {_READ}, s AS (SELECT item_id, text, invented, list_reduce(list_prepend(text, invented), lambda t, x:
  regexp_replace(regexp_replace(regexp_replace(t, '(?i)\\[\\s*' || x || '\\s*\\]', '', 'g'), '(?i)\\[\\s*' || x || '\\s*[,;]\\s*', '[', 'g'), '(?i)\\s*[,;]\\s*' || x || '\\s*\\]', ']', 'g')) AS t FROM q)
SELECT item_id, CASE WHEN len(invented) = 0 THEN text ELSE regexp_replace(regexp_replace(t, '[ \\t]{{2,}}', ' ', 'g'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') END AS stripped FROM s""")
def strip_invented(spark: SparkSession, d: str) -> DataFrame:
    """Every answer without the labels that no source stands behind."""
    return context.check_answers(_answers(spark, d)).select("item_id", T.strip_labels(F.col("text"), F.col("invented")).alias("stripped"))


@query(f"""WITH {_READ}, e AS (SELECT item_id, item_id % 4 = 1 AS empty FROM eval_examples WHERE length(trim(query)) > 0),
j AS (SELECT q.*, empty, empty OR refused AS no, item_id % 8 = 2 AS cut FROM e JOIN q USING (item_id))
SELECT item_id, CASE WHEN NOT no THEN regexp_replace(text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') END AS text, no AS refused, CASE WHEN empty THEN 'no_evidence' WHEN refused THEN 'model_declined' END AS refusal_reason,
 CASE WHEN no THEN '' ELSE array_to_string(used, ',') END AS used, CASE WHEN empty THEN '' WHEN refused THEN 'P1,P2,P3' ELSE array_to_string(uncited, ',') END AS uncited, no OR len(invented) = 0 AS grounded,
 NOT no AND (len(invented) > 0 OR len(malformed) > 0 OR cut) AS has_problems FROM j""")
def answer_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Checked answers of all questions; a quarter has no context, some replies ran out of tokens."""
    rows = _answers(spark, d)
    i = F.col("query_id")
    asked = rows.select(F.col("item_id").alias("query_id"), F.col("query").alias("question"), "supplied").withColumn("context", F.when(i % 4 != 1, F.lit("[P1] a passage"))).withColumn("truncated", i % 2 == 0)
    replies = rows.select(F.col("item_id").alias("query_id"), "text").withColumn("finish_reason", F.when(i % 8 == 2, "length").otherwise("stop"))
    out = context.answers(asked, replies)
    return out.select(i.alias("item_id"), "text", "refused", "refusal_reason", *[F.array_join(c, ",").alias(c) for c in ("used", "uncited")], "grounded", "has_problems")


# ---- evaluation -------------------------------------------------------------------------------
def _qrels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "retrieved_chunks").where("rerank_score >= 0.7").select("query_id", F.col("arxiv_id").alias("doc")).distinct()


_EVAL = f"""{_RANKED}, pr AS (SELECT query_id, arxiv_id AS doc, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), arxiv_id) AS rank FROM r GROUP BY query_id, arxiv_id),
qr AS (SELECT DISTINCT query_id, arxiv_id AS doc FROM retrieved_chunks WHERE rerank_score >= 0.7), h AS (SELECT qr.query_id, qr.doc, pr.rank FROM qr LEFT JOIN pr USING (query_id, doc)),
m AS (SELECT query_id, {", ".join(f"round(count(*) FILTER (rank <= {k}) / {k}::DOUBLE, 6) AS precision_{k}, round(count(*) FILTER (rank <= {k}) / count(*)::DOUBLE, 6) AS recall_{k}, round(coalesce(sum(1 / log2(rank + 1.0::DOUBLE)) FILTER (rank <= {k}), 0) / list_sum(list_transform(range(1, least(count(*), {k}) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))), 6) AS ndcg_{k}, CASE WHEN count(*) FILTER (rank <= {k}) > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit_{k}" for k in (1, 3, 5, 10))},
 round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS mrr FROM h GROUP BY query_id)"""


@query(f"WITH {_EVAL} SELECT * FROM m")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.query_metrics(evaluation.paper_ranking(_ranked(spark, d)), _qrels(spark, d))


@query(f"WITH {_EVAL} SELECT left(query_id, 8) AS category, count(*) AS queries, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(mrr), 6) AS mrr FROM m GROUP BY ROLLUP (left(query_id, 8))")
def eval_rollup(spark: SparkSession, d: str) -> DataFrame:
    metrics = evaluation.query_metrics(evaluation.paper_ranking(_ranked(spark, d)), _qrels(spark, d)).select("query_id", "ndcg_10", "mrr")
    return evaluation.macro(metrics, metrics.select("query_id", F.left("query_id", F.lit(8)).alias("category")))


@query(f"WITH {_EVAL} SELECT query_id FROM (SELECT query_id, bool_or(rank <= 3) AS f FROM h GROUP BY query_id) WHERE NOT coalesce(f, false)")
def eval_misses(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.misses(evaluation.paper_ranking(_ranked(spark, d)).where("rank <= 3"), _qrels(spark, d))


_BY_LIST = """ls AS (SELECT query_id, arxiv_id AS doc, li, row_number() OVER (PARTITION BY query_id, li ORDER BY min(rank), arxiv_id) AS rank FROM (SELECT query_id, arxiv_id, CASE c.retriever WHEN 'keyword' THEN 'keyword' ELSE 'vector' END AS li, c.rank AS rank
  FROM (SELECT query_id, arxiv_id, unnest(contributions) AS c FROM retrieved_chunks)) GROUP BY query_id, arxiv_id, li)"""


def _runs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Two configurations: the keyword and the vector list of every query."""
    rows = table(spark, d, "retrieved_chunks").select("query_id", "arxiv_id", F.explode("contributions").alias("c")).select("query_id", "arxiv_id", "c.rank", "c.retriever")
    return {name: rows.where(F.col("retriever") == "keyword" if name == "keyword" else F.col("retriever") != "keyword") for name in ("keyword", "vector")}


@query(f"""WITH {_EVAL}, {_BY_LIST}, b AS (SELECT query_id, doc, min(rank) AS best_rank, count(DISTINCT li) AS configs, string_agg(li || '=' || rank, ' ' ORDER BY li || '=' || rank) AS ranks FROM ls WHERE rank <= 10 AND (query_id, doc) NOT IN (SELECT query_id, doc FROM qr) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_rank, doc) AS place FROM b QUALIFY place <= 10""")
def eval_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Unjudged papers near the top of the keyword or the vector list, ten a query; the cut is the feature."""
    both = reduce(DataFrame.unionByName, [evaluation.paper_ranking(r).withColumn("config", F.lit(n)) for n, r in _runs(spark, d).items()])
    return evaluation.candidate_labels(both, _qrels(spark, d))


_METRICS = ", ".join(f"round(count(*) FILTER (rank <= {k}) / {k}::DOUBLE, 6) AS precision_{k}, round(count(*) FILTER (rank <= {k}) / count(*)::DOUBLE, 6) AS recall_{k}, round(coalesce(sum(1 / log2(rank + 1.0::DOUBLE)) FILTER (rank <= {k}), 0) / list_sum(list_transform(range(1, least(count(*), {k}) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))), 6) AS ndcg_{k}" for k in (5, 10))


@query(f"""WITH qr AS (SELECT DISTINCT query_id, arxiv_id AS doc FROM retrieved_chunks WHERE rerank_score >= 0.7), {_BY_LIST}, cf AS (SELECT unnest(['keyword', 'vector']) AS li),
m AS (SELECT query_id, li AS config, {_METRICS}, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS mrr FROM (SELECT qr.query_id, qr.doc, cf.li FROM qr, cf) LEFT JOIN ls USING (query_id, doc, li) GROUP BY query_id, li)
SELECT config, left(query_id, 3) AS category, count(*) AS queries, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(precision_10), 6) AS precision_10, round(avg(mrr), 6) AS mrr FROM m GROUP BY GROUPING SETS ((config), (config, left(query_id, 3)))""")
def eval_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Means of two configurations over the same judgements, overall and by category (here the query id's first letters)."""
    qrels = _qrels(spark, d)
    examples = qrels.select("query_id").distinct().withColumn("category", F.left("query_id", F.lit(3)))
    return evaluation.sweep(_runs(spark, d), examples, qrels).select("config", "category", "queries", "recall_5", "recall_10", "ndcg_10", "precision_10", "mrr")


@query(f"WITH {_EVAL} SELECT doc, count(*) AS queries FROM qr WHERE doc NOT IN (SELECT arxiv_id FROM arxiv_papers WHERE arxiv_id IS NOT NULL AND version > 1) GROUP BY doc")
def eval_missing(spark: SparkSession, d: str) -> DataFrame:
    """Judged papers that a corpus of revised papers does not hold."""
    return evaluation.missing_labels(_qrels(spark, d), table(spark, d, "arxiv_papers").where("version > 1").select(F.col("arxiv_id").alias("doc")))


@query("SELECT category, count(*) AS items, count(*) FILTER (reviewed) AS reviewed_items, bool_and(reviewed) AS fully_reviewed FROM eval_examples GROUP BY category")
def eval_review(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.review_summary(table(spark, d, "eval_examples"), "category", "reviewed")


@query("""SELECT event_type AS grp, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(min(value), 6) AS least, round(max(value), 6) AS most,
  round(list_sort(list(value))[least(count(*), CAST(floor(count(*) * 0.9::DOUBLE) AS BIGINT) + 1)], 6) AS p90 FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.latency(table(spark, d, "events"), "event_type", "value")


# ---- state ------------------------------------------------------------------------------------
@query("""WITH one AS (SELECT arxiv_id, version, record_id, harvested_at FROM arxiv_papers QUALIFY row_number() OVER (PARTITION BY arxiv_id, version ORDER BY record_id) = 1),
old AS (SELECT DISTINCT arxiv_id, version FROM arxiv_papers WHERE version = 1 AND record_id % 2 = 0), f AS (SELECT one.* FROM one ANTI JOIN old USING (arxiv_id, version)),
k AS (SELECT f.arxiv_id, version, CASE WHEN arxiv_id IN (SELECT arxiv_id FROM old) THEN 'UPDATED' WHEN row_number() OVER (PARTITION BY arxiv_id ORDER BY record_id, version) = 1 THEN 'CREATED' ELSE 'UPDATED' END AS outcome FROM f),
b AS (SELECT arxiv_id, version, outcome FROM k UNION ALL SELECT arxiv_id, version, NULL FROM old)
SELECT arxiv_id, CAST(version AS BIGINT) AS version, outcome, version = max(version) OVER (PARTITION BY arxiv_id) AS is_latest FROM b""")
def upsert_papers(spark: SparkSession, d: str) -> DataFrame:
    """An upsert of all records over a store that already has some first versions."""
    rows = table(spark, d, "arxiv_papers").select("arxiv_id", "version", "record_id")
    old = rows.where("version = 1 AND record_id % 2 = 0").select("arxiv_id", "version").distinct()
    return state.upsert(old, rows, "arxiv_id", "version", "record_id").select("arxiv_id", F.col("version").cast("long").alias("version"), "outcome", "is_latest")


_PEOPLE = """p AS (SELECT record_id, generate_subscripts(authors, 1) - 1 AS pos, unnest(authors) AS full_name FROM arxiv_papers),
k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(full_name), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS normalized_name FROM p WHERE full_name IS NOT NULL)"""


@query(f"""WITH {_PEOPLE}, m AS (SELECT record_id, normalized_name, min(pos) AS pos FROM k WHERE normalized_name <> '' GROUP BY ALL)
SELECT record_id, normalized_name, row_number() OVER (PARTITION BY record_id ORDER BY pos) - 1 AS position FROM m""")
def author_positions(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "arxiv_papers")
    return state.get_or_create_authors(papers, "record_id", "authors", table(spark, d, "authors"))[1]


@query(f"""WITH {_PEOPLE}, f AS (SELECT normalized_name, full_name FROM k WHERE normalized_name <> '' QUALIFY row_number() OVER (PARTITION BY normalized_name ORDER BY record_id, pos, full_name) = 1)
SELECT normalized_name, full_name FROM f WHERE normalized_name NOT IN (SELECT normalized_name FROM authors WHERE author_id % 3 = 0)""")
def author_creation(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "authors").where("author_id % 3 = 0")  # the store before the run
    return state.get_or_create_authors(table(spark, d, "arxiv_papers"), "record_id", "authors", stored)[0]


@query("SELECT event_type, max(ts) AS ts, arg_max(user_id, (ts, -event_id)) AS user_id FROM events GROUP BY event_type")
def checkpoint_advance(spark: SparkSession, d: str) -> DataFrame:
    """The marks after all events, over those of an earlier batch."""
    events = table(spark, d, "events")
    none = events.limit(0).select("event_type", "ts", "user_id")
    old = state.advance(none, events.where("event_id < 100"), "event_type", "ts", "user_id", "event_id")
    return state.advance(old, events, "event_type", "ts", "user_id", "event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 10:30:00' AND ts < TIMESTAMP '2024-01-09 00:16:00'")
def backfill_window(spark: SparkSession, d: str) -> DataFrame:
    at = lambda t: F.lit(t).cast("timestamp")
    return state.backfill(table(spark, d, "events"), "ts", at("2024-01-05 10:30:40"), at("2024-01-09 00:15:20")).select("event_id")


@query("SELECT event_id, event_type FROM events WHERE ts >= (SELECT date_trunc('minute', min(ts) + (max(ts) - min(ts)) / 2) FROM events)")
def incremental_filter(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    lo, hi = events.agg(F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.max("ts").cast("timestamp"))).first()
    mark = F.timestamp_micros(F.lit(lo + (hi - lo) // 2))
    return state.due_since(events, "ts", mark).select("event_id", "event_type")


_STATUS = "s AS (SELECT event_id, event_type, CAST(event_id % 4 AS INTEGER) AS attempts, 3 AS max_attempts, CASE WHEN event_id % 7 = 0 THEN 'INDEXED' ELSE 'CHUNKED' END AS stage, CASE WHEN event_id % 3 = 0 THEN ts END AS next_retry_at FROM events)"


def _status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", "event_type", (F.col("event_id") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), F.when(F.col("event_id") % 7 == 0, "INDEXED").otherwise("CHUNKED").alias("stage"),
        F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("timestamp")).alias("next_retry_at"), F.repeat(F.lit("boom "), (F.col("event_id") % 600).cast("int")).alias("last_error"),
    )


@query(f"WITH {_STATUS} SELECT event_id FROM s WHERE stage NOT IN ('INDEXED', 'FAILED') AND attempts < max_attempts AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '2024-01-10')")
def due_documents(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    return _status(spark, d).where(state.needs_work(F.col("stage"), F.col("attempts"), F.col("max_attempts"), F.col("next_retry_at"), now)).select("event_id")


@query(f"""WITH {_STATUS} SELECT event_id, CAST(attempts + 1 AS BIGINT) AS attempts, CASE WHEN attempts + 1 >= max_attempts THEN 'FAILED' ELSE stage END AS stage, CAST(least(event_id % 600 * 5, 2000) AS BIGINT) AS kept,
 CASE WHEN attempts + 1 < max_attempts THEN CAST(least(60 * pow(2, attempts), 3600) AS BIGINT) END AS wait FROM s""")
def retry_state(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    rows = state.after_failure(_status(spark, d), "last_error", now)
    return rows.select("event_id", F.col("attempts").cast("long").alias("attempts"), "stage", F.length("last_error").cast("long").alias("kept"), (F.unix_seconds("next_retry_at") - F.unix_seconds(now)).alias("wait"))


@query(f"WITH {_STATUS} SELECT event_id, least(event_id % 600 * 5, 4000) AS kept FROM s WHERE attempts >= max_attempts OR attempts >= 1 AND event_id % 5 <> 0")
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """Spent documents; one whose paper was never stored is spent after one attempt."""
    rows = _status(spark, d).withColumn("stored", F.col("event_id") % 5 == 0)
    return state.dead_letters(rows, "last_error", "stored").select("event_id", F.length("last_error").cast("long").alias("kept"))


@query(f"""WITH {_STATUS}, r AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'INDEXED' ELSE 'EMBEDDED' END AS new_stage FROM s WHERE event_id % 2 = 0)
SELECT event_id, coalesce(new_stage, stage) AS stage, CAST(attempts AS BIGINT) AS attempts, CASE WHEN new_stage IS DISTINCT FROM 'INDEXED' THEN floor(epoch(next_retry_at) - epoch(TIMESTAMP '2024-01-01'))::BIGINT END AS retry_at, new_stage IS DISTINCT FROM 'INDEXED' AS has_error FROM s LEFT JOIN r USING (event_id)""")
def stage_advance(spark: SparkSession, d: str) -> DataFrame:
    status = _status(spark, d).select("event_id", "stage", "attempts", "max_attempts", "next_retry_at", "last_error")
    reached = status.where("event_id % 2 = 0").select("event_id", F.when(F.col("event_id") % 4 == 0, "INDEXED").otherwise("EMBEDDED").alias("new_stage"))
    out = state.advance_stage(status, reached, "event_id")
    return out.select("event_id", "stage", F.col("attempts").cast("long").alias("attempts"), (F.unix_seconds("next_retry_at") - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))).alias("retry_at"), F.col("last_error").isNotNull().alias("has_error"))


@query(f"""WITH {_STATUS} SELECT (SELECT count(*) FROM arxiv_papers) AS papers, (SELECT count(*) FROM arxiv_papers WHERE version = 1) AS latest, (SELECT count(*) FROM retrieved_chunks) AS chunks,
 (SELECT count(*) FROM retrieved_chunks WHERE rerank_score IS NULL) AS unindexed, (SELECT count(*) FROM s WHERE attempts >= 3 AND event_id % 2 = 0) AS unresolved, (SELECT count(*) FROM s WHERE stage = 'INDEXED') AS indexed_documents""")
def pipeline_status(spark: SparkSession, d: str) -> DataFrame:
    """The six counts of a status report, over tables that stand in for those of a pipeline."""
    status = _status(spark, d)
    failures = status.where("attempts >= 3").select(F.when(F.col("event_id") % 2 == 1, F.lit(1)).alias("resolved_at"))
    papers = table(spark, d, "arxiv_papers").select((F.col("version") == 1).alias("is_latest"))
    return state.pipeline_status(papers, table(spark, d, "retrieved_chunks").select(F.col("rerank_score").alias("indexed_at")), failures, status)


_CHUNKS = "c AS (SELECT chunk_id, any_value(arxiv_id) AS arxiv_id, any_value(version) AS version, any_value(chunk_index) AS chunk_index, max(text) AS text FROM retrieved_chunks GROUP BY chunk_id)"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "retrieved_chunks")
    return rows.groupBy("chunk_id").agg(*[F.max(c).alias(c) for c in ("arxiv_id", "version", "chunk_index", "text")])


@query(f"""WITH {_CHUNKS}, p AS (SELECT arxiv_id, version, max(primary_category) AS primary_category FROM arxiv_papers GROUP BY ALL)
SELECT arxiv_id || 'v' || version || ':' || chunk_index AS chunk_id, sha256(text) AS content_hash, length(text) AS char_count, primary_category FROM c JOIN p USING (arxiv_id, version)""")
def index_documents(spark: SparkSession, d: str) -> DataFrame:
    """Index documents of all chunks whose paper is known."""
    papers = table(spark, d, "arxiv_papers").groupBy("arxiv_id", "version").agg(F.max("primary_category").alias("primary_category"))
    return state.chunk_documents(_chunks(spark, d).drop("chunk_id"), papers).select("chunk_id", "content_hash", "char_count", "primary_category")


@query(f"WITH {_CHUNKS} SELECT version % 2 = 0 AS acknowledged, count(*) FILTER (version % 2 <> 0) AS unindexed FROM c GROUP BY 1")
def mark_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Chunks still unindexed after those of even versions were acknowledged."""
    rows = state.replace_chunks(_chunks(spark, d).withColumn("indexed_at", F.lit(None).cast("timestamp")), _chunks(spark, d), ["arxiv_id", "version"])
    marked = state.mark_indexed(rows, rows.where("version % 2 = 0"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return marked.groupBy((F.col("version") % 2 == 0).alias("acknowledged")).agg(F.count_if(F.col("indexed_at").isNull()).cast("long").alias("unindexed"))


@query(f"WITH {_CHUNKS} SELECT count(*) AS chunks, count(DISTINCT arxiv_id) AS papers FROM c WHERE NOT (arxiv_id = '2310.00999' AND version = 2)")
def delete_by_paper(spark: SparkSession, d: str) -> DataFrame:
    rest = state.delete_by_paper(_chunks(spark, d), F.lit("2310.00999"), F.lit(2))
    return rest.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("arxiv_id").alias("papers"))


@query("SELECT doc_id, length(text) AS char_count FROM documents")
def save_texts(spark: SparkSession, d: str) -> DataFrame:
    """Character counts after every text was stored over an older one."""
    rows = table(spark, d, "documents").select("doc_id", "text")
    old = rows.select("doc_id", F.lit("old").alias("text"), F.lit(3).cast("long").alias("char_count"))
    return state.save_texts(old, rows, "doc_id", "text").select("doc_id", "char_count")


@query("""SELECT CASE event_id % 5 WHEN 0 THEN '<unknown>' WHEN 3 THEN '<unknown>' ELSE 'c' || event_id END AS chunk_id, ['connection lost', 'busy', 'bad vector', 'unspecified error', 'odd'][event_id % 5 + 1] AS reason,
 [NULL, 429, 400, 503, NULL][event_id % 5 + 1]::BIGINT AS status, event_id % 5 <> 2 AS retryable FROM events""")
def index_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failures read from the entries of a bulk response."""
    i = F.col("event_id")
    form = lambda f: F.format_string(f, i)
    item = F.when(i % 5 == 0, F.lit("connection lost")).when(i % 5 == 1, form('{"index":{"_id":"c%d","status":429,"error":{"reason":"busy"}}}')).when(i % 5 == 2, form('{"index":{"_id":"c%d","status":400,"error":{"reason":"bad vector"}}}'))
    item = item.when(i % 5 == 3, F.lit('{"index":{"status":503}}')).otherwise(form('{"index":{"_id":"c%d","error":"odd"}}'))
    return state.parse_failures(table(spark, d, "events").select(item.alias("item"))).withColumn("status", F.col("status").cast("long"))


@query("""SELECT event_type, count(*) FILTER (value > 90) AS failed, count(*) FILTER (value <= 90 AND user_id % 3 = 0) AS accepted, count(*) FILTER (value <= 90 AND user_id % 3 = 1) AS updated,
 count(*) FILTER (value <= 90 AND user_id % 3 = 2) AS skipped, CASE WHEN count(*) FILTER (value > 90) > 0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS status FROM events GROUP BY event_type""")
def run_outcomes(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.element_at(F.array(F.lit("CREATED"), F.lit("UPDATED"), F.lit("SKIPPED")), (F.col("user_id") % 3 + 1).cast("int"))
    rows = table(spark, d, "events").select("event_type", F.when(F.col("value") > 90, F.lit("late")).alias("error"), kinds.alias("outcome"))
    return state.count_outcomes(rows, "event_type").withColumn("status", state.run_status(F.lit(None).cast("string"), F.col("failed")))


# ---- structure --------------------------------------------------------------------------------
@query("SELECT section_id, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t\\n\\f\\r\\x0b]*\\n+'), lambda p: regexp_replace(p, '^[\\s\\p{Z}\\x0b]+|[\\s\\p{Z}\\x0b]+$', '', 'g')), lambda p: p <> '')) AS BIGINT) AS paragraphs FROM sections WHERE text IS NOT NULL")
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").where(F.col("text").isNotNull()).select("section_id", F.size(chunking.split_paragraphs(F.col("text"))).cast("long").alias("paragraphs"))


_ABBREVIATIONS = "|".join(a.replace(".", "\\.") for a in chunking.ABBREVIATIONS)


@query(f"""WITH p AS (SELECT section_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '([.!?])[\\s\\p{{Z}}]+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: true) AS p FROM sections WHERE text IS NOT NULL),
u AS (SELECT section_id, unnest(p) AS piece, unnest(range(0, len(p))) AS k FROM p),
g AS (SELECT *, sum(CASE WHEN k = 0 OR NOT regexp_matches(before, '({_ABBREVIATIONS})$') THEN 1 ELSE 0 END) OVER (PARTITION BY section_id ORDER BY k) AS n FROM (SELECT *, lag(piece) OVER (PARTITION BY section_id ORDER BY k) AS before FROM u)),
j AS (SELECT section_id, n, string_agg(piece, ' ' ORDER BY k) AS sentence FROM g GROUP BY ALL)
SELECT section_id, CAST(row_number() OVER (PARTITION BY section_id ORDER BY n) - 1 AS INTEGER) AS pos, sentence FROM j WHERE regexp_replace(sentence, '[\\s\\p{{Z}}]+', '', 'g') <> ''""")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").where(F.col("text").isNotNull()).select("section_id", F.posexplode(chunking.split_sentences(F.col("text"))).alias("pos", "sentence"))


_UPPER = lambda x: f"(regexp_matches({x}, '\\p{{L}}') AND NOT regexp_matches({x}, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]'))"
_SHOWN = lambda x: f"(CASE WHEN {_UPPER(x)} THEN array_to_string(list_transform(regexp_extract_all(regexp_replace({x}, '[.,;:]+$', ''), '\\p{{L}}+|\\P{{L}}+'), lambda r: r[1] || lower(r[2:])), '') ELSE regexp_replace({x}, '[.,;:]+$', '') END)"
_NAME = lambda x: f"trim(regexp_replace(lower(regexp_replace({x}, '[.,;:]+$', '')), '[\\s\\p{{Z}}]+', ' ', 'g'))"
_IN = ", ".join(f"'{x}'" for x in (*chunking.KINDS, *chunking.BODY_HEADINGS))
_KIND = lambda x: "(CASE " + " ".join(f"WHEN {_NAME(x)} = '{k}' THEN '{v}'" for k, v in chunking.KINDS.items()) + " " + " ".join(f"WHEN starts_with({_NAME(x)}, '{k} ') OR starts_with({_NAME(x)}, '{k}:') THEN '{v}'" for k, v in chunking.KINDS.items()) + " ELSE 'body' END)"
_LABEL = lambda t: f"(regexp_matches({t}, '^\\p{{Lu}}') AND NOT regexp_matches({t}, '[.?!,;:]$') AND len(regexp_extract_all({t}, '[^\\s\\p{{Z}}]+')) <= 12)"


@query(f"""WITH t AS (SELECT extraction_id, string_split(replace(text, chr(12), chr(10)), chr(10)) AS ls FROM extractions WHERE text IS NOT NULL),
u AS (SELECT extraction_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS k FROM t), x AS (SELECT *, regexp_replace(line, '^[\\s\\p{{Z}}\\x{{85}}\\x0b]+|[\\s\\p{{Z}}\\x{{85}}\\x0b]+$', '', 'g') AS x FROM u),
r AS (SELECT *, length(x) BETWEEN 3 AND 90 AS fit, regexp_extract(x, '(?i)^appendix\\s+([A-Z])\\b[.:]?\\s*(.*)$', 1) AS al, regexp_extract(x, '(?i)^appendix\\s+([A-Z])\\b[.:]?\\s*(.*)$', 2) AS rest,
 regexp_extract(x, '^(\\d{{1,2}}(?:\\.\\d{{1,2}}){{0,3}})\\.?\\s+(\\S.*)$', 1) AS nn, regexp_extract(x, '^(\\d{{1,2}}(?:\\.\\d{{1,2}}){{0,3}})\\.?\\s+(\\S.*)$', 2) AS nt,
 regexp_extract(x, '(?i)^([IVXL]{{1,6}})\\.\\s+(\\S.*)$', 1) AS rn, regexp_extract(x, '(?i)^([IVXL]{{1,6}})\\.\\s+(\\S.*)$', 2) AS rt FROM x),
w AS (SELECT *, CASE WHEN NOT fit THEN 0 WHEN al <> '' THEN 1 WHEN nn <> '' AND {_LABEL('nt')} THEN 2 WHEN rn <> '' AND {_LABEL('rt')} THEN 3
 WHEN {_NAME('x')} IN ({_IN}) OR {_UPPER('x')} AND len(regexp_extract_all(x, '[^\\s\\p{{Z}}]+')) BETWEEN 2 AND 8 THEN 4 ELSE 0 END AS rule FROM r),
h AS (SELECT *, CASE rule WHEN 1 THEN 'Appendix ' || al || CASE WHEN rest IN ('', 'Appendix') THEN '' ELSE ': ' || rest END WHEN 2 THEN {_SHOWN('nt')} WHEN 3 THEN {_SHOWN('rt')} WHEN 4 THEN {_SHOWN('x')} END AS title,
 CASE rule WHEN 1 THEN 'appendix' WHEN 2 THEN {_KIND('nt')} WHEN 3 THEN {_KIND('rt')} WHEN 4 THEN {_KIND('x')} END AS kind, CASE WHEN rule = 2 THEN len(string_split(nn, '.')) WHEN rule > 0 THEN 1 END AS level FROM w),
s AS (SELECT *, count(title) OVER (PARTITION BY extraction_id ORDER BY k) AS sec, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER (PARTITION BY extraction_id ORDER BY k) AS top FROM h),
g AS (SELECT extraction_id, sec, max(title) AS title, max(kind) AS kind, max(level) AS level, min(top) FILTER (title IS NOT NULL) AS top, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (title IS NULL), '') AS body FROM s GROUP BY ALL)
SELECT extraction_id, row_number() OVER (PARTITION BY extraction_id ORDER BY sec) - 1 AS section_index, title, CASE WHEN level > 1 THEN top END AS parent, CAST(coalesce(level, 1) AS INTEGER) AS level, coalesce(kind, 'title') AS kind,
 CAST(length(regexp_replace(body, '^[\\s\\p{{Z}}\\x{{85}}\\x0b]+|[\\s\\p{{Z}}\\x{{85}}\\x0b]+$', '', 'g')) AS INTEGER) AS chars FROM g WHERE title IS NOT NULL OR regexp_replace(body, '[\\s\\p{{Z}}\\x{{85}}\\x0b]+', '', 'g') <> ''""")
def section_split(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sections(spread(table(spark, d, "extractions").select("extraction_id", "text")), "extraction_id", "text").select(F.col("doc").alias("extraction_id"), "section_index", "title", "parent", "level", "kind", F.length("text").alias("chars"))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """All passages of all texts; a fold that SQL cannot express, tested against a plain one."""
    return chunking.chunk_texts(table(spark, d, "extractions"), "extraction_id", "text").select(F.col("doc").alias("extraction_id"), "chunk_index", "section", "subsection", "kind", "tokens", F.sha2("text", 256).alias("content_hash"))
