"""The pN_ queries of this subpackage and the SQL they are compared with, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm.language import assign_languages
from scholium.llm.leakage import find_leaks
from scholium.llm.names import entity_pairs, link_names
from scholium.llm.neardup import expand, near_duplicates
from scholium.llm.scannoise import learn_model, prose_rows, repair
from scholium.llm.splitting import split_oversized
from scholium.llm.textquality import text_types
from scholium.llm.tokenizing import encode_corpus
from scholium.session import table


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of all authors; the author lists of papers that were harvested more than once teach nicknames."""
    lists = table(spark, sf_dir, "arxiv_papers").select(F.col("arxiv_id").alias("grp"), F.col("authors").alias("names"))
    return link_names(table(spark, sf_dir, "authors"), "author_id", "full_name", lists)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_pairs(_linked(spark, sf_dir)).select(F.col("id_a").alias("author_id_a"), F.col("id_b").alias("author_id_b"))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).select(F.col("id").alias("author_id"), "entity")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = text_types(table(spark, sf_dir, "extractions"), "extraction_id", "text")
    return types.where("text_type <> 'prose'").select(F.col("id").alias("extraction_id"))


def p2_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, posterior shares and statistics of every text that is not blank."""
    types = text_types(table(spark, sf_dir, "extractions"), "extraction_id", "text", "page_count")
    shares = [c for c in types.columns if c not in ("id", "text_type", "text_hash", "word_count")]
    return types.select(F.col("id").alias("extraction_id"), "text_type", "word_count", *[F.round(c, 4).alias(c) for c in shares])


def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every text that is not blank."""
    types = text_types(table(spark, sf_dir, "extractions"), "extraction_id", "text", "page_count")
    return types.select(F.col("id").alias("extraction_id"), "word_count", *[F.round(c, 6).alias(c) for c in ("chars_per_page", "alpha_ratio", "mean_word_length", "replacement_char_ratio", "ended_lines")])


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    extractions = table(spark, sf_dir, "extractions")
    rows = prose_rows(extractions, "extraction_id", "text", text_types(extractions, "extraction_id", "text"))
    return repair(rows, learn_model(rows))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = _repaired(spark, sf_dir).select(F.col("id").alias("extraction_id"), F.explode("marks").alias("m"))
    return marks.select("extraction_id", "m.line_no", "m.kind")


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).select(F.col("id").alias("extraction_id"), "repaired")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = expand(*near_duplicates(table(spark, sf_dir, "retrieved_chunks"), "chunk_id", "text"))
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk: its class of equal word sets, the class's links and their smallest edit similarity."""
    members, links = near_duplicates(table(spark, sf_dir, "retrieved_chunks"), "chunk_id", "text", edit=True)
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id"), "edit_similarity")
    of = ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("links"), F.round(F.min("edit_similarity"), 6).alias("least_edit_similarity"))
    return members.join(of, "class_id", "left").select(F.col("id").alias("chunk_id"), "class_id", F.coalesce("links", F.lit(0)).alias("links"), "least_edit_similarity")


def _both(spark: SparkSession, sf_dir: str, plan: str) -> DataFrame:
    parts = [
        split_oversized(table(spark, sf_dir, t), item, "text", plan=plan).select(F.lit(t).alias("source_table"), F.col("item_id").cast("long").alias("item_id"), "piece_no", "start_pos", "end_pos")
        for t, item in (("sections", "section_id"), ("extractions", "extraction_id"))
    ]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, "window")


def p4_bisect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, "bisect")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each text comes back whole from its ids."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", check=True).select("doc_id", "round_trip")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_examples"), "item_id", ["text"])
    return leaks.where("stretch = 0").select("doc_id", "item_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per test item: documents that hold its passage or its question."""
    leaks = find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_examples"), "item_id", ["text", "query"])
    return leaks.groupBy("item_id", "passage").agg(F.count_if(F.col("stretch") == 0).alias("documents"), F.count(F.lit(1)).alias("stretches"), F.round(F.max("share"), 6).alias("largest_share"))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign_languages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")
    return rows.withColumn("confidence", F.round("confidence", 4))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign_languages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")
    return rows.where((F.col("segments") > 1) | ~F.col("declared_right")).select("doc_id", "seg_no", "lang")


QUERIES = {f.__name__: f for f in (p1_found, p1_entities, p2_found, p2_types, p2_statistics, p6_found, p6_repaired, p3_found, p3_classes, p4_found, p4_bisect, p7_ids, p7_round_trip, p8_found, p8_report, p9_found, p9_segments)}

_BLANK = "[\\s\\p{Z}\\x{85}\\x{0b}\\x{1c}-\\x{1f}]"
_SOLID = "[^\\s\\p{Z}\\x{85}\\x{0b}\\x{1c}-\\x{1f}]"

SQL = {
    "p7_round_trip": "SELECT doc_id, true AS round_trip FROM documents",
    # the definitions of the statistics, over the whole text
    "p2_statistics": f"""WITH m AS (SELECT extraction_id, page_count AS p, length(regexp_replace(text, '{_BLANK}', '', 'g')) AS dense, len(regexp_extract_all(text, '{_SOLID}+')) AS tokens, length(text) AS size,
  length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS letters, length(text) - length(replace(text, chr(65533), '')) AS bad,
  list_filter(regexp_split_to_array(text, '[\\n\\f]'), lambda x: regexp_matches(x, '{_SOLID}')) AS lines FROM extractions WHERE regexp_matches(text, '{_SOLID}'))
SELECT extraction_id, tokens AS word_count, CASE WHEN p >= 1 THEN round(dense / p::DOUBLE, 6) END AS chars_per_page, round(letters / dense::DOUBLE, 6) AS alpha_ratio, round(dense / tokens::DOUBLE, 6) AS mean_word_length,
  round(bad / size::DOUBLE, 6) AS replacement_char_ratio, round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?。！？]["\u2019\u201d»)\\]'']*{_BLANK}*$'))) / len(lines)::DOUBLE, 6) AS ended_lines FROM m""",
    # the forward cut, character by character
    "p4_found": """WITH RECURSIVE t AS (SELECT 'sections' AS source_table, section_id AS item_id, text FROM sections WHERE length(text) > 1200 UNION ALL SELECT 'extractions', extraction_id, text FROM extractions WHERE length(text) > 1200),
c AS MATERIALIZED (SELECT source_table, item_id, unnest(string_split(text, '')) AS ch, unnest(range(0, length(text))) AS i FROM t),
r AS (SELECT *, i - row_number() OVER (PARTITION BY source_table, item_id ORDER BY i) AS g FROM c WHERE ch IN (' ', chr(9), chr(10), chr(12), chr(13))),
b AS (SELECT source_table, item_id, max(i) + 1 AS e, min(i) - 1 AS i, count(*) FILTER (ch = chr(10)) AS feeds, bool_or(ch = chr(12)) AS page FROM r GROUP BY source_table, item_id, g),
k AS MATERIALIZED (SELECT source_table, item_id, e, CASE WHEN page OR feeds >= 2 THEN 0 WHEN ch IN ('.', '!', '?') THEN 1 ELSE 2 END AS kind FROM b LEFT JOIN c USING (source_table, item_id, i)),
p AS (SELECT source_table, item_id, length(text)::BIGINT AS n, -1::BIGINT AS piece_no, 0::BIGINT AS s, 0::BIGINT AS e, 0::BIGINT AS next FROM t
 UNION ALL SELECT source_table, item_id, n, piece_no + 1, s, e, CASE WHEN e < n THEN e - 120 END
 FROM (SELECT p.source_table, p.item_id, p.n, p.piece_no, p.next AS s, CASE WHEN p.n - p.next <= 1200 THEN p.n ELSE coalesce(arg_min(k.e, (k.kind, -k.e)), p.next + 1200) END AS e
  FROM p LEFT JOIN k ON k.source_table = p.source_table AND k.item_id = p.item_id AND k.e > p.next + 600 AND k.e <= p.next + 1200 WHERE p.next IS NOT NULL GROUP BY p.source_table, p.item_id, p.n, p.piece_no, p.next))
SELECT source_table, item_id, CAST(piece_no AS INTEGER) AS piece_no, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos FROM p WHERE piece_no >= 0""",
}
