"""Harvesting of paper metadata: query strings, paging, Atom feeds and record validation."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions.text import squeeze_blanks, versioned_id

OPEN_FROM, OPEN_UNTIL, PAGE_MOST = "199101010000", "999912312359", 2000
# fixed value: the fields of an Atom entry; without a schema, fields no entry carries would be lost
ENTRY = """id string, title string, summary string, published string, updated string, author array<struct<name string>>,
 category array<struct<_term string>>, `arxiv:primary_category` struct<_term string>, `arxiv:doi` string, `arxiv:journal_ref` string,
 `arxiv:comment` string, link array<struct<_href string, _rel string, _title string, _type string>>"""


# fixed value: the form of a category
CATEGORY = re.compile(r"^[a-z][a-z-]*(?:\.[A-Za-z]{2,})?$")


def _term(value: str) -> str:
    bare = value.replace('"', "").strip()
    if not bare:
        raise ValueError("a search term is empty")
    return f'"{bare}"' if " " in bare else bare


@dataclass(frozen=True)
class Query:
    """OR inside a group, AND between groups; date bounds with a zone, the earlier first."""

    categories: Sequence[str] = ()
    keywords: Sequence[str] = ()
    authors: Sequence[str] = ()
    submitted: tuple[datetime | None, datetime | None] = (None, None)
    updated: tuple[datetime | None, datetime | None] = (None, None)
    sort_by: str = "lastUpdatedDate"  # or submittedDate, relevance
    ascending: bool = True  # oldest first, so that a run that ends early leaves a usable mark

    def __post_init__(self) -> None:
        for bad in (c for c in self.categories if not CATEGORY.match(c)):
            raise ValueError(f"no category: {bad}")
        for a, b in (self.submitted, self.updated):
            if any(d is not None and d.tzinfo is None for d in (a, b)):
                raise ValueError("date bounds need a zone")
            if a and b and a > b:
                raise ValueError("a date range ends before it begins")
        if self.sort_by not in ("relevance", "lastUpdatedDate", "submittedDate"):
            raise ValueError(f"cannot sort by {self.sort_by}")
        if not (self.categories or self.keywords or self.authors or self.submitted[0] or self.updated[0]):
            raise ValueError("a query needs a category, keyword, author or first date")

    def search(self) -> str:
        """The query string; only lists of alternatives stand in brackets."""
        lists = ((f"cat:{c}" for c in self.categories), (f"all:{_term(k)}" for k in self.keywords), (f"au:{_term(a)}" for a in self.authors))
        parts = [f"({x})" for x in map(" OR ".join, lists) if x]
        stamp = lambda d: d.astimezone(UTC).strftime("%Y%m%d%H%M")
        for name, (a, b) in (("submittedDate", self.submitted), ("lastUpdatedDate", self.updated)):
            if a or b:
                parts.append(f"{name}:[{stamp(a) if a else OPEN_FROM} TO {stamp(b) if b else OPEN_UNTIL}]")
        return " AND ".join(parts)

    def predicate(self, categories: str, authors: str, text: str, submitted: str, updated: str) -> Column:
        """The same constraints over a table of papers, so that they reach the scan."""
        parts = []
        if self.categories:
            parts.append(F.arrays_overlap(F.col(categories), F.array(*map(F.lit, self.categories))))
        if self.keywords:
            parts.append(_any([F.contains(F.lower(F.col(text)), F.lit(k.lower())) for k in self.keywords]))
        if self.authors:
            parts.append(F.arrays_overlap(F.col(authors), F.array(*map(F.lit, self.authors))))
        for c, (a, b) in ((submitted, self.submitted), (updated, self.updated)):
            parts += [F.col(c) >= F.lit(a)] * bool(a) + [F.col(c) <= F.lit(b)] * bool(b)
        both = parts[0]
        for p in parts[1:]:
            both = both & p
        return both

    def page(self, start: int, size: int) -> dict[str, str | int]:
        if start < 0 or size < 1:
            raise ValueError("start >= 0 and size >= 1")
        return {"search_query": self.search(), "start": start, "max_results": min(size, PAGE_MOST), "sortBy": self.sort_by, "sortOrder": "ascending" if self.ascending else "descending"}


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def next_page(start: Column, parsed: Column, total: Column) -> tuple[Column, Column]:
    """(next start, whether there is more), by the total the feed states."""
    return start + parsed, start + parsed < total


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path)


def moment(name: str) -> Column:
    """A timestamp as text; one without a zone is meant in UTC, one that cannot be read is null."""
    c = F.trim(F.col(name))
    return F.try_to_timestamp(F.when(c.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$") & c.contains(":"), c).otherwise(F.concat(c, F.lit("Z"))))


def parse_entries(entries: DataFrame) -> DataFrame:
    """Records of a feed with a flag valid; bad entries stay, so they can be set aside and counted."""
    name, version = versioned_id(F.col("id"))
    links = F.coalesce(F.col("link"), F.array().cast("array<struct<_href string,_rel string,_title string,_type string>>"))
    last = lambda xs: F.try_element_at(xs, F.lit(-1))["_href"]
    pdf = last(F.filter(links, lambda x: F.coalesce(x["_title"] == "pdf", F.lit(False)) | F.coalesce(x["_type"] == "application/pdf", F.lit(False))))
    page = last(F.filter(links, lambda x: F.coalesce(x["_rel"] == "alternate", F.lit(False))))
    terms = F.filter(F.transform(F.coalesce(F.col("category"), F.array().cast("array<struct<_term string>>")), lambda c: c["_term"]), lambda t: t.isNotNull())
    primary = F.coalesce(F.col("`arxiv:primary_category`._term"), F.try_element_at(terms, F.lit(1)))
    people = F.filter(F.transform(F.coalesce(F.col("author"), F.array().cast("array<struct<name string>>")), lambda a: squeeze_blanks(a["name"])), lambda a: a.isNotNull())
    base = entries.select(
        name.alias("arxiv_id"), version.alias("version"), squeeze_blanks(F.col("title")).alias("title"), squeeze_blanks(F.col("summary")).alias("abstract"), people.alias("authors"),
        moment("published").alias("published_at"), moment("updated").alias("updated_at"), primary.alias("primary_category"),
        F.array_distinct(F.filter(F.concat(F.array(primary), terms), lambda t: t.isNotNull())).alias("categories"),
        squeeze_blanks(F.col("`arxiv:doi`")).alias("doi"), squeeze_blanks(F.col("`arxiv:journal_ref`")).alias("journal_ref"), squeeze_blanks(F.col("`arxiv:comment`")).alias("comment"),
        F.coalesce(page, F.col("id")).alias("abs_url"), F.coalesce(pdf, F.regexp_replace("id", "/abs/", "/pdf/")).alias("pdf_url"), F.contains("id", F.lit("api/errors")).alias("is_error"),
    )
    return base.withColumn("valid", is_valid() & ~F.col("is_error")).drop("is_error")


def is_valid() -> Column:
    """Whether a record has an id of either style, a version, title, abstract, an author, both times and a category."""
    good_id = F.col("arxiv_id").rlike(r"^(?:\d{4}\.\d{4,5}|[a-z\-]+(?:\.[A-Z]{2})?/\d{7})$")
    return F.coalesce(good_id & (F.col("version") >= 1) & F.col("title").isNotNull() & F.col("abstract").isNotNull() & (F.size("authors") > 0) & F.col("published_at").isNotNull() & F.col("updated_at").isNotNull() & F.col("primary_category").isNotNull(), F.lit(False))


def read_pdfs(spark: SparkSession, path: str, most_bytes: int = 50_000_000) -> DataFrame:
    """PDF files within the size limit that begin as a PDF does; the limit is checked before content is read."""
    files = spark.read.format("binaryFile").load(path).where((F.col("length") > 0) & (F.col("length") <= most_bytes))
    return files.where(F.substring("content", 1, 5) == F.lit(b"%PDF-"))


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good records, records set aside) of parse_entries()."""
    return records.where("valid").drop("valid"), records.where(~F.col("valid")).drop("valid")


def by_ids(records: DataFrame, ids: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """The records of listed ids; an empty list gives none."""
    return records.join(ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


# fixed values: kinds of evaluation queries and where a label comes from
QUERY_CATEGORIES = ("exact_terminology", "conceptual", "method_comparison", "paper_specific", "multi_source", "vocabulary_mismatch")
LABEL_SOURCES = ("drafted_from_abstract", "drafted_from_full_text", "human_verified", "human_authored")
EXAMPLE = "id string, query string, category string, relevant_arxiv_ids array<string>, relevant_sections array<string>, notes string, label_source string, reviewed boolean"


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation examples of a JSON file with a list ``examples``.

    Bad JSON, no examples, repeated ids, unknown categories or label sources, blank queries or notes and examples
    without a relevant id raise: to leave one out would change what is measured.
    """
    whole = spark.read.schema(f"version string, created string, examples array<struct<{EXAMPLE.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = whole.select(F.explode("examples").alias("e")).select("e.*").withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    odd = blank("query") | blank("notes") | F.coalesce(F.size("relevant_arxiv_ids") < 1, F.lit(True)) | ~F.coalesce(F.col("category").isin(*QUERY_CATEGORIES) & F.col("label_source").isin(*LABEL_SOURCES), F.lit(False)) | F.col("id").isNull()
    n, ids, bad = rows.agg(F.count(F.lit(1)), F.countDistinct("id"), F.count_if(odd)).first()
    if not n or bad or n != ids:
        raise ValueError(f"of {n} examples {bad} are malformed and {n - ids} repeat an id")
    return rows
