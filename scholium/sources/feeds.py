"""Paged feeds: a scan page by page with a limit, polite fetching, and a data source over stored pages.

Fetching itself is a function the caller gives; the scan, the pace and the retries are here. Pages that were
stored are read by the data source ``stored_feed``, one task a page.
"""

from __future__ import annotations

import glob
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ATOM, ARXIV, OPEN = "{http://www.w3.org/2005/Atom}", "{http://arxiv.org/schemas/atom}", "{http://a9.com/-/spec/opensearch/1.1/}"


@dataclass
class Page:
    total: int
    start: int
    entries: list


@dataclass
class Pace:
    """At least ``interval`` seconds between two calls."""

    interval: float = 3.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: float | None = None

    def wait(self) -> None:
        now = self.clock()
        if self.last is not None and now - self.last < self.interval:
            self.sleep(self.interval - (now - self.last))
        self.last = self.clock()


class Transient(Exception):
    """A failure that may pass: a timeout, a refusal under load, a server's error."""


def with_retries(call: Callable[[], object], tries: int = 3, base: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """The result of call; transient failures are tried again after base, 2 base, ... seconds, others are not."""
    for k in range(tries):
        try:
            return call()
        except Transient:
            if k + 1 == tries:
                raise
            sleep(min(base * 2**k, most))
    raise ValueError("tries must be at least 1")


def scan(fetch: Callable[[int, int], Page], size: int = 100, limit: int | None = None, largest: int = 2000, pace: Pace | None = None) -> Iterator[object]:
    """Entries page by page until the feed's total, the limit, or an empty page (the rest is left to the next run).

    The next page begins behind the entries that were read, however many were asked for.
    """
    start, given = 0, 0
    while limit is None or given < limit:
        if pace:
            pace.wait()
        at = start
        page = with_retries(lambda: fetch(at, min(size, largest)))
        for entry in page.entries:
            if limit is not None and given >= limit:
                return
            given += 1
            yield entry
        start += len(page.entries)
        if not page.entries or start >= page.total:
            return


# ---- stored pages as a data source -------------------------------------------------------------
@dataclass
class _File(InputPartition):
    path: str


def _entry(e: ET.Element) -> tuple:
    text = lambda tag: e.findtext(tag)
    links = [(x.get("href"), x.get("rel"), x.get("title"), x.get("type")) for x in e.findall(f"{ATOM}link")]
    primary = e.find(f"{ARXIV}primary_category")
    return (
        text(f"{ATOM}id"), text(f"{ATOM}title"), text(f"{ATOM}summary"), text(f"{ATOM}published"), text(f"{ATOM}updated"), [(a.findtext(f"{ATOM}name"),) for a in e.findall(f"{ATOM}author")],
        [(c.get("term"),) for c in e.findall(f"{ATOM}category")], (primary.get("term"),) if primary is not None else None, text(f"{ARXIV}doi"), text(f"{ARXIV}journal_ref"), text(f"{ARXIV}comment"), links,
    )


def parse_page(xml: str) -> Page:
    """Entries and counters of one page; missing counters are 0 and the number of entries."""
    root = ET.fromstring(xml)
    entries = [_entry(e) for e in root.findall(f"{ATOM}entry")]
    number = lambda tag, other: int(v) if (v := (root.findtext(f"{OPEN}{tag}") or "").strip()).isdigit() else other
    return Page(number("totalResults", len(entries)), number("startIndex", 0), entries)


class StoredFeed(DataSource):
    """Rows of the entries of feed pages that lie as files under a path (a glob), in the columns parse_entries() takes."""

    @classmethod
    def name(cls) -> str:
        return "stored_feed"

    def schema(self) -> str:
        from scholium.sources.arxiv import ENTRY

        return ENTRY

    def reader(self, schema: object) -> DataSourceReader:
        return _FeedReader(self.options["path"])


@dataclass
class _FeedReader(DataSourceReader):
    path: str = field(default="")

    def partitions(self) -> list[_File]:
        return [_File(p) for p in sorted(glob.glob(self.path))] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.path:
            with open(partition.path, encoding="utf-8") as f:
                yield from parse_page(f.read()).entries


def register(spark: SparkSession) -> None:
    """After this, spark.read.format("stored_feed").load(glob) reads stored pages."""
    spark.dataSource.register(StoredFeed)
