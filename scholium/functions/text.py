"""Scalar functions over text, as Column expressions that stay inside the JVM.

Defined results: a null input gives null, except counts and flags, which say so in their docstrings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: thresholds of the text-quality score and of the decision to recognise a page again
DENSITY = (100.0, 800.0)
LEGIBLE = (0.55, 0.70)
WORD_LENGTH = (2.5, 12.0)
REPLACED_MOST, REPLACED_FACTOR = 0.01, 0.25
EMPTY_REASON = "extraction produced no text at all"
CONTROL = r"[\x00-\x08\x0b\x0e-\x1f\x7f]"


def squeeze_blanks(c: Column) -> Column:
    """White space collapsed and stripped; a blank text becomes null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def sanitise(c: Column) -> Column:
    """Control characters removed; tab, line feed, form feed and carriage return stay."""
    return F.regexp_replace(c, CONTROL, "")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def word_runs(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores (the exact analyser)."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def token_estimate(c: Column) -> Column:
    """Estimated model tokens: 1.35 a word, 0.8 more for one over 9 letters, 1 a symbol or number; blank is 0."""
    words = F.filter(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda x: x.rlike(r"^[\p{L}\p{N}&&[^\p{Nd}]]+$"))
    symbols = F.regexp_extract_all(c, F.lit(r"(?U)[^\p{L}\p{N}_\s]|\p{Nd}+"), F.lit(0))
    raw = F.size(words) * F.lit(1.35) + F.size(F.filter(words, lambda x: F.length(x) > 9)) * F.lit(0.8) + F.size(symbols)
    blank = F.trim(F.regexp_replace(c, r"(?U)\s+", " ")) == ""
    return F.when(c.isNull(), F.lit(None)).when(blank, F.lit(0)).otherwise(F.greatest(F.lit(1.0), F.bround(raw)).cast("int"))


def author_key(c: Column) -> Column:
    """Punctuation to blanks, lower case, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def clamp(v: Column, lo: float, hi: float) -> Column:
    """v scaled from [lo, hi] to [0, 1]; an empty range gives 1."""
    return F.lit(1.0) if hi <= lo else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo)))


def _counts(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    return {
        "dense": F.length(F.regexp_replace(t, r"(?U)\s", "")), "letters": F.length(F.regexp_replace(t, r"\P{L}", "")), "words": F.size(F.regexp_extract_all(t, F.lit(r"(?U)\S+"), F.lit(0))),
        "replaced": F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit(""))), "size": F.length(t),
    }


def _statistics(n: dict[str, Column], pages: Column) -> dict[str, Column]:
    some, paged = n["dense"] > 0, pages >= 1
    on = lambda c: F.when(paged, F.when(some, c).otherwise(F.lit(0.0)))
    cpp, alpha, mean, bad = n["dense"] / pages, n["letters"] / n["dense"], n["dense"] / n["words"], n["replaced"] / n["size"]
    shape = F.when((mean >= WORD_LENGTH[0]) & (mean <= WORD_LENGTH[1]), 1.0).otherwise(0.0)
    intact = F.when(bad > REPLACED_MOST, REPLACED_FACTOR).otherwise(1.0)
    score = clamp(alpha, *LEGIBLE) * intact * (0.6 * clamp(cpp, *DENSITY) + 0.4 * shape)
    r = lambda when, form, v: F.when(when, F.format_string(form, v))
    reasons = F.array_compact(F.array(
        r(cpp < DENSITY[0], "only %.0f chars/page, looks like a scanned document", cpp),
        r(alpha < LEGIBLE[0], "alphabetic ratio %.2f suggests a broken font encoding", alpha),
        r(mean < WORD_LENGTH[0], "mean word length %.1f suggests character-level fragmentation", mean),
        r(mean > WORD_LENGTH[1], "mean word length %.1f suggests collapsed spacing", mean),
        r(bad > REPLACED_MOST, "%.1f%% replacement characters indicate decoding failure", bad * 100),
    ))
    return {
        "reasons": F.when(paged, F.when(some, reasons).otherwise(F.array(F.lit(EMPTY_REASON)))), "chars_per_page": on(cpp), "alpha_ratio": on(alpha), "mean_word_length": on(mean),
        "replacement_char_ratio": on(bad), "word_count": F.when(paged, F.when(some, n["words"]).otherwise(0).cast("long")), "score": on(score),
    }


def quality(text: Column, pages: Column) -> dict[str, Column]:
    """Quality statistics of an extracted text over a number of pages (below 1: null). A null text counts as empty."""
    return _statistics(_counts(text), pages)


def quality_struct(text: Column, pages: Column) -> Column:
    """The same statistics as one struct; however many of its fields are used, the text is read once."""
    n = _counts(text)
    whole = F.struct(*[c.alias(x) for x, c in n.items()], pages.alias("pages"))
    return F.transform(F.array(whole), lambda b: F.struct(*[c.alias(x) for x, c in _statistics({x: b[x] for x in n}, b["pages"]).items()]))[0]


def needs_recognition(q: dict[str, Column], threshold: float = 0.5) -> Column:
    """Whether a page scan should be recognised again: no text, hardly any, or a poor and not dense one."""
    return (q["word_count"] == 0) | (q["chars_per_page"] < DENSITY[0]) | ((q["score"] < threshold) & (q["chars_per_page"] < DENSITY[1]))


def choose_extraction(native: dict[str, Column], recognised: dict[str, Column], ran: Column, failed: Column | None = None, threshold: float = 0.5) -> dict[str, Column]:
    """Which text of a document to keep: the recognised one only if it was wanted, ran and scores strictly higher.

    ran: whether recognition gave a text; failed: why it gave none (null: it was not tried). method is pymupdf, ocr or none.
    """
    wanted = needs_recognition(native, threshold)
    better = F.coalesce(wanted & ran & (recognised["score"] > native["score"]), F.lit(False))
    reason = failed if failed is not None else F.lit(None).cast("string")
    return {
        "method": F.when(better, F.lit("ocr")).when(wanted & (native["word_count"] == 0), F.lit("none")).otherwise(F.lit("pymupdf")),
        "score": F.when(better, recognised["score"]).otherwise(native["score"]),
        "ocr_attempted": wanted & ran,
        "ocr_skipped_reason": F.when(wanted & ~ran, F.coalesce(reason, F.lit("ocr_disabled_by_configuration"))),
    }


def page_ratio(text: Column, pages: Column, least: int = 50) -> Column:
    """Share of the pages that hold text; no pages give 0."""
    return F.when(pages > 0, pages_with_text(text, least) / pages).otherwise(F.lit(0.0))


def pages_with_text(text: Column, least: int = 50) -> Column:
    """Number of pages (between form feeds) with at least ``least`` characters once stripped; null has 0."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\f"), lambda p: F.length(F.regexp_replace(p, r"(?U)^\s+|\s+$", "")) >= least))


def usable(method: Column, text: Column) -> Column:
    """Whether an extraction has a method and any character that is not white space."""
    return (F.lower(F.coalesce(method, F.lit("none"))) != "none") & (F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", "")) > 0)


def versioned_id(url: Column) -> tuple[Column, Column]:
    """(id, version) of an abstract address; without a version it is 1, without a match both are null."""
    whole = r"^https?://[^/]+/abs/(.+?)(?:v(\d+))?$"
    name = F.nullif(F.regexp_extract(url, whole, 1), F.lit(""))
    return name, F.when(name.isNotNull(), F.coalesce(F.regexp_extract(url, whole, 2).try_cast("int"), F.lit(1)))


def url_allowed(url: Column, hosts: Sequence[str]) -> Column:
    """Scheme http or https, and the host one of the given or below one; no hosts given: any. Null is refused."""
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    known = F.lit(not hosts)
    for h in hosts:
        known = known | (host == h.lower()) | host.endswith("." + h.lower())
    return F.coalesce(scheme.isin("http", "https") & known & (host != ""), F.lit(False))


def stable_vector(text: Column, dims: int = 64, prefix: str = "") -> Column:
    """A deterministic unit vector from a text's SHA-256, for tests and for want of a model."""
    # one-element arrays: the digest, its bytes and the norm are bound once, not evaluated again for every element
    once = lambda value, use: F.transform(F.array(value), use)[0]
    scaled = lambda h: F.transform(F.sequence(F.lit(0), F.lit(min(dims, 32) - 1)), lambda i: (F.conv(F.substr(h, 2 * i + 1, F.lit(2)), 16, 10).cast("double") - 127.5) / 127.5)
    repeated = lambda b: F.slice(F.flatten(F.array_repeat(b, -(-dims // 32))), 1, dims)
    unit = lambda r: once(F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(r, lambda x: x / n))
    return F.when(text.isNotNull(), once(F.sha2(F.concat(F.lit(prefix), text), 256), lambda h: once(scaled(h), lambda b: once(repeated(b), unit))))


def _brackets(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(r"\[([^\[\]]{1,60})\]"), F.lit(1))


def _labels(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(r"(?Ui)\bP\s?(\d+)\b"), F.lit(1))


def citation_labels(answer: Column) -> Column:
    """Distinct labels P1, P2, ... inside square brackets of up to 60 characters, by first appearance."""
    numbers = F.flatten(F.transform(_brackets(answer), _labels))
    return F.array_distinct(F.transform(numbers, lambda n: F.concat(F.lit("P"), F.regexp_replace(n, r"^0+(?=\d)", ""))))


def malformed_labels(answer: Column) -> Column:
    """Bracketed numbers without a label, alone or behind a word for a source, stripped, in order."""
    odd = F.filter(_brackets(answer), lambda b: (F.size(_labels(b)) == 0) & b.rlike(r"(?Ui)^\s*(?:(?:paper|source|ref|reference|citation)\s*)?\d+\s*$"))
    return F.transform(odd, lambda b: F.regexp_replace(b, r"(?U)^\s+|\s+$", ""))


def strip_labels(answer: Column, labels: Column) -> Column:
    """An answer without the given labels: alone in brackets, or first or last in shared ones.

    Then runs of blanks and tabs become one blank, line breaks stay, and the ends are stripped. Without labels
    the answer is unchanged.
    """

    def without(t: Column, x: Column) -> Column:
        label = F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
        alone = F.concat(F.lit(r"(?Ui)\[\s*"), label, F.lit(r"\s*\]"))
        shared = F.concat(F.lit(r"(?Ui)(?<=\[)\s*"), label, F.lit(r"\s*[,;]\s*|\s*[,;]\s*"), label, F.lit(r"\s*(?=\])"))
        return F.regexp_replace(F.regexp_replace(t, alone, F.lit("")), shared, F.lit(""))

    bare = F.regexp_replace(F.aggregate(labels, answer, without), r"[ \t]{2,}", " ")
    return F.when(F.size(labels) > 0, F.regexp_replace(bare, r"(?U)^\s+|\s+$", "")).otherwise(answer)


def backoff(attempt: Column, base: float = 60.0, most: float = 3600.0) -> Column:
    """Seconds to wait before the next attempt."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def location(section: Column, subsection: Column, otherwise: str | Column = "body") -> Column:
    """Where a passage stands: section > subsection, or the section, or otherwise (for passages made here: their kind)."""
    top, below = F.nullif(section, F.lit("")), F.nullif(subsection, F.lit(""))
    return F.when(top.isNull(), F.lit(otherwise) if isinstance(otherwise, str) else otherwise).otherwise(F.concat_ws(" > ", top, below))
