"""Damage of printed and scanned pages, and its repair (problem 6).

* Furniture: running headers, footers and page numbers, told from headings, formulas and numbers in the
  body by their place on the page, by recurring on other pages and in other texts, and by their shape.
* Hyphens: a word cut at a line's end is put together if the collection writes it without a hyphen.
* Misread characters: a noisy channel. A word's candidates are itself and the words of the collection that
  known confusions turn into it; candidates of a line are decoded by Viterbi with confusion
  probabilities, word frequencies and word-pair likelihoods. Confusion probabilities are estimated from
  the collection's own unambiguous misreadings.

Evidence is absolute: a word, a hyphened word or a line at a page's edge is known if it stands ``least`` times
(``line_least`` for lines) in distinct texts, so copies prove nothing and more text only adds to what is known. A
known misspelling is still corrected where a known word, times the confusion's probability, is likelier than the
chance ``GENUINE`` that it is a word of its own, times its frequency. Word pairs are known like words, and make
a reading at most e^4 times likelier, but not where another reading's pair stands 1 / ``MOST_MISREAD`` times as often:
the pair can be that one misread. A word that no single confusion explains may be two away from a known word.

What is known goes to the tasks whole up to ``most_entries`` entries. Beyond, the tasks are sent what has a share of
``share`` (pairs: ``pair_share``) of its kind, at most 1 / share entries, and every text is joined with what it asks
of the rest: its other words, the other known words that one or two confusions turn into its words, its hyphened
words, its edge lines, and then the pairs of its words' readings. The results are the same.

Defined results: null and blank texts give no rows. Lines are what lies between line feeds and form feeds,
each such character ending a line, numbered from 0 over the whole text. Repeated rows are repaired each.
"""

from __future__ import annotations

import bisect
import math
import os
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.session import spread, stored

# fixed values: (what is read, what was printed)
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("o", "a"), ("a", "o"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("5", "s"), ("s", "5"), ("1", "l"), ("1", "i"), ("l", "1"),
    ("0", "o"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("b", "h"), ("h", "b"), ("9", "g"), ("q", "g"), ("g", "q"),
    ("m", "in"), ("in", "m"), ("8", "b"), ("6", "b"), ("vv", "w"), ("w", "vv"), ("nn", "m"), ("li", "h"), ("lc", "k"), ("u", "v"), ("v", "u"), ("n", "u"), ("u", "n"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"),
)
HEADINGS = {
    "abstract", "introduction", "background", "related work", "method", "methods", "approach", "experiments", "experimental setup", "evaluation", "results",
    "discussion", "limitations", "conclusion", "conclusions", "future work", "references", "bibliography", "appendix", "acknowledgments", "acknowledgements", "acknowledgment",
}
HYPHENS = "-‐‑­¬"
TOKEN = re.compile(r"[^\W_]+")
COMPOUND = re.compile(rf"[^\W\d_]+(?:[{HYPHENS}][^\W\d_]+)+")
CUT = re.compile(rf"((?:[^\W_]+[{HYPHENS}])*[^\W_]+)[{HYPHENS}][ \t\r]*$")
LEAD = re.compile(rf"^[ \t]*([^\W_]+(?:[{HYPHENS}][^\W_]+)*)")
PAGE_NUMBER = re.compile(r"^[-–—\[ ]*(?:\d{1,5}|[ivxlc]{1,6})[-–—\] ]*$")
PAGE_LABEL = re.compile(r"^(?:page|p\.|seite|pagina|página)\s*\d+(?:\s*(?:of|/|von|de|di)\s*\d+)?\.?$", re.IGNORECASE)
NUMBERED = re.compile(r"^(?:\d+|[A-Z])(?:\.\d+)*\.? [^\W\d_]")
EDGE_NUMBER = re.compile(r"^\d{1,5}\s{2,}\S|\S\s{2,}\d{1,5}$|[,;|·]\s*(?:p\.|page)\s*\d+$")
NUMBER_AHEAD = re.compile(r"^(?:\d+|[A-Z])(?:\.\d+)*\.?\s+")
DIGIT_INSIDE, DIGIT_FOR_LETTER = re.compile(r"[a-z]\d|\d[a-z]"), re.compile(r"[a-z][01589][a-z]|^[015][a-z]{3}|[a-z]{3}[015]$")
SENTENCE_ENDED, BLOCK_ENDED = re.compile(r"[.!?][\"'”)]*\s*$"), re.compile(r"[.!?:][\"'”)]*$")
FORMULA = re.compile(r"[=∑∫√≤≥±^]|^\(\d+\)$")


def lines_of(text: str) -> list[list[tuple[int, str]]]:
    """Pages of (line number, line)."""
    pages, number = [], 0
    for page in text.split("\f"):
        own = page.split("\n")
        pages.append([(number + k, x.rstrip("\r")) for k, x in enumerate(own)])
        number += len(own)
    return pages


def shape(line: str) -> str:
    return re.sub(r"\d+", "#", " ".join(line.split()))


def is_heading(line: str) -> bool:
    if len(line) > 200:
        return False
    x = line.strip()
    bare = NUMBER_AHEAD.sub("", x).lower().rstrip(":")
    return bare in HEADINGS or bool(NUMBERED.match(x)) and len(x.split()) <= 8


def edge_lines(page: list[tuple[int, str]], most: int = 2) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """The first and the last lines of a page that are not blank."""
    full = [(n, x) for n, x in page if x.strip()]
    return full[:most], full[::-1][:most] if len(full) > 1 else []


def furniture(text_pages: list[list[tuple[int, str]]], known: set[str]) -> set[int]:
    """Line numbers of running headers, footers and page numbers."""
    edges = [edge_lines(p) for p in text_pages]
    seen: Counter[str] = Counter()
    for top, bottom in edges:
        seen.update({shape(x) for _, x in (*top[:1], *bottom[:1]) if not is_heading(x)})
    widths = sorted(len(x) for p in text_pages for _, x in p if x.strip())
    width = widths[int(len(widths) * 0.7)] if widths else 0
    out: set[int] = set()

    def sure(line: str) -> bool:
        x = line.strip()
        if is_heading(x) and not EDGE_NUMBER.search(x) or FORMULA.search(x):
            return False
        return bool(PAGE_NUMBER.match(x) or PAGE_LABEL.match(x) or EDGE_NUMBER.search(x) and len(x) < 0.95 * max(width, 40)) or shape(x) in known or seen[shape(x)] > 1 and len(x) < 90

    several = sum(bool(top) for top, _ in edges) > 1
    for top, bottom in edges:
        if len(top) < 2 and not several:  # the only line of a text
            continue
        for edge, is_top in ((top, True), (bottom, False)):
            for depth, (n, line) in enumerate(edge):
                x = line.strip()
                if sure(line):
                    out.add(n)
                    continue
                if is_top and depth == 0 and bottom and not is_heading(x) and not FORMULA.search(x):
                    # a line that fills only part of the width, ends no sentence and runs on in none
                    if (len(x) < 0.8 * width or x.endswith("…")) and (x[:1].isupper() or x[:1].isdigit()) and not re.search(r"[.!?:;,)%\-‐]$", x) and len(x) > 2:
                        out.add(n)
                break
    return out


UNKNOWN = 1e-10  # probability of a certain word that is not known: a new name, a number
GENUINE = 0.01  # how likely a word that looks like a misread frequent one is one nevertheless
PAIR_CLIP = 4.0
MOST_MISREAD = 0.05  # at most this share of what was printed is misread one way


class Model:
    """What the collection says about words, pairs, hyphens and boundary lines.

    more: what one text has from the join, if any. wanted: takes the pairs that are looked for in vain, if it is a set.
    """

    def __init__(self, words: dict[str, int], pairs: dict[str, int], compounds: dict[str, int], boundary: set[str], total: int, channel: dict[tuple[str, str], float]):
        self.words, self.pairs, self.compounds, self.boundary, self.total, self.channel = words, pairs, compounds, boundary, max(total, 1), channel
        self.kept: dict[str, list[tuple[str, float, int]]] = {}
        self.clean: set[str] = set()
        self.ordered = sorted(words)
        self.by_read: dict[str, list[tuple[str, float]]] = {}
        for (read, printed), p in channel.items():
            self.by_read.setdefault(read, []).append((printed, math.log(p)))
        self.wanted: set[str] | None = None
        self.more: dict[str, dict[str, object]] = {}
        self.told((), ())

    def told(self, hits: Iterable[dict], pairs: Iterable[dict]) -> None:
        """Takes what one text has from the join."""
        self.more = {k: {} for k in ("word", "pair", "compound", "line", "form", "deep")}
        for x in hits:
            if x["word"] is None:
                self.more[x["kind"]][x["key"]] = x["n"]
                continue
            self.more["word"].setdefault(x["word"], x["n"])
            self.more["form" if x["read2"] is None else "deep"].setdefault(x["key"], []).append(x)
        for x in pairs:
            self.more["pair"][x["key"]] = x["n"]

    def count(self, word: str) -> int:
        return self.words.get(word) or self.more["word"].get(word, 0)

    def reach(self, word: str) -> int:
        """The length of the longest start of a word with which a word of the collection starts."""
        i = bisect.bisect(self.ordered, word)
        return max((len(os.path.commonprefix((word, w))) for w in self.ordered[max(0, i - 1) : i + 1]), default=0)

    def candidates(self, word: str) -> list[tuple[str, float, int]]:
        """(word, log score, where the first misread character is) of a lower-case word, itself first with -1."""
        forms, deep = self.more["form"].get(word, ()), self.more["deep"].get(word, ())
        special = forms or deep or word in self.more["word"]
        if not special and (kept := self.kept.get(word)) is not None:
            return kept
        # a word the collection does not know: a name, a number or a misreading
        c = self.count(word)
        own = math.log(GENUINE * c / self.total if c else UNKNOWN)
        found: dict[str, tuple[float, int]] = {}

        def add(v: str, s: float, at: int) -> None:
            if v not in found or found[v][0] < s:
                found[v] = (s, at)

        for x in forms:  # known words of the join that this one is a misread form of
            add(x["word"], math.log(self.channel[(x["read"], x["printed"])]) + math.log(x["n"] / self.total), x["at"])
        frontier = [(word, 0.0, 0, len(word))]
        for depth in range(2 if len(word) > 5 else 1):
            fresh = []
            for x in deep if depth else ():
                add(x["word"], math.log(self.channel[(x["read"], x["printed"])]) + math.log(self.channel[(x["read2"], x["printed2"])]) + math.log(x["n"] / self.total), x["at"])
            for w, cost, start, first in frontier:
                # behind its reach no change, nor one further right, makes a known word
                for i in range(start, min(len(w), self.reach(w) + 1)):
                    for n in (1, 2):
                        for printed, p in self.by_read.get(w[i : i + n], ()) if len(w[i : i + n]) == n else ():
                            v, score, at = w[:i] + printed + w[i + n :], cost + p, min(first, i)
                            if (k := self.words.get(v)) and v != word:
                                add(v, score + math.log(k / self.total), at)
                            fresh.append((v, score, i + len(printed), at))
            if found:
                break
            frontier = fresh
        best = sorted(((v, s, at) for v, (s, at) in found.items() if s > own - 4), key=lambda x: -x[1])
        out = [(word, own, -1), *best]
        if special:
            return out
        if len(self.kept) > 300_000:
            self.kept.clear()
            self.clean.clear()
        self.kept[word] = out
        if len(out) == 1 and (word.isalpha() or word in self.words):
            self.clean.add(word)
        return out

    def is_clean(self, words: list[str]) -> bool:
        """Whether no word of a line has another reading; the words that told so are remembered."""
        if any(self.more.values()):
            return False
        if self.clean.issuperset(words):
            return True
        for w in words:
            if w not in self.clean:
                self.candidates(w)
        return self.clean.issuperset(words)

    def pair_count(self, a: str, b: str) -> int:
        """How often b stands behind a, if that and both words are known."""
        pair = f"{a} {b}"
        n = self.pairs.get(pair) or self.more["pair"].get(pair, 0)
        if n or self.wanted is not None:
            if not self.count(a) or not self.count(b):
                return 0
            if not n:
                self.wanted.add(pair)
        return n

    def links(self, before: list[tuple[str, float, int]], v: str, counts: list[int], most: int) -> list[float]:
        """How much likelier v is behind each word than anywhere; a pair that may be a misread form of another says nothing."""
        own = self.count(v)
        return [max(0.0, min(PAIR_CLIP, math.log(n * self.total / (self.count(u[0]) * own)))) if n > MOST_MISREAD * most else 0.0 for u, n in zip(before, counts, strict=True)]

    def decode(self, words: list[str]) -> list[tuple[str, float, int]]:
        """The likeliest candidates of a line's words, by Viterbi."""
        lattice = [self.candidates(w) for w in words]
        if all(len(x) == 1 for x in lattice):
            return [x[0] for x in lattice]
        score, back = [x[1] for x in lattice[0]], []
        for t in range(1, len(lattice)):
            if len(lattice[t - 1]) == len(lattice[t]) == 1:  # the same for every way
                score = [score[0] + lattice[t][0][1]]
                back.append([0])
                continue
            step, came = [], []
            counts = [[self.pair_count(u[0], v[0]) for u in lattice[t - 1]] for v in lattice[t]]
            most = max(map(max, counts))
            for (v, s, _), own in zip(lattice[t], counts, strict=True):
                over = [x + link for x, link in zip(score, self.links(lattice[t - 1], v, own, most), strict=True)]
                i = max(range(len(over)), key=over.__getitem__)
                step.append(over[i] + s)
                came.append(i)
            score = step
            back.append(came)
        i = max(range(len(score)), key=score.__getitem__)
        out = [lattice[-1][i]]
        for t in range(len(back) - 1, -1, -1):
            i = back[t][i]
            out.append(lattice[t][i])
        return out[::-1]

    def is_cut(self, before: str, behind: str) -> bool:
        """Whether before- / behind is one word that is written without the hyphen."""
        parts, rest = re.split(f"[{HYPHENS}]", before.lower()), re.split(f"[{HYPHENS}]", behind.lower())
        joined = self.count(parts[-1] + rest[0])
        hyphened = max(self.compounds.get(c) or self.more["compound"].get(c, 0) for c in (f"{parts[-1]}-{rest[0]}", "-".join([*parts, *rest])))
        if joined or hyphened:
            return joined >= hyphened
        if any(at >= 0 for _, _, at in self.candidates(parts[-1] + rest[0])):
            return True
        return not (len(parts) > 1 or len(rest) > 1 or self.count(parts[-1]) and self.count(rest[0]) and len(parts[-1]) > 2 and len(rest[0]) > 2)

    def analyse(self, text: str) -> tuple[list[tuple[int, str]], str]:
        """((line number, kind) of the damage, the repaired text)."""
        pages = lines_of(text)
        drop = furniture(pages, self.boundary | self.more["line"].keys() if self.more["line"] else self.boundary)
        body = [(n, x) for p in pages for n, x in p if n not in drop]
        marks, fixed = {(n, "furniture") for n in drop}, []
        filled = [k for k, (_, x) in enumerate(body) if x.strip()]
        follow = dict(zip(filled, filled[1:], strict=False))
        carried: dict[int, tuple[str, int, bool]] = {}  # line -> (first half, its line, one word)
        glue: set[int] = set()
        for k, (n, line) in enumerate(body):
            cut, nxt = CUT.search(line) if line.rstrip()[-1:] in HYPHENS else None, follow.get(k)
            if not cut and k not in carried and self.is_clean(TOKEN.findall(line.lower())):
                fixed.append(line)
                continue
            spans = [m.span() for m in TOKEN.finditer(line)]
            tokens = [line[a:b] for a, b in spans]
            words = [t.lower() for t in tokens]
            lead = LEAD.match(body[nxt][1]) if cut and nxt is not None else None
            if lead and tokens:
                one = self.is_cut(cut.group(1), lead.group(1))
                tail = re.split(f"[{HYPHENS}]", lead.group(1))[0]
                carried[nxt] = (words[-1], n, one)
                glue.add(k)
                if one:
                    marks.add((n, "hyphen"))
                    words[-1] += tail.lower()
            before = carried.get(k)
            if before and before[2] and words:
                words[0] = before[0] + words[0]
            chosen = self.decode(words) if words else []
            out, at = [], 0
            for j, (w, (a, b), (v, _, where)) in enumerate(zip(words, spans, chosen, strict=True)):
                first, last = j == 0 and before is not None and before[2], j == len(words) - 1 and k in glue
                t = line[a:b]
                out.append(line[at:a])
                at = b
                # a capitalised word inside a sentence is a name, unless a digit stands in it
                if where >= 0 and len(w) > 2 and not t.isdigit() and not t.isupper() and (first or not t[:1].isupper() or self._begins_sentence(line[:a]) or DIGIT_INSIDE.search(t)):
                    inside = where >= len(before[0]) if first else where < len(t) if last else True
                    if inside:
                        marks.add((n, "misread"))
                    if not first and not last:
                        t = v.capitalize() if t[:1].isupper() else v
                elif where < 0 and len(t) > 3 and not t.isalpha() and DIGIT_FOR_LETTER.search(t) and not self.count(w):
                    marks.add((n, "misread"))
                out.append(t)
            fixed.append("".join(out) + line[at:])
        return sorted(marks), self._paragraphs(body, fixed, carried, glue)

    @staticmethod
    def _begins_sentence(before: str) -> bool:
        return not before.strip() or SENTENCE_ENDED.search(before) is not None

    def _paragraphs(self, body: list[tuple[int, str]], fixed: list[str], carried: dict[int, tuple[str, int, bool]], glue: set[int]) -> str:
        paragraphs, open_, blank, tight = [], "", False, False
        for k, line in enumerate(fixed):
            x = " ".join(line.split())
            if not x:
                blank = True
                continue
            alone = is_heading(x) or bool(FORMULA.search(x)) and len(x) < 40
            if tight:
                open_ += x
            elif open_ and (alone or blank and BLOCK_ENDED.search(open_[-8:]) or is_heading(open_)):
                paragraphs.append(open_)
                open_ = x
            else:
                open_ = f"{open_} {x}".strip()
            blank, tight = False, False
            if k in glue:
                nxt = next(v for j, v in carried.items() if j > k and v[1] == body[k][0])
                open_, tight = (re.sub(f"[{HYPHENS}]$", "", open_) if nxt[2] else open_), True
        return "\n\n".join([*paragraphs, open_]) if open_ else "\n\n".join(paragraphs)


BROKEN = re.compile(rf"(?:[^\W_]+[{HYPHENS}])*[^\W_]+[{HYPHENS}][ \t\r]*\n\s*[^\W_]+")


def edge_shapes(text: str) -> list[str]:
    """Shapes of the lines at the edges of a text's pages that could be furniture."""
    out = []
    for page in lines_of(text):
        top, bottom = edge_lines(page, 1)
        out += {s for _, x in (*top, *bottom) if 2 < len(s := shape(x)) < 80 and not is_heading(x) and not FORMULA.search(x)}
    return out


def compound_keys(text: str) -> list[str]:
    return [c.translate(PLAIN_HYPHEN) for c in COMPOUND.findall(text)]


PLAIN_HYPHEN, NO_HYPHEN = str.maketrans(dict.fromkeys(HYPHENS, "-")), str.maketrans(dict.fromkeys(HYPHENS, " "))
HYPHENED = re.compile(rf"[^\W_]+(?:[{HYPHENS}][^\W_]+)*")
FIRST_WORD, LAST_WORD = re.compile(r"^\s*[^\W_]+"), re.compile(rf"(?:[^\W_]+[{HYPHENS}])*[^\W_]+[{HYPHENS}]\s*$")


def count_text(text: str, into: dict[str, Counter]) -> None:
    """Adds a text's words, word pairs, hyphened words and boundary lines; both halves of words cut at a line's end are left out."""
    into["line"].update(set(edge_shapes(text)))
    lines, cut = text.lower().split("\n"), False
    for k, line in enumerate(lines):
        if cut and line.strip():
            line = lines[k] = FIRST_WORD.sub(" ", line, count=1)
            cut = False
        if line.rstrip()[-1:] in HYPHENS and line.strip():
            lines[k], n = LAST_WORD.subn(" ", line)
            cut = n > 0
    found = HYPHENED.findall("\n".join(lines))
    into["compound"].update(x.translate(PLAIN_HYPHEN) for x in found if not x.isalnum() and COMPOUND.fullmatch(x))
    words = " ".join(found).translate(NO_HYPHEN).split()
    into["word"].update(words)
    into["pair"].update(map(" ".join, zip(words, words[1:], strict=False)))


@dataclass
class Learned:
    """The model for the tasks, and where it is not all that is known, the counts of the rest."""

    model: Model
    rest: DataFrame | None = None  # kind, key, n
    words: DataFrame | None = None  # key, n of the words that the model has


def learn_model(rows: DataFrame, share: float = 5e-6, pair_share: float = 2e-5, least: int = 5, line_least: int = 5, most_entries: int = 300_000) -> Learned:
    """Counts over all distinct texts (columns text, text_hash): see the module's description of what is known and sent."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            into: dict[str, Counter] = {k: Counter() for k in ("word", "pair", "compound", "line")}
            for t in pdf["text"]:
                count_text(t, into)
            yield pd.DataFrame([(kind, key, n) for kind, c in into.items() for key, n in c.items()], columns=["kind", "key", "n"]).astype({"kind": "object", "key": "object", "n": "int64"})

    one = rows.select("text_hash", "text").dropDuplicates(["text_hash"]).select("text")  # copies are merged before the shuffle
    counts = stored(one.mapInPandas(count, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    totals = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    words = totals.get("word", 0)
    floor = F.when(F.col("kind") == "line", line_least).otherwise(least)
    known = counts.where(F.col("n") >= floor)
    if known.count() <= most_entries:
        sent, rest = known, None
    else:
        frequent = F.col("n") >= F.when(F.col("kind") == "line", share * totals.get("line", 0)).when(F.col("kind") == "pair", pair_share * words).otherwise(share * words)
        sent, rest = known.where(frequent), known.where(~frequent)
    lists: dict[str, dict[str, int]] = {k: {} for k in ("word", "pair", "compound", "line")}
    for r in sent.collect():
        lists[r["kind"]][r["key"]] = r["n"]
    # unambiguous misreadings of the collection: rare words that exactly one confusion turns into a frequent one
    seen = dict.fromkeys(CONFUSIONS, 1.0)
    of_kind, often = counts.where(F.col("kind") == "word"), F.col("n") >= max(least, share * words)
    hits = misread_forms(of_kind.where(often & F.col("key").rlike(r"^\p{L}+$")), 5).groupBy("key", "read", "printed").agg(F.sum("times").alias("times"))
    for r in hits.join(of_kind.where(~often), "key").groupBy("read", "printed").agg(F.sum(F.col("n") * F.col("times")).alias("n")).collect():
        seen[(r["read"], r["printed"])] += r["n"]
    whole = sum(seen.values())
    rate = min(MOST_MISREAD, max(0.002, whole / max(words, 1)))
    channel = {c: max(1e-6, rate * n / whole) for c, n in seen.items()}
    return Learned(Model(lists["word"], lists["pair"], lists["compound"], set(lists["line"]), words, channel), rest, sent.where(F.col("kind") == "word").select("key", "n"))


def misread_forms(words: DataFrame, shortest: int = 1) -> DataFrame:
    """key (what is read), word, n, read, printed, at, times: every way to misread one place of a word (columns key, n)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(w[:i] + read + w[i + len(printed) :], w, n, read, printed, i, 1) for w, n in zip(pdf["key"], pdf["n"], strict=True) if len(w) >= shortest for read, printed in CONFUSIONS for i in range(len(w)) if w.startswith(printed, i)]
            yield pd.DataFrame(out, columns=["key", "word", "n", "read", "printed", "at", "times"])

    return words.select("key", "n").mapInPandas(run, "key string, word string, n long, read string, printed string, at int, times int")


def repaired_forms(words: DataFrame) -> DataFrame:
    """key, half, first, to, read, printed: every way to take one confusion in a word of 6 letters or more (column key) back, and where a next may begin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(w, w[:i] + printed + w[i + len(read) :], i, i + len(printed), read, printed) for w in pdf["key"] if len(w) > 5 for read, printed in CONFUSIONS for i in range(len(w)) if w.startswith(read, i)]
            yield pd.DataFrame(out, columns=["key", "half", "first", "to", "read", "printed"])

    return words.select("key").mapInPandas(run, "key string, half string, first int, to int, read string, printed string")


def deep_forms(words: DataFrame, forms: DataFrame) -> DataFrame:
    """key, word, n, read, printed, read2, printed2, at: words (column key) that are two confusions away from the words of forms."""
    second = forms.select(F.col("key").alias("half"), "word", "n", F.col("read").alias("read2"), F.col("printed").alias("printed2"), F.col("at").alias("next"))
    met = repaired_forms(words).join(second, "half").where((F.col("next") >= F.col("to")) & (F.col("word") != F.col("key")))
    return met.select("key", "word", "n", "read", "printed", "read2", "printed2", F.col("first").alias("at"))


def asked_of_rest(rows: DataFrame, learned: Learned) -> DataFrame:
    """row and more: what every text needs of the counts that were not sent, but for pairs, joined by key. Texts that need nothing have no row."""
    model = learned.model
    forms = stored(misread_forms(learned.rest.where(F.col("kind") == "word")).drop("times"))
    # words that were sent and look like misread ones of the rest are asked for as well
    hit = forms.join(learned.words.select("key"), "key").select("key").union(deep_forms(learned.words, forms).select("key")).distinct()
    hit = {r["key"] for r in hit.collect()}
    shared = rows.sparkSession.sparkContext.broadcast((set(model.words) - hit, set(model.compounds), model.boundary))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, compounds, lines = shared.value
        for pdf in batches:
            out = []
            for i, t in zip(pdf["row"], pdf["text"], strict=True):
                low = t.lower()
                over = [re.split(f"[{HYPHENS}]", x) for x in (re.sub(rf"[{HYPHENS}][ \t\r]*\n\s*", "-", m) for m in BROKEN.findall(low))]
                cut = {a + b for parts in over for a, b in zip(parts, parts[1:], strict=False)}
                out += [(i, "word", w) for w in ({*TOKEN.findall(low)} | cut) - words]
                out += [(i, "compound", c) for c in ({*compound_keys(low)} | {"-".join(x) for x in over}) - compounds]
                out += [(i, "line", s) for s in {*edge_shapes(t)} - lines]
            yield pd.DataFrame(out, columns=["row", "kind", "key"])

    asked = stored(rows.mapInPandas(ask, "row long, kind string, key string"))
    columns = {"word": "string", "read": "string", "printed": "string", "read2": "string", "printed2": "string", "at": "int"}
    none = lambda *names: [F.lit(None).cast(columns[c]).alias(c) for c in names]
    told = learned.rest.where(F.col("kind") != "pair").select("kind", "key", "n", *none(*columns))
    once = forms.select(F.lit("word").alias("kind"), "key", "n", "word", "read", "printed", *none("read2", "printed2"), "at")
    twice = deep_forms(asked.where(F.col("kind") == "word").select("key").distinct(), forms).select(F.lit("word").alias("kind"), "key", "n", *columns)
    hits = asked.join(told.unionByName(once).unionByName(twice), ["kind", "key"])
    return hits.groupBy("row").agg(F.collect_list(F.struct("kind", "key", "n", *columns)).alias("more"))  # of one text


def pairs_of_rest(texts: DataFrame, learned: Learned, sent: Callable[[], Model]) -> DataFrame:
    """row and linked: the pairs among the readings of a text's words (columns row, text, more) that were not sent."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent()
        for pdf in batches:
            out = []
            for i, t, more in zip(pdf["row"], pdf["text"], pdf["more"], strict=True):
                own.told(() if more is None else more, ())
                own.wanted = set()
                own.analyse(t)
                out += [(i, x) for x in own.wanted]
            yield pd.DataFrame(out, columns=["row", "key"])

    rest = learned.rest.where(F.col("kind") == "pair").select("key", "n")
    return texts.mapInPandas(ask, "row long, key string").join(rest, "key").groupBy("row").agg(F.collect_list(F.struct("key", "n")).alias("linked"))


def repair(rows: DataFrame, learned: Learned) -> DataFrame:
    """id, marks (line_no, kind) and repaired text of every row (columns id, row, text)."""
    kind, model = dict(rows.dtypes)["id"], learned.model
    shared = rows.sparkSession.sparkContext.broadcast((model.words, model.pairs, model.compounds, model.boundary, model.total, model.channel))
    sent = lambda: Model(*shared.value)
    if learned.rest is None:
        texts = rows.select("id", "text", *(F.lit(None).cast("array<struct<kind string>>").alias(c) for c in ("more", "linked")))
    else:
        more = stored(asked_of_rest(rows, learned))
        texts = rows.join(more, "row", "left")
        texts = texts.join(pairs_of_rest(texts, learned, sent), "row", "left").select("id", "text", "more", "linked")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent()
        for pdf in batches:
            out = []
            for i, t, more, linked in zip(pdf["id"], pdf["text"], pdf["more"], pdf["linked"], strict=True):
                own.told(() if more is None else more, () if linked is None else linked)
                marks, fixed = own.analyse(t)
                out.append((i, [{"line_no": n, "kind": k} for n, k in marks], fixed))
            yield pd.DataFrame(out, columns=["id", "marks", "repaired"])

    return texts.mapInPandas(run, f"id {kind}, marks array<struct<line_no int, kind string>>, repaired string")


def numbered(rows: DataFrame) -> DataFrame:
    """rows (id, text) with a number and the hash of the text, stored once for the passes over them."""
    hashed = F.xxhash64("text") if "text_hash" not in rows.columns else F.col("text_hash")
    return spread(stored(rows.where(F.col("text").isNotNull()).select("id", "text", hashed.alias("text_hash"), F.monotonically_increasing_id().alias("row"))))


def prose_rows(df: DataFrame, key: str, text: str, types: DataFrame) -> DataFrame:
    """id, text, text_hash and row of the rows that types (id, text_type) calls prose."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return numbered(rows.join(types.where(F.col("text_type") == "prose").select("id"), "id", "left_semi"))
