"""Evaluation passages leaking into documents (problem 8).

One Aho-Corasick automaton holds every normalised test text (questions and passages alike) and every run of
``seed`` words of them. A document is normalised by one substitution and scanned once; offsets lead back to the
original. A hit of a whole text settles it. The other hits say which item words may start where: hits of an item
that gather on neighbouring diagonals are settled by a local alignment over words, so altered, added and lost
words do not end a stretch, nor does an interruption of at most as many words as the item has. A document holds
an item if the aligned stretch has at least ``share`` of its words; each stretch that does is a row.

The automaton travels to the tasks, so its source is bounded: items are cut into blocks of about
``block_items`` by a hash of their id, and the documents are scanned once for each block.

Defined results: null, empty and blank documents or items give no rows; an item shorter than the seed
is sought as its whole. Repeated documents are reported each, items of equal text each. Very long texts
are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.session import spread

# a word, or markup that holds none: tags, entities, commands
WORD = re.compile(r"</?[a-zA-Z][^<>]{0,80}>|&#?[a-zA-Z0-9]{1,8};|\\[a-zA-Z]+|([^\W_]+)")
# what stands between words, markup included
BETWEEN = re.compile(r"(?:</?[a-zA-Z][^<>]{0,80}>|&#?[a-zA-Z0-9]{1,8};|\\[a-zA-Z]+|[\W_])+")


def words_of(text: str) -> list[str]:
    return [w for w in WORD.findall(text.lower()) if w]


class Scanner:
    """The automaton over one block of items: (key, text) pairs."""

    def __init__(self, items: list[tuple[object, str]], seed: int, share: float):
        import ahocorasick

        self.share, self.words = share, {}
        places: dict[str, list[tuple[object, int, int]]] = defaultdict(list)
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            self.words[item] = words
            n = min(seed, len(words))
            for k in range(len(words) - n + 1):
                places[" " + " ".join(words[k : k + n]) + " "].append((item, k, n))
            if len(words) > n:
                places[" " + " ".join(words) + " "].append((item, 0, len(words)))
        self.fewest = {item: self._fewest(len(words)) for item, words in self.words.items()}
        self.automaton = ahocorasick.Automaton()
        for pattern, found in places.items():
            where: dict[object, list[tuple[int, int]]] = {}
            for item, k, n in found:
                where.setdefault(item, []).append((k, n))
            whole = tuple(x for x, own in where.items() if any(n == len(self.words[x]) for _, n in own))
            self.automaton.add_word(pattern, (tuple(where), whole, where))
        if places:
            self.automaton.make_automaton()
        else:
            self.automaton = None

    def _fewest(self, n: int) -> float:
        """A matched half of n words still has this many unbroken seeds with every tenth word altered."""
        return max(1.0, min(self.share, 0.5) * 0.4 * n - 2)

    def scan(self, text: str) -> list[tuple[object, int, float, int, int]]:
        """(item, matched words, share of the item's words, start and end in the original text), by item and place."""
        if self.automaton is None:
            return []
        plain = " " + BETWEEN.sub(" ", text.lower()).strip() + " "
        raw = list(self.automaton.iter(plain))
        if not raw:
            return []
        times: Counter[object] = Counter()
        found: set[object] = set()
        for _, (some, whole, _) in raw:
            times.update(some)
            found.update(whole)
        # an item that could reach its share has this many hits, or one of its whole text
        found.update(x for x, n in times.items() if n >= self.fewest[x])
        if not found:
            return []
        hits = {x: [(end, k, n) for end, (_, _, where) in raw if x in where for k, n in where[x]] for x in sorted(found, key=str)}
        gaps = [m.start() for m in re.finditer(" ", plain)]  # the k-th word stands behind the k-th blank
        spans: list[tuple[int, int]] = []
        words = plain.split()
        out = []
        for item, own_hits in hits.items():
            own = self.words[item]
            n = len(own)
            stretches = [(n, p, p + n) for end, _, m in own_hits if m == n for p in (bisect_left(gaps, end) - n,)]
            # hits inside a whole text are settled by it
            rest = [(p, k) for end, k, m in own_hits if m < n for p in (bisect_left(gaps, end) - m,) if not any(a <= p < b for _, a, b in stretches)]
            open_ = self._regions(rest, n)
            while open_:
                lo, hi = open_.pop()
                matched, a, b = align(own, words[lo:hi])
                if matched >= self.share * n:
                    if not any(lo + a < y and x < lo + b for _, x, y in stretches):
                        stretches.append((matched, lo + a, lo + b))
                    # what is left on both sides may hold the item again
                    open_ += [(x, y) for x, y in ((lo, lo + a), (lo + b, min(hi, len(words)))) if y - x >= self.share * n]
            if stretches and not spans:
                lowered = text.lower()
                spans = [m.span(1) for m in WORD.finditer(lowered if len(lowered) == len(text) else text) if m.group(1)]
            out += [(item, m, m / n, spans[a][0], spans[min(b, len(spans)) - 1][1]) for m, a, b in sorted(stretches, key=lambda x: x[1])]
        return out

    def _regions(self, pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
        """Stretches of the document worth aligning: where hits on neighbouring diagonals cover enough of the item."""
        width = max(8, n // 4)
        bands: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, k in pairs:
            band = (p - k) // width
            bands[band].append((p, k))
            bands[band + 1].append((p, k))
        enough = [(len({k for _, k in own}), min(p - k for p, k in own)) for own in bands.values()]
        starts = sorted({d for c, d in enough if c >= self._fewest(n)})
        merged: list[list[int]] = []
        for d in starts:
            lo, hi = max(0, d - n // 2), d + 2 * n + width
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(hi, merged[-1][1])
            else:
                merged.append([lo, hi])
        return [(lo, hi) for lo, hi in merged]


JUMP = 8


def align(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """Local alignment of words (match 1, mismatch and gap -1): words matched, and the stretch of b it covers.

    Any number of words put between two parts of the passage costs at most ``JUMP``, so a passage that
    something else interrupts is one stretch, while phrases in common are too short to earn the jump.
    """
    best = (0, 0, 0, 0)
    n = len(b)
    score, match, start = [0] * (n + 1), [0] * (n + 1), list(range(n + 1))
    for wa in a:
        s0, m0, b0 = score, match, start
        score, match, start = [0] * (n + 1), [0] * (n + 1), list(range(n + 1))
        left, far = 0, (0, 0, 0)  # the best end of the passage so far anywhere before
        for y in range(1, n + 1):
            if s0[y - 1] > far[0]:
                far = (s0[y - 1], m0[y - 1], b0[y - 1])
            if wa == b[y - 1]:
                s, m, st = s0[y - 1] + 1, m0[y - 1] + 1, b0[y - 1] if s0[y - 1] > 0 else y - 1
                if far[0] - JUMP >= s:
                    s, m, st = far[0] - JUMP + 1, far[1] + 1, far[2]
            else:
                s, m, st = s0[y - 1] - 1, m0[y - 1], b0[y - 1]
            if s0[y] - 1 > s:
                s, m, st = s0[y] - 1, m0[y], b0[y]
            if left - 1 > s:
                s, m, st = left - 1, match[y - 1], start[y - 1]
            if s <= 0:
                left = 0
                continue
            score[y], match[y], start[y] = s, m, st
            left = s
            if s > best[0]:
                best = (s, m, st, y)
    return best[1], best[2], best[3]


def find_leaks(
    docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, passages: list[str], seed: int = 3, share: float = 0.5, block_items: int = 20_000
) -> DataFrame:
    """doc_id, item_id, passage, stretch, matched, share, start_pos, end_pos: every stretch of a document that holds an item.

    Stretches of one item in one document are numbered from 0 by place, so stretch 0 stands for (document, item, passage).
    """
    total = items.count() * len(passages)
    blocks = max(1, -(-total // (block_items // 2)))
    rows = spread(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.length(F.trim("text")) > 0)))
    doc_kind, item_kind = dict(docs.dtypes)[doc], dict(items.dtypes)[item]
    names = ["doc_id", "item_id", "passage", "stretch", "matched", "share", "start_pos", "end_pos"]

    def one(block: int) -> DataFrame:
        mine = items.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == block).select(item, *passages)
        listed = [((r[0], p), t) for r in mine.collect() for p, t in zip(passages, r[1:], strict=True) if t is not None]  # about block_items at most

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scanner = Scanner(listed, seed, share)
            for pdf in batches:
                out = []
                for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                    count: Counter[object] = Counter()
                    for key, *found in scanner.scan(t):
                        out.append((d, *key, count[key], *found))
                        count[key] += 1
                yield pd.DataFrame(out, columns=names).astype({"stretch": "int32", "matched": "int32", "share": "float64", "start_pos": "int32", "end_pos": "int32"})

        return rows.mapInPandas(run, f"doc_id {doc_kind}, item_id {item_kind}, passage string, stretch int, matched int, share double, start_pos int, end_pos int")

    return reduce(DataFrame.unionByName, [one(b) for b in range(blocks)])
