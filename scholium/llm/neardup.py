"""Near-duplicate texts with small edits, insertions or reordering (problem 3).

Order MinHash: a sketch takes the ``sample`` smallest occurrence-labelled k-mers (here words) of a text
under one hash and keeps them in text order; texts that share a sketch are candidates. Whole sentences
that change places would break the order, so each text is first brought into a canonical sentence order.
Frequent words tell little; each k-mer's hash is weighted by how rare its word is in the collection, from
counts over all rows in a fixed number of bins.

Texts with equal word sets form one class, so copies meet in the collection once; a class's sketches lead
to its candidates, the candidates are checked exactly (share of common words, ``threshold`` or more), and
the banded alignment of two word sequences gives their edit similarity where it is asked for.

Candidates come from distinct (class, sketch) rows: copies are gone by then. Small buckets are paired as
they stream past, large ones by a join that is split over tasks. No bucket is capped. Chance candidates grow with
the square of the collection, so a pair is judged where it meets: each row brings the size of its word set and 128
parity bits, each the parity of the number of its words with that bit. Where two sets differ in d words, at most d
bits and their sizes by at most d differ, so what these rule out is surely below ``threshold``, and only the rest is
written. The sketches are drawn ``ROUND`` at a time, and the shuffle of a round is gone when the next begins.
Words are compared by 32-bit hashes, classes by 64-bit ones.

Defined results: rows with a null id or text take no part; repeated rows count once; texts without any
word (empty, blank, punctuation) are alike only among themselves and give no pairs. Other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.session import spread, stored

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n\s*\n")
BINS = 1 << 16
MEMORY = 400_000
CELLS = 1 << 18
ROUND = 10
BITS = ("size", "low", "high")
U = np.uint64


class Hashes(dict):
    """Word -> 32-bit hash, remembered per worker."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh32_intdigest(word) - (1 << 31)
        return h


def word_hashes(text: str, known: Hashes) -> list[int]:
    """Word hashes of a text, its sentences brought into an order that does not depend on where they stand."""
    get, parts = known.__getitem__, []
    for sentence in SENTENCE.split(text.lower()):
        if words := WORD.findall(sentence):
            part = list(map(get, words))
            parts.append((min(part), part))
    parts.sort()
    return [h for _, part in parts for h in part]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def sketches(values: np.ndarray, starts: np.ndarray, weights: np.ndarray, count: int, sample: int, k: int, first: int = 0) -> np.ndarray:
    """count sketches of each text, from number first on. values: all word hashes one after another; starts: where each text begins."""
    n, docs = len(values), len(starts)
    owner = np.repeat(np.arange(docs), np.diff(np.append(starts, n)))
    base = values.astype(np.int64).astype(U)
    rare = weights[(values.astype(np.int64) & (BINS - 1))]
    mer = base.copy()
    for j in range(1, k):  # k-mers run over the text's end into nothing
        nxt = np.zeros(n, U)
        nxt[:-j] = base[j:]
        same = np.zeros(n, bool)
        same[:-j] = owner[j:] == owner[:-j]
        mer = _mix(mer * U(31) + np.where(same, nxt, U(0)))
    order = np.lexsort((mer, owner))
    new = np.ones(n, bool)
    new[1:] = (mer[order][1:] != mer[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    run = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    seen = np.empty(n, np.int64)
    seen[order] = run
    mer = _mix(mer + U(0x9E3779B97F4A7C15) * (seen.astype(U) + U(1)))
    out = np.empty((docs, count), np.int64)
    spins = _mix(np.arange(2 * first + 1, 2 * (first + count) + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    lengths = np.diff(np.append(starts, n))
    by_length = np.argsort(lengths, kind="stable")
    a = 0
    while a < docs:  # texts of like length lie in one padded block of at most CELLS cells
        b = min(docs, a + max(1, CELLS // max(1, int(lengths[by_length[a]]))))
        while b - a > 1 and (b - a) * int(lengths[by_length[b - 1]]) > CELLS:
            b = a + max(1, (b - a) * 3 // 4)
        mine = by_length[a:b]
        width = max(int(lengths[mine[-1]]), sample)
        place = starts[mine][:, None] + np.arange(width)
        real = np.arange(width) < lengths[mine][:, None]
        place = np.where(real, place, 0)
        keys, weight = np.where(real, mer[place], U(0)), np.where(real, rare[place], np.float32(1e-12)).astype(np.float32)
        rows = np.arange(len(mine))[:, None]
        for c in range(count):
            u = ((keys * spins[2 * c] + spins[2 * c + 1]) >> U(40)).astype(np.float32)
            rank = -np.log((u + np.float32(1)) * np.float32(1 / ((1 << 24) + 1))) / weight
            flat = np.flatnonzero(rank <= np.partition(rank, sample - 1, axis=1)[:, sample - 1 : sample])
            if len(flat) == len(mine) * sample:  # in text order already
                chosen = keys.ravel()[flat].reshape(-1, sample)
            else:  # ties
                picked = np.sort(np.argsort(rank, axis=1, kind="stable")[:, :sample], axis=1)
                chosen = keys[rows, picked]
            key = np.full(len(mine), spins[2 * c], U)
            for s in range(sample):
                key = _mix(key * U(0x100000001B3) + chosen[:, s])
            out[mine, c] = key.astype(np.int64)
        a = b
    return out


def parity_bits(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, low, high) of each text's word set: its distinct words, and 128 bits of their parities. No text is empty."""
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[new], o[new]
    begins = np.searchsorted(o, np.arange(len(starts)))
    bit = _mix(v.astype(np.int64).astype(U)) >> U(57)
    one = U(1) << (bit & U(63))
    low, high = (np.bitwise_xor.reduceat(np.where(bit >> U(6) == U(half), one, U(0)), begins) if len(v) else np.empty(0, U) for half in (0, 1))
    return np.diff(np.append(begins, len(v))).astype(np.int32), low.view(np.int64), high.view(np.int64)


def align_banded(a: np.ndarray, b: np.ndarray, band: int = 32) -> float:
    """Edit similarity of two word sequences: 1 - distance / length of the longer, exact up to band edits off the diagonal."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    band = max(band, abs(n - m) + 1)
    far = n + m
    row = np.minimum(np.arange(m + 1), far).astype(np.int64)
    row[band + 1 :] = far
    steps = np.arange(m + 1)
    for i in range(1, n + 1):
        lo, hi = max(1, i - band), min(m, i + band)
        new = np.full(m + 1, far, np.int64)
        if i <= band:
            new[0] = i
        body = np.minimum(row[lo - 1 : hi] + (b[lo - 1 : hi] != a[i - 1]), row[lo : hi + 1] + 1)
        span = np.concatenate(([new[lo - 1]], body)) - steps[lo - 1 : hi + 1]
        new[lo - 1 : hi + 1] = np.minimum.accumulate(span) + steps[lo - 1 : hi + 1]
        row = new
    return 1 - min(int(row[m]), max(n, m)) / max(n, m)


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.8, count: int = 40, sample: int = 4, k: int = 1, edit: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has id and class_id; links has class_a < class_b of different classes and jaccard.

    edit: links also have edit_similarity, from the banded alignment of the canonical word sequences.
    """
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    kind = dict(rows.dtypes)["id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids, classes, offsets, flat = [], [], [0], []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    seq = word_hashes(t, known)
                    if seq:
                        ids.append(i)
                        classes.append(xxhash.xxh64_intdigest(array("i", sorted(set(seq))).tobytes()) - (1 << 63))
                        flat += seq
                        offsets.append(len(flat))
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(classes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))], names=["id", "class_id", "seq"])

    tokens = stored(spread(rows).mapInArrow(read, f"id {kind}, class_id long, seq array<int>"), tidy=True)
    members = tokens.select("id", "class_id").distinct()
    orders = stored(tokens.select("class_id", "seq").distinct(), tidy=True)  # sketches depend on order and repeats, a class on neither
    classes = orders.groupBy("class_id").agg(F.min("seq").alias("seq"))

    total, weights = max(tokens.count(), 1), np.ones(BINS)
    bins = tokens.select(F.explode(F.array_distinct(F.transform("seq", lambda w: w.bitwiseAND(BINS - 1)))).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    for r in bins.collect():  # at most BINS rows, whatever the size of the collection
        weights[r["bin"]] = min(1.0, 0.05 * total / r["n"])
    weights = weights.astype(np.float32)

    def draw(first: int, some: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    batch = whole.slice(at, 2048)
                    seq = batch.column(1)
                    lengths = np.diff(seq.offsets.to_numpy())
                    values = seq.flatten().to_numpy(zero_copy_only=False)
                    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
                    found = sketches(values, starts, weights, some, sample, k, first)
                    own = (batch.column(0).to_numpy(zero_copy_only=False), *parity_bits(values, starts))
                    ids, *bits = (pa.array(np.repeat(x, some)) for x in own)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(found.ravel()), *bits], names=["class_id", "sketch", *BITS])

        return orders.mapInArrow(run, "class_id long, sketch long, size int, low long, high long")

    met = [bucket_pairs(draw(first, min(ROUND, count - first)), threshold=threshold) for first in range(0, count, ROUND)]
    pairs = reduce(DataFrame.unionByName, met).distinct()
    distinct = F.array_distinct("seq")
    a = classes.select(F.col("class_id").alias("class_a"), F.col("seq").alias("seq_a"), distinct.alias("set_a"))
    b = classes.select(F.col("class_id").alias("class_b"), F.col("seq").alias("seq_b"), distinct.alias("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    links = pairs.join(a, "class_a").join(b, "class_b").withColumn("jaccard", common / (F.size("set_a") + F.size("set_b") - common)).where(F.col("jaccard") >= threshold - 1e-9)
    if not edit:
        return members, links.select("class_a", "class_b", "jaccard")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = [align_banded(np.asarray(x), np.asarray(y)) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sims, pa.float64())], names=["class_a", "class_b", "jaccard", "edit_similarity"])

    return members, links.select("class_a", "class_b", "jaccard", "seq_a", "seq_b").mapInArrow(measure, "class_a long, class_b long, jaccard double, edit_similarity double")


def bucket_pairs(hits: DataFrame, small: int = 256, threshold: float | None = None) -> DataFrame:
    """class_a < class_b that share a sketch, each pair once. hits: class_id, sketch; repeated combinations count once.

    One shuffle by sketch brings a bucket together and its rows stream past in order. Buckets of up to
    ``small`` classes are paired at once; the classes of a larger one are only passed on, and meet in a
    self-join that the adaptive skew join splits over tasks, so no bucket is held in memory and none is cut.
    threshold: hits also have the columns BITS, and pairs these show to be below threshold are left out.
    """
    extra = [] if threshold is None else list(BITS)
    share = 2.0 if threshold is None else (1 - threshold) / (1 + threshold) + 1e-8  # words in which two sets differ, of the words of both

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_sketch, is_large, last = [], None, False, None

        def rows(a: np.ndarray, b: np.ndarray | None, own: np.ndarray | None = None, sketch: int | None = None) -> pa.RecordBatch:
            null = pa.nulls(len(a), pa.int64())
            more = [null] * len(extra) if own is None else [pa.array(own[i + 1]) for i in range(len(extra))]
            columns = [pa.array(a), null if b is None else pa.array(b), null if sketch is None else pa.array(np.full(len(a), sketch)), *more]
            return pa.RecordBatch.from_arrays(columns, names=["class_a", "class_b", "sketch", *extra])

        def paired(own: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            if extra:
                size, low, high = own[1], own[2].view(U), own[3].view(U)
                most = share * (size[x] + size[y])
                left = np.flatnonzero((np.bitwise_count(low[x] ^ low[y]) <= most) & (np.abs(size[x] - size[y]) <= most))
                x, y, most = x[left], y[left], most[left]
                left = np.bitwise_count(low[x] ^ low[y]) + np.bitwise_count(high[x] ^ high[y]) <= most
                x, y = x[left], y[left]
            if len(x):
                yield rows(own[0][x], own[0][y])

        def passed(own: np.ndarray, sketch: int) -> Iterator[pa.RecordBatch]:
            if own.shape[1]:
                yield rows(own[0], None, own, sketch)

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            own = np.concatenate(held, axis=1)
            if is_large or own.shape[1] > small:
                yield from passed(own, open_sketch)
            elif own.shape[1] > 1:
                yield from paired(own, *np.triu_indices(own.shape[1], 1))

        for batch in batches:
            keys, *own = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for i in range(batch.num_columns))
            if not len(keys):
                continue
            own = np.stack(own)  # class, size, bits
            ids = own[0]
            fresh = np.concatenate(([(keys[0], ids[0]) != last], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])))
            last = keys[-1], ids[-1]
            own, keys = own[:, fresh], keys[fresh]
            if not len(keys):
                continue
            edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            sizes = np.diff(edges)
            first_ends, last_begins = edges[1], edges[-2]
            if open_sketch is not None and keys[0] == open_sketch:
                held.append(own[:, :first_ends])
                if sum(x.shape[1] for x in held) > small:
                    yield from passed(np.concatenate(held, axis=1), open_sketch)
                    held, is_large = [], True
                if len(sizes) == 1:
                    continue
                skip = 1
            else:
                skip = 0
            yield from close()
            inner = slice(skip, len(sizes) - 1)  # whole buckets inside this batch
            begins, n = edges[:-1][inner], sizes[inner]
            for size in np.unique(n[(n > 1) & (n <= small)]):
                at = begins[n == size][:, None] + np.arange(size)
                x, y = np.triu_indices(size, 1)
                yield from paired(own, at[:, x].ravel(), at[:, y].ravel())
            for begin, size in zip(begins[n > small], n[n > small], strict=True):
                yield from passed(own[:, begin : begin + size], int(keys[begin]))
            held, open_sketch, is_large = [own[:, last_begins:]], int(keys[-1]), False
        yield from close()

    near = hits.select("sketch", "class_id", *(F.col(c).cast("long") for c in extra)).repartition("sketch").sortWithinPartitions("sketch", "class_id")
    found = stored(near.mapInArrow(pair, ", ".join(f"{c} long" for c in ("class_a", "class_b", "sketch", *extra))), tidy=True)
    large = found.where(F.col("sketch").isNotNull())
    other = large.select("sketch", *(F.col(c).alias(f"{c}_b") for c in extra), F.col("class_a").alias("class_b"))
    met = large.drop("class_b").join(other, "sketch").where("class_a < class_b")
    if extra:
        most = share * (F.col("size") + F.col("size_b"))
        differ = F.bit_count(F.col("low").bitwiseXOR(F.col("low_b"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("high_b")))
        met = met.where((differ <= most) & (F.abs(F.col("size") - F.col("size_b")) <= most))
    return found.where(F.col("sketch").isNull()).select("class_a", "class_b").unionByName(met.select("class_a", "class_b")).distinct()


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs id_a < id_b of alike rows: pairs inside a class and pairs across linked classes."""
    a = members.select(F.col("id").alias("x"), F.col("class_id").alias("class_a"))
    b = members.select(F.col("id").alias("y"), F.col("class_id").alias("class_b"))
    inside = a.join(b, F.col("class_a") == F.col("class_b")).where("x < y").select("x", "y")
    across = links.join(a, "class_a").join(b, "class_b").select("x", "y")
    return inside.unionByName(across).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
