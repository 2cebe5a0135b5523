"""Language of documents and of their segments, by Bayesian evidence fusion (problem 9).

Three sources of evidence are multiplied:

* the text: sums over words of log likelihoods of the word and its character 1- to 3-grams, learned by
  expectation-maximization from declared labels that are partly wrong;
* the declared language (markup): how often each label is declared for each true language, learned too;
* the address (source) of the document: a prior over languages by grouped aggregation over all documents,
  the host's counts smoothed towards those of its address suffix (the part behind the last dot), and these
  towards those of the whole corpus. A source without a suffix is smoothed towards the corpus at once.

Sentences are the units; a hidden Markov chain over a text's sentences (leaving a language costs
``switch``) gives the segments, its posterior the confidence.

The text model is fitted on a bounded sample: about ``fit_rows`` labelled rows, those with a hash below a share
of all that their number sets, and of each a stretch of ``fit_chars`` characters from a place the hash sets. So
what reaches the driver does not grow with the rows or their partitions. Priors and decisions cover all rows
and whole texts.

Defined results: null and blank texts give no rows. A text without any evidence gets the language that
declaration and prior make likeliest, with that confidence. Repeated rows are labelled each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.session import cut, spread

# fixed values: two-letter codes and the three-letter codes that name the same language
LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "ru", "zh")
THREE = {
    "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt",
    "ita": "it", "nld": "nl", "dut": "nl", "rus": "ru", "zho": "zh", "chi": "zh",
}
SENTENCE_END = re.compile(r"(?<=[.!?])[\"'”“»)\]]*\s+|(?<=[。！？])\s*|\n[ \t\r]*\n\s*")
WORD = re.compile(r"[^\W\d_\u3040-\u9fff]+|[\u3040-\u9fff]")  # scripts without blanks: each character
NO_WORDS = re.compile(r"https?://\S+|<[^<>\n]{1,80}>|&\w{1,10};|\\[a-zA-Z]+")
ADDRESS_SUFFIX = r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?[^/:?#\s]*\.([a-z]{2,})(?:[:/?#].*)?$"
BINS = 1 << 17
CLIP = 3.0
MEMORY = 300_000


def declared_code(name: str = "lang") -> Column:
    """The two-letter code that a label states (any case, a region, three letters), else null."""
    base = F.regexp_extract(F.lower(F.trim(F.col(name))), r"^([a-z]{2,3})(?:[-_][a-z0-9-_]+)?$", 1)
    pairs = [x for a, b in THREE.items() for x in (F.lit(a), F.lit(b))]
    code = F.coalesce(F.element_at(F.create_map(*pairs), base), base)
    return F.when(code.rlike("^[a-z]{2}$"), code)


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of the sentences; stretches without words (rules, addresses, tags) join their neighbour."""
    out: list[tuple[int, int, list[str]]] = []
    at = begun = 0
    for end in [*(m.end() for m in SENTENCE_END.finditer(text)), len(text)]:
        if end > at:
            words = WORD.findall(NO_WORDS.sub(" ", text[at:end]).lower())
            at = end
            if words:
                out.append((begun, end, words))
                begun = end
    if begun < len(text) and out:
        out[-1] = (out[-1][0], len(text), out[-1][2])
    elif not out and text.strip():
        out.append((0, len(text), []))
    return out


def features(word: str) -> list[int]:
    """Bins of the word itself and of its 1- to 3-grams."""
    w = f"^{word}$"
    grams = {w, *word, *(w[i : i + 2] for i in range(len(w) - 1)), *(w[i : i + 3] for i in range(len(w) - 2))}
    out = []
    for g in grams:
        h = 2166136261
        for c in g:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        out.append((h ^ h >> 15) % BINS)
    return out


@dataclass
class TextModel:
    """Log likelihoods of bins by language, and of declared labels by true language."""

    languages: tuple[str, ...]
    bins: np.ndarray  # float16, BINS x languages
    declared: np.ndarray  # log P(label | language), the last column for no usable label
    numbers: dict[str, int] = field(default_factory=dict, repr=False)
    known: np.ndarray | None = field(default=None, repr=False)  # scores of the words seen so far, by number

    def scores(self, words: list[str]) -> np.ndarray:
        """Log likelihoods of words (rows), shifted so that the best language has 0."""
        if self.known is None or len(self.numbers) > MEMORY:
            self.numbers, self.known = {}, np.zeros((1024, len(self.languages)))
        for w in words:
            if w not in self.numbers:
                k = self.numbers[w] = len(self.numbers)
                if k >= len(self.known):
                    self.known = np.vstack([self.known, np.zeros_like(self.known)])
                v = self.bins[features(w)].astype(np.float64).mean(axis=0) * 2
                self.known[k] = np.maximum(v - v.max(), -CLIP)
        return self.known[[self.numbers[w] for w in words]]

    def segments(self, texts: list[str], declared: list[str | None], priors: np.ndarray, switch: float) -> list[list[tuple[str, float, int, int]]]:
        """Of each text the (language, confidence, start, end) of its maximal stretches of one language.

        The chains of all texts run side by side, the longest first, so a step costs one operation for all of them.
        """
        found = [sentences(t) for t in texts]
        order = sorted(range(len(texts)), key=lambda d: -len(found[d]))
        order = order[: sum(bool(x) for x in found)]
        if not order:
            return [[] for _ in texts]
        n = len(self.languages)
        sizes = np.array([len(found[d]) for d in order])
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))  # where the sentences of each text begin
        flat = [x[2] for d in order for x in found[d]]
        full = [t for t, words in enumerate(flat) if words]
        emit = np.zeros((len(flat), n))
        if full:
            starts = np.cumsum([0, *(len(flat[t]) for t in full[:-1])])
            emit[full] = np.add.reduceat(self.scores([w for t in full for w in flat[t]]), starts, axis=0)
        label = [self.languages.index(x) if (x := declared[d]) in self.languages else n for d in order]
        emit[at] += np.log(priors[order]) + self.declared[:, label].T
        stay, leave = 1 - switch, switch / (n - 1)
        log_stay, log_leave = np.log(stay), np.log(leave)
        # forward and backward with scaled probabilities, and the best path; a move costs the same between any two languages
        chance = np.exp(emit - emit.max(axis=1, keepdims=True)) + 1e-280
        ahead, behind, came = np.empty_like(chance), np.ones_like(chance), np.empty(chance.shape, np.int16)
        best, own = emit[at], np.arange(n)
        ahead[at] = chance[at] / chance[at].sum(axis=1, keepdims=True)
        active = [int((sizes > t).sum()) for t in range(int(sizes[0]) + 1)]
        for t in range(1, int(sizes[0])):
            now = at[: active[t]] + t
            a = chance[now] * ((stay - leave) * ahead[now - 1] + leave)
            ahead[now] = a / a.sum(axis=1, keepdims=True)
            b = best[: active[t]]
            top = b.argmax(axis=1)
            moved = b[np.arange(len(b)), top][:, None] + log_leave
            kept = b + log_stay >= moved
            came[now] = np.where(kept, own, top[:, None])
            best[: active[t]] = np.where(kept, b + log_stay, moved) + emit[now]
        path = np.empty(len(flat), np.int16)
        path[at + sizes - 1] = best.argmax(axis=1)
        for t in range(int(sizes[0]) - 2, -1, -1):
            now = at[: active[t + 1]] + t
            b = chance[now + 1] * behind[now + 1]
            b = (stay - leave) * b + leave * b.sum(axis=1, keepdims=True)
            behind[now] = b / b.sum(axis=1, keepdims=True)
            path[now] = came[now + 1, path[now + 1]]
        sure = ahead * behind
        sure = sure[np.arange(len(flat)), path] / sure.sum(axis=1)
        new = np.ones(len(flat), bool)
        new[1:] = path[1:] != path[:-1]
        new[at] = True
        out: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
        for k, d in enumerate(order):
            begins = np.flatnonzero(new[at[k] : at[k] + sizes[k]]).tolist()
            for a, b in zip(begins, [*begins[1:], len(found[d])], strict=True):
                out[d].append((self.languages[path[at[k] + a]], float(sure[at[k] + a : at[k] + b].mean()), found[d][a][0], found[d][b - 1][1]))
        return out


def fit(labelled: list[tuple[str, str]], languages: Sequence[str] = LANGUAGES, rounds: int = 4) -> TextModel:
    """Expectation-maximization over the sentences of (text, declared language) pairs."""
    languages = tuple(languages)
    n, number, ids, owner, label = len(languages), {}, [], [], []
    for text, lang in labelled:
        for _, _, found in sentences(text):
            if found:
                ids += [number.setdefault(w, len(number)) for w in found]
                owner += [len(label)] * len(found)
                label.append(languages.index(lang))
    ids_, owner_, label_ = np.array(ids, int), np.array(owner, int), np.array(label, int)
    bins_of = [features(w) for w in number]
    flat, word_of = np.array([b for f in bins_of for b in f], int), np.repeat(np.arange(len(number)), [len(f) for f in bins_of])
    per_word = np.maximum(np.bincount(word_of, minlength=len(number)), 1)
    resp = np.eye(n)[label_] * 0.9 + 0.1 / n if len(label_) else np.zeros((0, n))
    logs, confusion = np.zeros((BINS, n)), np.eye(n) * 0.8 + 0.2 / n
    for _ in range(rounds if len(label_) else 0):
        for j in range(n):
            by_word = np.bincount(ids_, weights=resp[owner_, j], minlength=len(number))
            by_bin = np.bincount(flat, weights=by_word[word_of], minlength=BINS)
            logs[:, j] = np.log((by_bin + 0.05) / (by_bin.sum() + 0.05 * BINS))
        share = np.stack([np.bincount(label_, weights=resp[:, j], minlength=n) for j in range(n)]) + 1
        confusion = share / share.sum(axis=1, keepdims=True)
        words = np.stack([np.bincount(word_of, weights=logs[flat, j], minlength=len(number)) / per_word * 2 for j in range(n)], axis=1)
        words = np.maximum(words - words.max(axis=1, keepdims=True), -CLIP)
        text = np.stack([np.bincount(owner_, weights=words[ids_, j], minlength=len(label_)) for j in range(n)], axis=1)
        post = text + np.log(confusion[:, label_].T) + np.log(resp.mean(axis=0) + 1e-6)
        resp = np.exp(post - np.logaddexp.reduce(post, axis=1)[:, None])
    unlabelled = np.full((n, 1), 0.2)
    return TextModel(languages, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float16), np.log(np.hstack([confusion * 0.8, unlabelled])))


def _parts(pdf: pd.DataFrame, most: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Runs of rows with about ``most`` characters, at least one row each."""
    number = (pdf["text"].str.len().cumsum() // most).to_numpy()
    for k in np.unique(number):
        yield pdf[number == k]


def assign_languages(
    docs: DataFrame, doc: str, text: str, declared: str, host: str, languages: Sequence[str] = LANGUAGES, fit_rows: int = 8000, fit_chars: int = 3000, switch: float = 0.01, weight: float = 50.0, salts: int = 16, broadcast_hosts: int = 10_000
) -> DataFrame:
    """doc_id, seg_no, lang, confidence, start_pos, end_pos, segments, declared_right of every segment."""
    languages = tuple(languages)
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host"), declared_code(declared).alias("declared"))
    usable = F.col("declared").isin(*languages) & F.col("text").isNotNull()
    labelled = rows.where(usable)
    n = labelled.count()
    mark = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 40))
    part = F.substr("text", (F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - fit_chars, F.lit(0)) + 1) + 1).cast("int"), F.lit(fit_chars))
    sample = labelled.where(mark < int((1 << 40) * min(1.0, fit_rows / max(n, 1)))).select(part.alias("text"), "declared").limit(2 * fit_rows)  # the limit bounds rows that share an id
    model = fit(sorted((r["text"], r["declared"]) for r in sample.collect()), languages)

    counts = [F.count_if(F.col("declared") == x).alias(f"n{i}") for i, x in enumerate(languages)]
    suffix = F.nullif(F.regexp_extract(F.lower("host"), ADDRESS_SUFFIX, 1), F.lit(""))
    by_host = cut(rows.groupBy("host").agg(*counts).withColumn("suffix", suffix))
    whole = [x or 0 for x in by_host.agg(*[F.sum(f"n{i}") for i in range(len(languages))]).first()]
    total = sum(whole) or 1
    base = [(c + 1) / (total + len(languages)) for c in whole]
    of_suffix = by_host.where(F.col("suffix").isNotNull()).groupBy("suffix").agg(*[F.sum(f"n{i}").alias(f"s{i}") for i in range(len(languages))])
    n_host, n_suffix = (sum((F.coalesce(F.col(f"{x}{i}"), F.lit(0)) for i in range(len(languages))), F.lit(0)) for x in "ns")
    above = [(F.coalesce(F.col(f"s{i}"), F.lit(0)) + weight * b) / (n_suffix + weight) for i, b in enumerate(base)]
    prior = F.array(*[(F.col(f"n{i}") + weight * a) / (n_host + weight) for i, a in enumerate(above)]).alias("prior")
    by_host = by_host.join(of_suffix, "suffix", "left")
    known = by_host.where(F.col("host").isNotNull())
    told = spread(rows.where(F.col("text").isNotNull() & (F.length(F.trim("text")) > 0)))
    if known.count() <= broadcast_hosts:  # at most 1 MB
        told = told.join(F.broadcast(known.select("host", prior)), "host", "left")
    else:  # a host may own a third of the documents: its rows are salted, the priors repeated per salt
        salted = known.select("host", prior, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        told = told.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")
    told = told.select("doc_id", "text", "declared", "prior")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "seg_no", "lang", "confidence", "start_pos", "end_pos", "segments", "declared_right"]
        for pdf in batches:
            out = []
            for part in _parts(pdf):
                own = part["declared"].tolist()
                priors = np.array([base if p is None else p for p in part["prior"]], float)
                for d, x, found in zip(part["doc_id"], own, model.segments(part["text"].tolist(), own, priors, switch), strict=True):
                    out += [(d, k, y, c, a, b, len(found), y == x) for k, (y, c, a, b) in enumerate(found)]
            yield pd.DataFrame(out, columns=names).astype({"seg_no": "int32", "confidence": "float64", "start_pos": "int32", "end_pos": "int32", "segments": "int32", "declared_right": "bool"})

    kind = dict(docs.dtypes)[doc]
    return told.mapInPandas(run, f"doc_id {kind}, seg_no int, lang string, confidence double, start_pos int, end_pos int, segments int, declared_right boolean")
