"""Per-text quality statistics and text types (problem 2).

A text is cut into blocks (pages, paragraphs). Statistics of a block, compared with thresholds, are noisy
labelling functions that vote for a type (prose, list, table, junk) or abstain. How far each function is
right is learned by expectation-maximization on their agreements (Dawid and Skene) over the counts of all
vote patterns, of which there is a fixed number, first between prose and the rest, then among the types of
the rest; each block gets posterior probabilities of the types, each text those of its blocks, weighted by
their characters.

Defined results: null and white-space-only texts give no row. A text of one repeated word or without letters
is junk, not an error. Very long texts are read whole. Statistics over pages are null where the number of
pages is null or below 1. Repeated rows and ids are typed each.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.session import cut, spread

TYPES = ("prose", "list", "table", "junk")
# fixed values: frequent function words of the languages of the corpus, without accents
COMMON = frozenset(
    """the of and to in a is that for it as with be on by this an are from or at which not we our its their has have been was were can than more when how each these such
    der die das und ist nicht mit dem den ein eine einer auf fur von zu sich wird im wir es auch dass als nach noch ob wer oder aus bei werden zur zum
    le la les des et est une un que pour dans sur avec ne pas par au aux cette ce nous qui plus sans du il
    el los las y en de del se no una con por mas su al lo para este esta como sin o segun
    os as do da dos das em um uma nao com na ao aos mais e se foi sao nos sem pelo pela
    il di che gli non per sono della dei alla nel anche piu si i questo
    het een van op te dat niet zijn voor met aan er om naar wordt ook deze die wij bij zonder of
    и в не на что с по для как это из от мы при без к так его""".split()
)
BLOCK = re.compile(r"\f|\n[ \t\r]*\n")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
NUMBER = re.compile(r"^[\W_]*\d[\d.,:%/+-]*[\W_]*$")
MARKER = re.compile(r"^\s*(?:\[\d+\]|\(?\d{1,3}[.)]\s|[-*•·‣–+]\s|\(?[a-zA-Z]\)\s)")
ODD_INSIDE = re.compile(r"[^\W\d_][^\w\s'’.,;:()\[\]/&@*_\-–—\"“”…!?-][^\W\d_]|�|[^\W\d_]\d[^\W\d_]|[a-z][;,(/^][a-z]|^[;,(/^][a-z]")
STRANGE = re.compile(r"[�\x80-\x9f¡-¿‡†€™œŒÐÑðþÞ‚„ˆ˜Â]")
WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
GAP = re.compile(r"(?<=\S) {2,}(?=\S)")
END = re.compile(r"[.!?。！？][\"'”»)\]]*$")


def fold_ascii(word: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


# what a token says, the same wherever it stands: words, letters, common words, capitalised words, then 1 or 0 for a
# number, an odd inside, the end of a sentence, a single character; the folded words; and plain letters without marks
Facts = tuple[int, int, int, int, int, int, int, int, tuple[str, ...], int]


def facts(token: str) -> Facts:
    words = WORD.findall(token)
    lower = tuple(w.lower() if w.isascii() else fold_ascii(w.lower()) for w in words)
    return (
        len(words), sum(map(len, words)), sum(w in COMMON for w in lower), sum(w[:1].isupper() for w in words), int(NUMBER.match(token) is not None), int(ODD_INSIDE.search(token) is not None),
        int(END.search(token) is not None), int(len(token) == 1), lower, sum(map(str.isalpha, token)),
    )


class Reader:
    """Votes on blocks, with the facts of the tokens met so far at hand."""

    def __init__(self, most: int = 300_000):
        self.known: dict[str, Facts] = {}
        self.most = most

    def of(self, token: str) -> Facts:
        got = self.known.get(token)
        if got is None:
            if len(self.known) > self.most:
                self.known.clear()
            got = self.known[token] = facts(token)
        return got

    def is_row(self, line: str) -> bool:
        """Whether a line is laid out in columns: tabs, bars, or two numbers of which one is last."""
        if "\t" in line or line.count("|") >= 2:
            return True
        tokens = line.split()
        return self.of(tokens[-1])[4] == 1 and sum(self.of(t)[4] for t in tokens) >= 2

    def votes(self, block: str) -> tuple[tuple[int, ...], list[int]]:
        """(the labelling functions' votes, the number of a type or -1 for none; the block's counts in the order of COUNTS)."""
        lines = [x for x in block.split("\n") if x.strip()]
        tokens = block.split()
        n, dense = len(tokens), sum(map(len, tokens))
        often = Counter(tokens)
        words = letters = usual = capitals = numbers = odds = stops = single = bare = 0
        kinds: set[str] = set()
        for t, k in often.items():
            w, a, c, u, m, o, e, s, lower, x = self.of(t)
            words, letters, usual, capitals = words + k * w, letters + k * a, usual + k * c, capitals + k * u
            numbers, odds, stops, single = numbers + k * m, odds + k * o, stops + k * e, single + k * s
            bare += k * x
            kinds.update(lower)
        wide = len(WIDE.findall(block)) if not block.isascii() else 0
        alpha, is_wide = letters / dense, wide > 0.3 * dense
        common, numeric = usual / max(1, words), numbers / n
        odd = 0.0 if is_wide else odds / n
        strange = 0.0 if block.isascii() else len(STRANGE.findall(block)) / dense
        per_line = n / len(lines)
        marked = sum(MARKER.match(x) is not None for x in lines) / len(lines)
        columns = sum(map(self.is_row, lines)) / len(lines) if len(lines) >= 3 else 0.0
        mean, singles = dense / n, single / n
        distinct = len(kinds) / words if words else len(often) / n
        long_run = sum(len(t) * k for t, k in often.items() if len(t) > 24) / dense
        per_stop = n / max(1, stops)
        capital = capitals / max(1, words)
        gaps = len(GAP.findall(block)) / max(1, n - 1)
        ended = sum(END.search(x.rstrip()) is not None for x in lines)
        P, L, T, J = range(4)
        vote = (
            P if is_wide or common >= 0.2 else J if common < 0.04 and n >= 8 else -1,
            P if stops and 5 <= per_stop <= 45 and capital < 0.45 or is_wide and stops else -1,
            T if numeric >= 0.3 else -1,
            T if columns >= 0.6 and len(lines) >= 3 else -1,
            L if marked >= 0.5 and len(lines) >= 3 else -1,
            L if per_line <= 3 and len(lines) >= 4 and numeric < 0.3 else -1,
            P if is_wide and stops else J if (mean > 14 or long_run > 0.4) and not is_wide else P if 3 <= mean <= 10 and singles < 0.2 else -1,
            J if singles > 0.5 and n >= 8 and not is_wide else -1,
            P if is_wide and len(set(block)) > 15 else J if distinct < 0.15 and n >= 12 else P if distinct > 0.4 and n >= 12 else -1,
            J if odd >= 0.2 else P if odd < 0.05 and (n >= 8 or is_wide) else -1,
            J if strange >= 0.08 else -1,
            J if alpha < 0.45 and numeric < 0.2 and not is_wide else P if alpha > 0.85 and common >= 0.1 or is_wide and stops else -1,
            J if gaps > 0.5 and n >= 8 else -1,
        )
        return vote, [n, dense, bare, words, usual, len(lines), ended]


COUNTS = ("tokens", "dense", "letters", "words", "usual", "lines", "ended")
FUNCTIONS = 13
PRIOR = 0.3  # weight of the belief that a function votes for its own type, as a share of the blocks that are no prose


def pack(vote: tuple[int, ...]) -> int:
    out = 0
    for v in vote:
        out = out * 5 + v + 1
    return out


def unpack(code: int) -> list[int]:
    out = []
    for _ in range(FUNCTIONS):
        code, v = divmod(code, 5)
        out.append(v - 1)
    return out[::-1]


def learn(patterns: dict[int, float], rounds: int = 25) -> tuple[dict[int, list[float]], list[list[list[float]]]]:
    """Posterior of the types for each vote pattern, and each function's confusion, by expectation-maximization."""
    codes = sorted(patterns)
    if not codes:
        return {}, []
    weight = np.array([patterns[c] for c in codes], float)
    vote = np.array([unpack(c) for c in codes])
    k = len(TYPES)
    # two classes, prose and not prose, and what each function says in them, abstaining included
    natural = (vote == 0).sum(axis=1)
    other = (vote > 0).sum(axis=1)
    post = np.stack([natural + 0.1, 2.0 * other + 0.1], axis=1)
    post /= post.sum(axis=1, keepdims=True)
    table = np.zeros((FUNCTIONS, 2, k + 1))
    for _ in range(rounds):
        share = (post * weight[:, None]).sum(axis=0) + 1
        logs = np.tile(np.log(share / share.sum()), (len(codes), 1))
        for f in range(FUNCTIONS):
            for v in range(-1, k):
                table[f, :, v + 1] = (post * (weight * (vote[:, f] == v))[:, None]).sum(axis=0) + 0.0005 * weight.sum()
            table[f] /= table[f].sum(axis=1, keepdims=True)
            logs += 0.7 * np.log(table[f][:, vote[:, f] + 1]).T
        two = np.exp(logs - np.logaddexp.reduce(logs, axis=1)[:, None])
        post = two
    if not rounds:
        return {c: [p, (1 - p) / 3, (1 - p) / 3, (1 - p) / 3] for c, (p, _) in zip(codes, post.tolist(), strict=True)}, table.tolist()
    # the types of the rest by the same procedure, each block counted as far as it is no prose. A weak prior says that a
    # function votes for its own type, or else a small type would be learned away
    rest = two[:, 1] * weight
    worth = np.stack([np.maximum(0.0, np.log(table[f, 1] / table[f, 0])) for f in range(FUNCTIONS)])
    kinds = np.full((len(codes), k - 1), 0.1)
    for f in range(FUNCTIONS):
        for t in range(1, k):
            kinds[vote[:, f] == t, t - 1] += worth[f, t + 1]
    kinds /= kinds.sum(axis=1, keepdims=True)
    said = np.maximum(vote, 0)  # 0: no vote for a type of the rest
    can = [set(said[:, f].tolist()) for f in range(FUNCTIONS)]
    able = [max(2, sum(t in c for c in can)) for t in range(k)]  # a block is seen for what it is by about one function of its type
    for _ in range(rounds):
        share = (kinds * rest[:, None]).sum(axis=0) + 1
        logs = np.tile(np.log(share / share.sum()), (len(codes), 1))
        for f in range(FUNCTIONS):
            own = np.stack([(kinds * (rest * (said[:, f] == v))[:, None]).sum(axis=0) for v in range(k)], axis=1)
            prior = np.array([[1 / able[t] if v == t and t in can[f] else 1 - 1 / able[t] if v == 0 else 0.01 for v in range(k)] for t in range(1, k)])
            own = own + prior * (PRIOR * rest.sum()) + 1e-9
            logs += 0.7 * np.log(own / own.sum(axis=1, keepdims=True))[:, said[:, f]].T
        kinds = np.exp(logs - np.logaddexp.reduce(logs, axis=1)[:, None])
    post = np.hstack([two[:, :1], two[:, 1:] * kinds])
    return {c: post[i].tolist() for i, c in enumerate(codes)}, table.tolist()


def blocks_of(text: str, joined: int = 40) -> list[str]:
    """Blocks of a text; one of fewer than ``joined`` characters goes with the block before it."""
    out: list[str] = []
    for b in BLOCK.split(text):
        if not b.strip():
            continue
        if out and len(b.strip()) < joined:
            out[-1] += "\n" + b
        else:
            out.append(b)
    return out


def text_types(df: DataFrame, key: str, text: str, pages: str | None = None) -> DataFrame:
    """One row for every text that is not blank: id, its type, the types' posterior shares, and its statistics.

    p_prose, p_list, p_table, p_junk are shares of the characters. chars_per_page (null without a column of pages),
    alpha_ratio, mean_word_length, replacement_char_ratio, word_count, symbol_ratio, ended_lines (share of lines that
    end in punctuation), common_words (share of words) describe the whole text. text_hash tells equal texts.
    No row meets another one: the votes' counts alone are shuffled, a row a pattern and task.
    """
    number = F.col(pages).cast("long") if pages else F.lit(None).cast("long")
    rows = spread(df.select(F.col(key).alias("id"), F.col(text).alias("text"), number.alias("pages")).where(F.col("text").isNotNull() & F.col("text").rlike(r"\S")))
    kind = dict(rows.dtypes)["id"]
    names = ["id", "pages", "text_hash", "patterns", "chars", "replaced", "size", *COUNTS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for pdf in batches:
            out = []
            for i, t, p in zip(pdf["id"], pdf["text"], pdf["pages"], strict=True):
                seen = [reader.votes(b) for b in blocks_of(t)]
                digest = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                out.append((i, None if pd.isna(p) else int(p), digest, [pack(v) for v, _ in seen], [c[1] for _, c in seen], t.count("\ufffd"), len(t), *map(sum, zip(*(c for _, c in seen), strict=True))))
            yield pd.DataFrame(out, columns=names).astype({"pages": "Int64"})

    longs = ", ".join(f"{c} long" for c in ("replaced", "size", *COUNTS))
    seen = cut(rows.mapInPandas(run, f"id {kind}, pages long, text_hash long, patterns array<long>, chars array<long>, {longs}"))
    counts = seen.select(F.explode("patterns").alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    post, _ = learn({r["pattern"]: r["n"] for r in counts.collect()})  # votes repeat: far fewer patterns than blocks

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shares = [np.average([post[int(c)] for c in p], axis=0, weights=np.asarray(w, float)) for p, w in zip(pdf["patterns"], pdf["chars"], strict=True)]
            table = np.array(shares).reshape(len(pdf), len(TYPES))
            yield pdf.drop(columns=["patterns", "chars"]).assign(**{f"p_{t}": table[:, k] for k, t in enumerate(TYPES)})

    doubles = ", ".join(f"p_{t} double" for t in TYPES)
    scored = seen.mapInPandas(judge, f"id {kind}, pages long, text_hash long, {longs}, {doubles}")
    others = [t for t in TYPES if t != "prose"]
    best = F.greatest(*[F.col(f"p_{t}") for t in others])
    likeliest = F.coalesce(*[F.when(F.col(f"p_{t}") == best, F.lit(t)) for t in others])
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return scored.select(
        "id", "text_hash", F.when(F.col("p_prose") >= 0.5, F.lit("prose")).otherwise(likeliest).alias("text_type"), *[f"p_{t}" for t in TYPES], F.when(F.col("pages") >= 1, F.col("dense") / F.col("pages")).alias("chars_per_page"),
        ratio("letters", "dense").alias("alpha_ratio"), ratio("dense", "tokens").alias("mean_word_length"), ratio("replaced", "size").alias("replacement_char_ratio"), F.col("tokens").alias("word_count"),
        (1 - ratio("letters", "dense")).alias("symbol_ratio"), ratio("ended", "lines").alias("ended_lines"), ratio("usual", "words").alias("common_words"),
    )
