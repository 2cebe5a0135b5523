"""Variant spellings of the names of people and organisations (problem 1).

A name is parsed into a family key, given names and initials; titles, generational suffixes, order and
punctuation do not count, nicknames and typed abbreviations are resolved against the given names that the
collection itself uses in unmistakable places ("Family, Given", "Given X. Family"). Nicknames come from a short
list of common ones and, where lists of names are given (the authors of one paper, harvested more than once),
from the collection: two given names that stand before one family name in one place of such lists.

Misspelt family keys and misspelt given names are found by a metric-space partition. The metric is the
unrestricted Damerau-Levenshtein distance. A name's distance to a pivot made of one repeated letter, in an
alphabet folded into ``CLASSES`` classes (other letters than a-z by their code), is the pivot's length less the
name's letters of that class, so the cell of a name (its distances to all pivots) costs nothing. By the triangle
inequality a name within radius 1 differs by at most 1 in every distance and lies in the name's own cell or one of
its neighbours, so each name is copied to those neighbours and every cell is joined by itself: levenshtein within
2 in the JVM, then the exact metric.

Spellings are linked through entities (family root, given name, middle name) and never by chains of look-alikes:
a short form ("K. Family") joins an entity only if it fits exactly one best. Middle names part people by their
initial, and by the whole where two are written out; so do the third and later words of an organisation.

Defined results: null or blank names, and names without letters, take no part. Equal spellings under several ids
are linked. Of neighbouring family keys the most frequent, then the one with most neighbours, then the greatest is
the root. Family keys shorter than ``shortest`` and given names of up to 3 letters are compared as they stand:
at that length one edit makes another name. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.session import cut, spread

# fixed values: words that belong to no name, name particles, words that mark an organisation
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "sir", "phd", "md", "jr", "sr", "ii", "iii"}
PARTICLES = {"van", "von", "der", "den", "de", "di", "da", "del", "della", "la", "le", "du", "dos", "ter", "ten", "zu", "zur"}
ORGANISATION = {"collaboration", "collab", "consortium", "group", "team", "project", "network", "alliance", "initiative", "committee", "society"}
GENERIC = {"the", "for", "of", "on", "behalf", "and"}
# fixed values: common short forms and the given names they stand for
NICKNAMES = {
    "abby": "abigail", "alex": "alexander", "andy": "andrew", "drew": "andrew", "ben": "benjamin", "beppe": "giuseppe", "beth": "elizabeth",
    "betty": "elizabeth", "liz": "elizabeth", "lizzy": "elizabeth", "eliza": "elizabeth", "bill": "william", "will": "william", "billy": "william", "bob": "robert",
    "rob": "robert", "bobby": "robert", "chris": "christopher", "kit": "christopher", "dan": "daniel", "danny": "daniel", "debbie": "deborah", "deb": "deborah",
    "dick": "richard", "rick": "richard", "rich": "richard", "dima": "dmitri", "mitya": "dmitri", "dora": "theodora dorothea", "thea": "dorothea theodora", "dot": "dorothea", "dolly": "dorothea",
    "ed": "edward", "eddie": "edward", "ted": "edward", "ned": "edward", "fred": "frederick", "freddy": "frederick", "gaby": "gabriela", "gabi": "gabriela",
    "gerry": "gerald", "jerry": "gerald", "hans": "johannes", "jan": "johannes", "jo": "josephine", "josie": "josephine", "kate": "katherine", "katie": "katherine",
    "kathy": "katherine", "katya": "ekaterina", "kees": "cornelius", "cor": "cornelius", "leo": "leonardo", "luk": "lukasz", "maggie": "margaret", "peggy": "margaret",
    "meg": "margaret", "matze": "matthias", "matt": "matthias", "max": "maximilian", "mick": "michael", "mike": "michael", "mickey": "michael", "mina": "wilhelmina",
    "minnie": "wilhelmina", "misha": "mikhail", "nick": "nicholas", "nico": "nicholas", "klaus": "nicholas", "paco": "francisco", "pancho": "francisco", "pat": "patricia", "trish": "patricia",
    "patty": "patricia", "priya": "priyanka", "quin": "quentin", "roz": "rosalind", "rosa": "rosalind", "sam": "samuel", "sasha": "alexander", "seun": "oluwaseun",
    "sue": "susanne", "susi": "susanne", "tadek": "tadeusz", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "jim": "james", "jack": "john", "johnny": "john",
    "joe": "joseph", "steve": "steven", "greg": "gregory", "larry": "lawrence", "uschi": "ursula", "vicky": "victoria", "tori": "victoria", "volodya": "vladimir",
    "vova": "vladimir", "zoli": "zoltan", "gosia": "margaret", "xiao": "xiaoming",
}
LETTERS = {"ø": "o", "ł": "l", "ß": "ss", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i"}
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*\.?")
# fixed value: classes of letters that share a pivot, of about equal weight in names
CLASSES = ("ae", "io", "uyw", "rl", "nm", "sztc", "dkgbpqx", "vfhj")


def fold(text: str) -> str:
    """Lower case without accents."""
    t = unicodedata.normalize("NFKD", text.lower())
    return "".join(LETTERS.get(c, c) for c in t if not unicodedata.combining(c))


def damerau(a: str, b: str, most: int) -> int:
    """Unrestricted Damerau-Levenshtein distance, or most + 1 if it is larger than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = len(a) + len(b)
    last: dict[str, int] = {}
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), seen
            same = a[i - 1] == b[j - 1]
            if same:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return min(d[-1][-1], most + 1)


def _words(raw: str) -> list[tuple[str, bool, bool]]:
    """(folded word, ends in a dot, joined to the word before by a hyphen); 'MM' counts as two initials."""
    out, last = [], 0
    for m in TOKEN.finditer(raw):
        w, dot = m.group().rstrip("."), m.group().endswith(".")
        joined = m.start() > 0 and raw[m.start() - 1] in "-‐‑" and bool(out)
        if len(w) in (2, 3) and w.isupper() and not joined:
            out += [(fold(c), True, False) for c in w]
        else:
            out.append((fold(w).replace("'", "").replace("’", ""), dot, joined))
        last = m.end()
    return out


def _compound(words: list[tuple[str, bool, bool]]) -> list[str]:
    """Hyphenated words as one, with a blank between; a dot after a word of 2 to 5 letters stays as the mark of a truncation."""
    out: list[str] = []
    for w, dot, joined in words:
        w = w + "." if dot and 1 < len(w) < 6 else w
        if joined:
            out[-1] += f" {w}"
        else:
            out.append(w)
    return out


def _split(raw: str) -> tuple[str, str, list[str], list[str] | None]:
    """(kind, particle, words, words behind a comma)."""
    before, comma, after = raw.partition(",")
    if comma and all(w in GENERIC or w in TITLES for w, _, _ in _words(after)):
        comma = ""
    parts = [_compound(_words(before)), _compound(_words(after)) if comma else None]
    if any(w.rstrip(".") in ORGANISATION for p in parts if p for w in p):
        words = [w for p in parts if p for w in p if w.rstrip(".") not in ORGANISATION and w not in GENERIC]
        return "org", "", words, None
    particle = " ".join(w for p in parts if p for w in p if w in PARTICLES)
    drop = lambda p: [w for w in p if w not in PARTICLES and w.rstrip(".") not in TITLES]
    return "person", particle, drop(parts[0]), None if parts[1] is None else drop(parts[1])


def _long(w: str) -> bool:
    return len(w.rstrip(".")) > 1 and not (" " in w and all(len(x) == 1 for x in w.split()))


def evidence(raw: str) -> list[tuple[str, int, int]]:
    """(word, 1 if surely a given name or topic, 1 if surely a family name) of one name."""
    kind, _, words, after = _split(raw)
    if kind == "org":
        return [(w, 1, 0) for w in words[1:]] + [(w, 0, 1) for w in words[:1]]
    if after is not None:
        return [(w, 0, 1) for w in words if _long(w)] + [(w, 1, 0) for w in after if _long(w)]
    if len(words) >= 3 and _long(words[0]) and _long(words[-1]) and not any(_long(w) for w in words[1:-1]):
        return [(words[0], 1, 0), (words[-1], 0, 1)]
    return []


class Reader:
    """Parses names, knowing the given names of the collection and what nicknames stand for."""

    def __init__(self, given: set[str], heads: set[str], nicknames: dict[str, str]):
        self.given, self.heads, self.nicknames = given, heads, nicknames

    def name(self, w: str) -> tuple[str, str]:
        """(how, value): a full given name, or a short form to be matched later."""
        bare = w.rstrip(".")
        if not _long(w):
            return "initials", bare.replace(" ", "")
        if bare in self.nicknames:
            formal = self.nicknames[bare].split()
            return ("full", formal[0]) if len(formal) == 1 else ("any", "|".join(sorted(formal)))
        if w.endswith(".") and len(bare) < 6:
            return "prefix", bare
        if bare in self.heads:
            return "prefix", bare
        return "full", bare

    def read(self, raw: str) -> tuple[str, str, str, str, str, str, str] | None:
        """(kind, particle, family, how, given, middle initial, middle name or further words), or None if nothing is left."""
        kind, particle, words, after = _split(raw)
        if kind == "org":
            if not words:
                return None
            how, topic = self.name(words[1]) if len(words) > 1 else ("prefix", "")
            return kind, "", words[0].rstrip("."), how, topic, "", " ".join(w.rstrip(".") for w in words[2:])
        if after is None:
            longs = [i for i, w in enumerate(words) if _long(w)]
            if not longs:
                return None
            if len(longs) == 1:
                at = longs[0]
            else:
                known = [self._known(words[i]) for i in longs]
                at = longs[-1] if known[0] or not any(known[1:]) else longs[0]
            family, rest = [words[at]], words[:at] + words[at + 1 :]
        else:
            family, rest = words, after
        if not family:
            return None
        key = "".join(family).replace(" ", "").replace(".", "")
        if not rest:
            return kind, particle, key, "initials", "", "", ""
        how, value = self.name(rest[0])
        extra = "".join(w.rstrip(".").replace(" ", "")[0] for w in rest[1:])
        if how == "initials":
            return kind, particle, key, how, value + extra, "", ""
        return kind, particle, key, how, value, extra[:1], " ".join(w for w in rest[1:] if _long(w) and not w.endswith("."))

    def _known(self, w: str) -> bool:
        bare = w.rstrip(".")
        return bare in self.given or bare in self.nicknames or bare in self.heads or (w.endswith(".") and len(bare) < 6)


def fits(how: str, short: str, middle: str, given: str, own: str) -> int:
    """How well a short form fits the entity (given, own middle name): 0 not, 1 as far as known, 2 in all it says."""
    own = own.partition("/")[0]
    if middle and own and middle != own:
        return 0
    level = 2 if not middle or middle == own else 1
    if how == "any":
        return level if given in short.split("|") else 0
    if how == "prefix":
        return level if given.startswith(short) else 0
    heads = [w[0] for w in given.split()]
    if not short:
        return 1
    wholes = {"".join(heads) + own, heads[0] + own}
    if any(w.startswith(short) for w in wholes):
        return 2
    return 1 if not own and (short[:-1] in ("".join(heads), heads[0])) else 0


def letter_classes(key: str) -> Column:
    """How many letters of each class a key has: a-z by CLASSES, others by their code, so that no script is one class."""
    of = F.create_map(*[F.lit(x) for k, c in enumerate(CLASSES) for letter in c for x in (letter, k)])
    each = F.transform(F.split(F.col(key), ""), lambda x: F.coalesce(F.try_element_at(of, x), F.pmod(F.ascii(x), F.lit(len(CLASSES)))))
    return F.transform(F.sequence(F.lit(0), F.lit(len(CLASSES) - 1)), lambda k: F.size(F.filter(each, lambda c: c == k)))


def metric_neighbours(keys: DataFrame, radius: int = 1) -> DataFrame:
    """Pairs a < b of distinct strings (column key) within one group at Damerau-Levenshtein distance 1 to radius."""
    n = len(CLASSES)
    unit = lambda i, s: tuple(s * (j == i) for j in range(n))
    plus = lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))
    edits = {(0,) * n} | {unit(i, s) for i in range(n) for s in (1, -1)} | {plus(unit(i, 1), unit(j, -1)) for i in range(n) for j in range(n)}
    steps = {(0,) * n}
    for _ in range(radius):
        steps = {plus(a, b) for a in steps for b in edits}
    half = sorted(s for s in steps if s >= (0,) * n)  # of two neighbouring cells one is copied to the other
    placed = keys.select("grp", "key", letter_classes("key").alias("at"))
    home = placed.select("grp", F.col("key").alias("a"), F.xxhash64("at").alias("cell"))
    moved = F.transform(F.array(*[F.array(*map(F.lit, s)) for s in half]), lambda s: F.xxhash64(F.zip_with("at", s, lambda x, y: x - y)))
    copies = placed.select("grp", F.col("key").alias("b"), F.explode(moved).alias("cell"))
    close = home.join(copies, ["grp", "cell"]).where((F.col("a") != F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= radius)).where(F.levenshtein("a", "b", 2 * radius).between(0, 2 * radius))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [1 <= damerau(a, b, radius) <= radius for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            yield pdf[keep]

    found = close.select("grp", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return found.mapInPandas(exact, "grp string, a string, b string")


def lexicon(words: DataFrame, nicknames: DataFrame) -> DataFrame:
    """word, given, head, formal: known given names (words: word), first parts of compound ones, and nicknames (word, formal)."""
    given = words.where(~F.endswith("word", F.lit("."))).join(nicknames, "word", "left_anti").select("word")
    none = F.lit(None).cast("string").alias("formal")
    heads = given.where(F.contains("word", F.lit(" "))).select(F.split_part("word", F.lit(" "), F.lit(1)).alias("word"))
    parts = given.select("word", F.lit(True).alias("given"), F.lit(False).alias("head"), none)
    parts = parts.union(heads.select("word", F.lit(False), F.lit(True), none)).union(nicknames.select("word", F.lit(False), F.lit(False), "formal"))
    return parts.groupBy("word").agg(F.max("given").alias("given"), F.max("head").alias("head"), F.max("formal").alias("formal"))


def _reader(entries: Iterable[dict]) -> Reader:
    given, heads, nicknames = set(), set(), {}
    for e in entries:
        if e["given"]:
            given.add(e["word"])
        if e["head"]:
            heads.add(e["word"])
        if e["formal"] is not None:
            nicknames[e["word"]] = e["formal"]
    return Reader(given, heads, nicknames)


def _parse(rows: DataFrame, known: DataFrame, most_sent: int, *keys: str) -> DataFrame:
    """The key columns and the parts of the name of every row (column name) that has any.

    known: the lexicon. Up to ``most_sent`` entries go to the tasks whole; of a larger one every name is joined with the
    entries of its own words, which are all that its reading asks for.
    """
    kinds, few = dict(rows.dtypes), None
    if known.count() <= most_sent:
        few = [r.asDict() for r in known.collect()]
        texts = rows.select(*keys, "name", F.lit(None).cast("array<struct<word string>>").alias("entries"))
    else:

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for n in pdf["name"]:
                    _, _, words, after = _split(n)
                    out += [(n, w) for w in {w.rstrip(".") for w in (*words, *(after or ()))}]
                yield pd.DataFrame(out, columns=["name", "word"])

        asked = rows.select("name").distinct().mapInPandas(ask, "name string, word string")
        told = asked.join(known, "word").groupBy("name").agg(F.collect_list(F.struct("word", "given", "head", "formal")).alias("entries"))  # of one name
        texts = rows.join(told, "name", "left").select(*keys, "name", "entries")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = None if few is None else _reader(few)
        for pdf in batches:
            got = [(whole or _reader(() if own is None else own)).read(n) for n, own in zip(pdf["name"], pdf["entries"], strict=True)]
            kept = pdf.loc[[g is not None for g in got], list(keys)].reset_index(drop=True)
            yield pd.concat([kept, pd.DataFrame([g for g in got if g], columns=PARTS, dtype="object")], axis=1)

    return texts.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{c} string" for c in PARTS)]))


PARTS = ["kind", "particle", "family", "how", "given", "middle", "more"]


def learn_nicknames(lists: DataFrame, words: DataFrame, prior: dict[str, str], most_sent: int = 200_000) -> dict[str, str]:
    """prior and the nicknames the collection shows: word -> the given names it stands for.

    lists: grp, names; lists of one group are repeated listings of the same people. words: word, the known given names.
    Two given names that stand before one family name, at one place of lists of one group and length, are one person's;
    the longer is the formal one and must be a known given name. Pairs that one or two edits explain are misspellings.
    Compounds are no nicknames. Within a place the others are paired with the commonest, so a place costs as many pairs
    as it has spellings. The pairs stream past the driver in order, all of them; it keeps what is learned.
    """
    rows = lists.where(F.col("grp").isNotNull()).select("grp", F.size("names").alias("size"), F.posexplode("names").alias("pos", "name")).where(F.col("name").isNotNull()).distinct()
    none = words.sparkSession.createDataFrame([], "word string, formal string")
    parsed = _parse(spread(rows), cut(lexicon(words, none)), most_sent, "grp", "size", "pos").where((F.col("kind") == "person") & (F.col("how") == "full"))
    seen = parsed.groupBy("grp", "size", "pos", "family", "given").agg(F.count(F.lit(1)).alias("n"))
    place = ["grp", "size", "pos", "family"]
    spelled = seen.groupBy(*place).agg(F.max_by("given", F.struct("n", "given")).alias("top"), F.collect_set("given").alias("all"))  # the spellings of one person
    pairs = spelled.select("family", "top", F.explode("all").alias("given")).where(F.col("given") != F.col("top")).select("family", F.least("given", "top").alias("a"), F.greatest("given", "top").alias("b"))
    ranked = pairs.where(~F.contains("a", F.lit(" ")) & ~F.contains("b", F.lit(" "))).groupBy("a", "b").agg(F.countDistinct("family").alias("families"))
    a_first = (F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    ranked = ranked.select("a", "b", "families", F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("short"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("whole"))
    ranked = cut(ranked.join(words.select(F.col("word").alias("whole")), "whole", "left_semi").orderBy(F.desc("families"), "a", "b").select("short", "whole"))
    out = {k: set(v.split()) for k, v in prior.items()}
    formal = lambda w: set.union(*(out.get(x, {x}) for x in out.get(w, {w})))
    for short, whole in ranked.toLocalIterator():
        misspelt = len(short) > 4 and damerau(short, whole, 2) <= 2
        if not misspelt and not formal(short) & formal(whole):
            out.setdefault(short, set()).update(formal(whole))
    return {k: " ".join(sorted(v)) for k, v in out.items()}


def link_names(df: DataFrame, key: str, name: str, lists: DataFrame | None = None, nicknames: dict[str, str] | None = None, least: int = 3, most_given: int = 200_000, radius: int = 1, shortest: int = 4) -> DataFrame:
    """id and entity: rows of equal entity are spellings of the same person or organisation.

    Given names are words that stand in given places at least ``least`` times and oftener than as family names. Up to
    ``most_given`` of them and the nicknames are sent to the tasks; more are joined, with the same results. lists
    (grp, names) teach nicknames; nicknames replaces the list of common ones.
    """
    rows = spread(df.select(F.col(key).alias("id"), F.col(name).alias("name")).where(F.col("id").isNotNull() & F.col("name").isNotNull()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            given, family = Counter(), Counter()
            for n in pdf["name"]:
                for w, g, f in evidence(n):
                    given[w] += g
                    family[w] += f
            words = list(given | family)
            yield pd.DataFrame({"word": words, "g": [given[w] for w in words], "f": [family[w] for w in words]}, columns=["word", "g", "f"]).astype({"word": "object", "g": "int64", "f": "int64"})

    words = rows.select("name").mapInPandas(count, "word string, g long, f long").groupBy("word").agg(F.sum("g").alias("g"), F.sum("f").alias("f"))
    words = cut(words.where((F.col("g") >= least) & (F.col("g") > F.col("f"))).select("word", "g"))
    short_forms = NICKNAMES if nicknames is None else nicknames
    if lists is not None:
        short_forms = learn_nicknames(lists, words, short_forms, most_given)
    formal = words.sparkSession.createDataFrame(pd.DataFrame(sorted(short_forms.items()), columns=["word", "formal"]), "word string, formal string")
    parsed = cut(_parse(rows, cut(lexicon(words, formal)), most_given, "id"))

    # a misspelt given name is the one known given name next to it
    known = cut(words.where(~F.col("word").endswith(".")).join(formal, "word", "left_anti").select("word"))
    used = parsed.where((F.col("how") == "full") & (F.length("given") > 3)).select(F.col("given").alias("word")).distinct()
    close = metric_neighbours(known.union(used).distinct().select(F.lit("given").alias("grp"), F.col("word").alias("key")), radius)
    ends = close.select(F.col("a").alias("odd"), F.col("b").alias("word")).unionByName(close.select(F.col("b").alias("odd"), F.col("a").alias("word")))
    mended = ends.join(known, "word", "left_semi").join(known.select(F.col("word").alias("odd")), "odd", "left_anti").groupBy("odd").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("right"))
    mended = cut(mended.where("n = 1").select(F.col("odd").alias("given"), "right"))
    if mended.count() <= 500_000:  # else the misspelt names are many, and so not one of them is hot
        mended = F.broadcast(mended)
    parsed = parsed.join(mended, "given", "left").withColumn("given", F.when((F.col("how") == "full") & (F.length("given") > 3), F.coalesce("right", "given")).otherwise(F.col("given"))).drop("right")

    # a particle written together with its family is taken apart where the collection has them apart
    apart = parsed.where(F.col("particle") != "").groupBy("kind", "particle", "family").agg(F.count(F.lit(1)).alias("n"))
    apart = apart.select("kind", F.concat(F.regexp_replace("particle", " ", ""), F.col("family")).alias("together"), F.struct("n", "particle", F.col("family").alias("f")).alias("p")).groupBy("kind", "together").agg(F.max("p").alias("p"))
    parsed = parsed.join(apart.withColumnRenamed("together", "family"), ["kind", "family"], "left")
    mend = (F.col("particle") == "") & F.col("p").isNotNull()
    parsed = cut(parsed.select("id", "kind", F.when(mend, F.col("p.particle")).otherwise(F.col("particle")).alias("particle"), F.when(mend, F.col("p.f")).otherwise(F.col("family")).alias("family"), "how", "given", "middle", "more"))

    counts = parsed.groupBy(F.col("kind").alias("grp"), F.col("family").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    near = metric_neighbours(counts.where(F.length("key") >= shortest), radius)
    # umlauts that were typed out (oe, ae, ue) equal the bare letter
    bare = F.regexp_replace("key", "([aou])e", "$1")
    typed = counts.select("grp", F.col("key").alias("a"), bare.alias("bare")).where("a <> bare")
    like = typed.join(counts.select("grp", F.col("key").alias("b"), bare.alias("bare")), ["grp", "bare"]).where("a <> b").select("grp", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    near = cut(near.unionByName(like).distinct())
    both = near.unionByName(near.select("grp", F.col("b").alias("a"), F.col("a").alias("b")))
    weight = both.groupBy("grp", F.col("a").alias("key")).agg(F.count(F.lit(1)).alias("degree")).join(counts, ["grp", "key"]).select("grp", "key", F.struct("n", "degree", "key").alias("w"))
    ranked = both.join(weight.select("grp", F.col("key").alias("a"), F.col("w").alias("w_a")), ["grp", "a"]).join(weight.select("grp", F.col("key").alias("b"), F.col("w").alias("w_b")), ["grp", "b"])
    up = cut(ranked.where("w_b > w_a").groupBy("grp", "a").agg(F.max_by("b", "w_b").alias("b")))
    over = lambda: up.select("grp", F.col("a").alias("b"), F.col("b").alias("c"))
    while up.join(over(), ["grp", "b"]).limit(1).count():  # a misspelling of a misspelling ends at the same root; ways double in length
        up = cut(up.join(over(), ["grp", "b"], "left").select("grp", "a", F.coalesce("c", "b").alias("b")))
    rooted = parsed.join(up.select(F.col("grp").alias("kind"), F.col("a").alias("family"), F.col("b").alias("top")), ["kind", "family"], "left").withColumn("root", F.coalesce("top", "family")).drop("top")
    rooted = cut(rooted)

    place = ["kind", "particle", "root"]
    forms = rooted.select(*place, "how", "given", "middle", "more").distinct()
    full = forms.where(F.col("how") == "full")
    middles = full.where(F.col("middle") != "").groupBy(*place, "given").agg(F.count(F.lit(1)).alias("n"), F.min("middle").alias("only"))
    own = F.when(F.coalesce("n", F.lit(0)) <= 1, F.coalesce("only", F.lit(""))).otherwise(F.col("middle"))
    entities = full.join(middles, [*place, "given"], "left").withColumn("own", own).withColumn("letter", F.left("given", F.lit(1)))
    # middle names that are written out part people of one initial if there are two of them
    spelled = entities.where(F.col("more") != "").groupBy(*place, "given", "own").agg(F.countDistinct("more").alias("several")).where("several > 1")
    entities = entities.join(spelled, [*place, "given", "own"], "left").withColumn("own", F.when(F.col("several").isNotNull(), F.concat_ws("/", "own", "more")).otherwise(F.col("own")))
    distinct = entities.select(*place, "letter", "given", "own").distinct()

    short = forms.where(F.col("how") != "full").drop("more").distinct()
    letters = F.when(F.col("how") == "any", F.array_distinct(F.transform(F.split("given", r"\|"), lambda x: F.left(x, F.lit(1))))).otherwise(F.array(F.left("given", F.lit(1))))
    open_ = short.where(F.col("given") != "").withColumn("letter", F.explode(letters)).join(distinct.withColumnRenamed("given", "whole"), [*place, "letter"])
    bare = short.where(F.col("given") == "").withColumn("letter", F.lit("")).join(distinct.withColumnRenamed("given", "whole").drop("letter"), place)
    tried = open_.select(*place, "how", "given", "middle", "whole", "own").unionByName(bare.select(*place, "how", "given", "middle", "whole", "own"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            level = [fits(h, g, m, w, o) for h, g, m, w, o in zip(pdf["how"], pdf["given"], pdf["middle"], pdf["whole"], pdf["own"], strict=True)]
            yield pdf.assign(level=pd.Series(level, dtype="int32", index=pdf.index))[lambda x: x["level"] > 0]

    text = "kind string, particle string, root string, how string, given string, middle string, whole string, own string"
    fitting = tried.mapInPandas(judge, f"{text}, level int")
    best = F.rank().over(Window.partitionBy(*place, "how", "given", "middle").orderBy(F.desc("level")))
    chosen = fitting.withColumn("r", best).where("r = 1").groupBy(*place, "how", "given", "middle").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("whole", "own")).alias("e"))
    # a short form that fits nobody stands for its family and letter; one that fits several stands alone
    short_id = F.when(F.col("n") == 1, F.concat_ws("/", F.lit("full"), "e.whole", "e.own")).when(F.col("n").isNull(), F.concat_ws("/", F.lit("short"), F.left("given", F.lit(1)))).otherwise(F.concat_ws("/", F.lit("open"), "how", "given", "middle"))
    of_full = entities.select(*place, "how", "given", "middle", "more", F.concat_ws("/", F.lit("full"), "given", "own").alias("e"))
    of_short = short.join(chosen, [*place, "how", "given", "middle"], "left").select(*place, "how", "given", "middle", short_id.alias("e"))
    of_short = forms.where(F.col("how") != "full").join(of_short, [*place, "how", "given", "middle"]).select(of_full.columns)
    return rooted.join(of_full.unionByName(of_short), [*place, "how", "given", "middle", "more"]).select("id", F.concat_ws("/", *place, "e").alias("entity"))


def entity_pairs(linked: DataFrame) -> DataFrame:
    """All pairs id_a < id_b of one entity."""
    a, b = linked.select("entity", F.col("id").alias("id_a")), linked.select("entity", F.col("id").alias("id_b"))
    return a.join(b, "entity").where("id_a < id_b").select("id_a", "id_b")
