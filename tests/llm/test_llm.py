import random
import re
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("scholium.llm.queries")
from scholium.llm import language, leakage, names, neardup, scannoise, splitting, textquality, tokenizing  # noqa: E402


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- names ------------------------------------------------------------------------------------
def linked(spark, spelled):
    df = spark.createDataFrame([(i, n, "x", 0) for i, n in enumerate(spelled)], "id long, name string, entity string, root int")
    got = {}
    for r in names.link_names(df, "id", "name").collect():
        got.setdefault(r["entity"], set()).add(spelled[r["id"]])
    return {frozenset(v) for v in got.values()}


BASE = [f"{g} {m}. {f}" for g in ("Margaret", "Matthias", "Katherine", "Karthik") for m, f in (("A", "Brenolak"), ("B", "Stuvigor"), ("C", "Wulimant"))]


def test_spellings_meet(spark):
    ours = ["Zoltan P. Kreshumov", "Kreshumov, Z. P.", "Kreshumov Zoltan", "Zoltan Kreshmuov", "Dr. Zoltan P. Kreshumov Jr", "Zoli Kreshumov", "Zol. Kreshumov", "Zoltan P. Kréshumov"]
    got = linked(spark, [*BASE, *ours, "Kreshumov, Zoltan", "Zoltan Q. Abelim", "Zoltan R. Tomnak"])
    assert frozenset([*ours, "Kreshumov, Zoltan"]) in got


def test_different_people_stay_apart(spark):
    got = linked(spark, [*BASE, "K. Brenolak", "Ngozi H. Sagokiber", "Ngozi K. Sagokiber", "Ngozi Sagokiber"])
    alone = [s for s in got if "K. Brenolak" in s]
    assert alone == [frozenset({"K. Brenolak"})]  # Katherine or Karthik
    assert sum(any("Sagokiber" in n for n in s) for s in got) == 3


def test_names_edge_cases(spark):
    assert linked(spark, []) == set()
    got = linked(spark, [None, "", " . ", "Plato", "Plato", "X Y Z"])
    assert frozenset({"Plato"}) in got and all(None not in s for s in got)


def test_collaborations(spark):
    got = linked(spark, ["Vamod Genome Collaboration", "The Vamod Genome Collab.", "Vamod Genome Consortium, for the", "Vamod Collaboration", "Lezit Genome Collaboration", "Trunk Genome Collaboration", "Collaboration Vamod Genome"])
    assert len([s for s in got if any("Vamod" in n for n in s)]) == 1


def test_metric_join_by_brute_force(spark):
    rng = random.Random(3)
    keys = {"".join(rng.choice("abeioknrst") for _ in range(rng.randrange(4, 9))) for _ in range(150)}
    for k in list(keys)[:80]:
        i = rng.randrange(len(k) - 1)
        keys.add(rng.choice([k[:i] + k[i + 1 :], k[:i] + "z" + k[i:], k[:i] + "m" + k[i + 1 :], k[:i] + k[i + 1] + k[i] + k[i + 2 :]]))
    df = spark.createDataFrame([("g", k) for k in keys], "grp string, key string")
    want = sorted(("g", *sorted(p)) for p in combinations(keys, 2) if names.damerau(*p, 1) == 1)
    assert rows(names.metric_neighbours(df)) == want and len(want) > 30


def test_wider_radius_and_other_scripts(spark):
    rng = random.Random(12)
    keys = {"".join(rng.choice("абвгдежзиклмно") for _ in range(rng.randrange(4, 8))) for _ in range(60)} | {"".join(rng.choice("李王張劉陳楊趙黃周吳") for _ in range(4)) for _ in range(40)}
    for k in list(keys):
        if rng.random() < 0.5:
            keys.add(k[:2] + k[3:])
    df = spark.createDataFrame([("g", k) for k in keys], "grp string, key string")
    for radius in (1, 2):
        want = sorted(("g", *sorted(p)) for p in combinations(keys, 2) if names.damerau(*p, radius) <= radius)
        assert rows(names.metric_neighbours(df, radius)) == want and len(want) > 20
    many = ["".join(rng.choice("абвгдежзийклмнопрстуфхцчшщ") for _ in range(8)) for _ in range(2000)]
    cells = spark.createDataFrame([(k,) for k in many], "key string").groupBy(names.letter_classes("key").alias("c")).count()
    assert cells.agg(F.max("count")).first()[0] < 20


def test_all_words_of_organisations_and_middle_names(spark):
    orgs = ["Vamod Genome Alpha Collaboration", "The Vamod Genome Alpha Collab.", "Vamod Genome Beta Collaboration", "Vamod Genome Collaboration"]
    people = [f"{g} {m} Tekorim" for g in ("Margaret", "Matthias") for m in ("Michael", "Mark", "M.")]
    got = linked(spark, [*BASE, *orgs, *people])
    assert frozenset(orgs[:2]) in got and frozenset(orgs[2:3]) in got and frozenset(orgs[3:]) in got
    assert all(frozenset({n}) in got for n in people)
    assert frozenset({"Karthik Mark Ubel", "Karthik M. Ubel"}) in linked(spark, [*BASE, "Karthik Mark Ubel", "Karthik M. Ubel"])


def test_nicknames_are_learned_from_repeated_lists(spark):
    spelled = [*BASE, *[f"Wendeline {m}. {f}" for m, f in (("A", "Brenolak"), ("B", "Stuvigor"), ("C", "Wulimant"))], "Wenni Abelu", "Wendeline Abelu", "Wenni Oskar", "Wendeline Oskar", "Wendelne Oskar"]
    df = spark.createDataFrame(list(enumerate(spelled)), "id long, name string")
    lists = [("p1", ["X Y", "Wenni Brenolak"]), ("p1", ["X Y", "Wendeline A. Brenolak", None]), ("p1", ["X Y", "Wendeline A. Brenolak"]), ("p2", None), (None, ["a b"]), ("p2", ["Wendeline Abelu"]), ("p2", ["Karthik Oskar"])]
    taught = spark.createDataFrame(lists, "grp string, names array<string>")
    together = lambda **how: {frozenset(g) for g in _groups(names.link_names(df, "id", "name", **how), spelled) if any("Wenni" in n for n in g)}
    assert together(lists=taught, nicknames={}) == {frozenset({"Wenni Abelu", "Wendeline Abelu"}), frozenset({"Wenni Oskar", "Wendeline Oskar", "Wendelne Oskar"})}
    assert together(nicknames={}) == {frozenset({"Wenni Abelu"}), frozenset({"Wenni Oskar"})}


def _groups(found, spelled):
    out = {}
    for r in found.collect():
        out.setdefault(r["entity"], set()).add(spelled[r["id"]])
    return list(out.values())


# ---- near duplicates --------------------------------------------------------------------------
def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = [". ".join(" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(5)) for _ in range(120)]
    for t in texts[:60]:
        w = t.split(" ")
        for _ in range(3):
            w[rng.randrange(len(w))] = "changed"
        parts = " ".join(w).split(". ")
        rng.shuffle(parts)
        texts.append(". ".join(parts))
    texts += [texts[0], texts[0].upper(), None, "", "!!"]
    data = [(f"c{i:03d}", t, 1, "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*data, data[0]], "chunk_id string, text string, class_id int, sketch string")
    sets = {i: set(re.findall(r"[^\W_]+", t.lower())) for i, t, _, _ in data if t}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = [tuple(r) for r in neardup.expand(*neardup.near_duplicates(df, "chunk_id", "text")).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.97 * len(want)


def test_buckets_of_any_size(spark):
    data = sorted({(c, s) for s in range(40) for c in range(s)} | {(c, -1) for c in range(90)})
    want = {p for s in {s for _, s in data} for p in combinations(sorted(c for c, t in data if t == s), 2)}
    for small in (256, 5):
        assert set(rows(neardup.bucket_pairs(spark.createDataFrame(data, "class_id long, sketch long"), small))) == want


def test_banded_alignment():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a = rng.integers(0, 5, rng.integers(1, 30))
        b = rng.integers(0, 5, rng.integers(1, 30))
        d = np.arange(len(b) + 1)
        for i, x in enumerate(a, 1):
            e = np.empty_like(d)
            e[0] = i
            for j, y in enumerate(b, 1):
                e[j] = min(d[j] + 1, e[j - 1] + 1, d[j - 1] + (x != y))
            d = e
        assert neardup.align_banded(a, b) == pytest.approx(1 - d[-1] / max(len(a), len(b)))


def test_near_duplicates_empty(spark):
    members, links = neardup.near_duplicates(spark.createDataFrame([], "chunk_id string, text string"), "chunk_id", "text", edit=True)
    assert members.count() == 0 and links.count() == 0


# ---- splitting --------------------------------------------------------------------------------
def plain_windows(text):
    """The definition, boundary by boundary."""
    marks = []
    for m in re.finditer(r"[ \t\r\n\f]+", text):
        kind = 0 if "\f" in m.group() or m.group().count("\n") > 1 else 1 if m.start() and text[m.start() - 1] in ".!?" else 2
        marks.append((m.end(), kind))
    out, s = [], 0
    while len(text) - s > 1200:
        for kind in (0, 1, 2):
            ends = [e for e, k in marks if k == kind and s + 600 < e <= s + 1200]
            if ends:
                break
        e = max(ends) if ends else s + 1200
        out.append((s, e))
        s = e - 120
    return [*out, (s, len(text))]


def test_pieces(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["word", "Ünï😀", ". ", " ", "\n\n", "\f", "x" * 300, "! "]) for _ in range(n)) for n in (0, 3, 400, 900, 3000)] + ["y" * 5000, None, "a" * 1200, "a" * 1201]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "id long, text string, piece_no int")
    for plan in ("window", "bisect"):
        got = {}
        for i, n, a, b in rows(splitting.split_oversized(df, "id", "text", plan=plan)):
            assert n == len(got.setdefault(i, []))
            got[i].append((a, b))
        assert set(got) == {i for i, t in enumerate(texts) if t and len(t) > 1200}
        for i, spans in got.items():
            assert spans[0][0] == 0 and spans[-1][1] == len(texts[i]) and all(0 < b - a <= 1200 for a, b in spans)
            assert all(y[0] == x[1] - 120 for x, y in zip(spans, spans[1:], strict=False))
            if plan == "window":
                assert spans == plain_windows(texts[i])


# ---- tokenizing -------------------------------------------------------------------------------
@pytest.mark.skipif(not Path(tokenizing.TOKENIZERS).exists(), reason="no vocabularies here")
def test_ids_equal_the_public_tokenizer(spark):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(f"{tokenizing.TOKENIZERS}/byte_bpe_50k.json")
    public.encode_special_tokens = True
    texts = [None, "", " ", "Hello  world's\n\ntest 12345!", "<|endoftext|> 漢字 naïve 😀‍🔥", "a" * 3000, "\x00\x07é" * 9, "word " * 4000]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    for i, ids, ok in rows(tokenizing.encode_corpus(df, "doc_id", "text", check=True)):
        assert ok and ids == (public.encode(texts[i], add_special_tokens=False).ids if texts[i] else [])


# ---- leakage ----------------------------------------------------------------------------------
def test_leaks(spark):
    words = [f"term{i}" for i in range(60)]
    item, half, less = " ".join(words), " ".join(words[10:44]), " ".join(words[10:34])
    altered = " ".join(w if i % 9 else "oops" for i, w in enumerate(words))
    docs = [(1, f"Intro. {item.upper()} end."), (2, f"x {half} y"), (3, f"x {less} y"), (4, "a <b>" + altered.replace(" ", "</b>,\n<b>") + "</b>"), (5, None), (6, " "), (7, " ".join(reversed(words))), (8, "tiny item here")]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item")], "item_id long, text string")
    got = leakage.find_leaks(d, "doc_id", "text", items, "item_id", ["text"]).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (2, 1), (4, 1), (8, 4)]
    assert docs[1][1][next(r for r in got if r["doc_id"] == 2)["start_pos"] :].startswith("term10")
    twice = spark.createDataFrame([(1, f"{item} {'filler ' * 200} {half}"), (2, f"{half} {'filler ' * 300} {item} {'filler ' * 300} {half}")], "doc_id long, text string")
    places = leakage.find_leaks(twice, "doc_id", "text", items.where("item_id = 1").withColumn("query", F.lit("term0 term1")), "item_id", ["text", "query"]).collect()
    assert sorted((r["doc_id"], r["passage"], r["stretch"], r["matched"]) for r in places) == [(1, "query", 0, 2), (1, "text", 0, 60), (1, "text", 1, 34), (2, "query", 0, 2), (2, "text", 0, 34), (2, "text", 1, 60), (2, "text", 2, 34)]
    blocks = leakage.find_leaks(d, "doc_id", "text", items, "item_id", ["text"], block_items=2)
    assert sorted((r["doc_id"], r["item_id"]) for r in blocks.collect()) == [(1, 1), (2, 1), (4, 1), (8, 4)]


# ---- language ---------------------------------------------------------------------------------
def test_languages(spark):
    own = {
        "en": ["The model is trained with the data of this corpus.", "It remains unclear whether these results hold for the others."],
        "de": ["Das Verfahren wird mit den Daten nicht besser erklärt.", "Wir zeigen, dass die Ergebnisse noch nicht bekannt sind."],
        "fr": ["Les résultats obtenus sont comparés à la plupart des articles.", "Nous montrons que cette méthode est plus rapide avec le modèle."],
    }
    rng, data = random.Random(5), []
    for i in range(300):
        lang = rng.choice(list(own))
        data.append((i, " ".join(rng.choice(own[lang]) for _ in range(3)), lang.upper() if i % 2 else f"{lang}-XX", "s", "t"))
    mixed = [(900, own["en"][0] + " " + own["de"][0] + " " + own["de"][1], "en", "s", "t"), (901, own["fr"][0], "de", None, "t"), (902, None, "en", "s", "t"), (903, " ", None, "s", "t"), (904, own["de"][1], "deu", "new", "t"), (905, "12 34", None, "s", "t")]
    df = spark.createDataFrame([*data, *mixed], "doc_id long, text string, lang string, source string, confidence string")
    got = {}
    for r in language.assign_languages(df, "doc_id", "text", "lang", "source").collect():
        got.setdefault(r["doc_id"], []).append((r["seg_no"], r["lang"], r["declared_right"]))
    assert all(len(got[i]) == 1 and got[i][0][2] for i in range(300))
    assert sorted(got[900])[0][:2] == (0, "en") and sorted(got[900])[1][:2] == (1, "de") and len(got[900]) == 2
    assert got[901] == [(0, "fr", False)] and got[904] == [(0, "de", True)] and 902 not in got and 903 not in got and len(got[905]) == 1
    few = language.assign_languages(df, "doc_id", "text", "lang", "source", fit_rows=60).where("doc_id < 300")
    assert few.where("declared_right").count() >= 295
    salted = language.assign_languages(df, "doc_id", "text", "lang", "source", broadcast_hosts=0)
    assert salted.count() == sum(map(len, got.values()))
    assert language.assign_languages(df.limit(0), "doc_id", "text", "lang", "source").count() == 0


def test_address_suffix_is_between_host_and_corpus(spark):
    """A text without evidence on a new host follows its suffix, and the corpus only without one."""
    own = {"en": "The model is trained with the data of this corpus.", "de": "Das Verfahren wird mit den Daten nicht besser."}
    data = [(i, own["en"] if i % 3 else own["de"], "en" if i % 3 else "de", f"https://h{i}.example.{'com' if i % 3 else 'de'}/x") for i in range(600)]
    data += [(900, "12 34", None, "https://new.example.de"), (901, "12 34", None, "https://new.example.com:80/a.de"), (902, "12 34", None, "thesis")]
    got = language.assign_languages(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), "doc_id", "text", "lang", "source").where("doc_id >= 900").collect()
    assert {r["doc_id"]: r["lang"] for r in got} == {900: "de", 901: "en", 902: "en"}


def test_sentences_by_parts():
    text = "<p>One two.</p> 12. Three four! https://x.y/z \n\n Five"
    got = language.sentences(text)
    assert [w for _, _, w in got] == [["one", "two"], ["three", "four"], ["five"]] and got[0][0] == 0 and got[-1][1] == len(text)
    assert language.sentences("12. 34.")[0][2] == [] and language.sentences(" ") == []


# ---- text types -------------------------------------------------------------------------------
PROSE = "This is a natural paragraph of the paper, and it is written in sentences that are not too long. It shows what the method does with the data that we have collected. "


def test_text_types(spark):
    rng = random.Random(7)
    kinds = {
        "prose": lambda: PROSE * rng.randrange(2, 5),
        "table": lambda: "\n".join(f"{rng.choice('abc')}x\t{rng.random():.2f}\t{rng.random():.2f}" for _ in range(30)),
        "junk": lambda: "".join(rng.choice("{}[]<>%$#=~ ") for _ in range(900)),
        "list": lambda: "\n".join(f"[{i}] A. Name, {rng.choice(['Some', 'Other'])} Title Words, 2001, pp. 1-9" for i in range(30)),
    }
    data = [(i, kinds[k](), k) for i, k in enumerate(["prose"] * 80 + ["table"] * 8 + ["junk"] * 8 + ["list"] * 8)]
    data += [(500, None, ""), (501, " \n\f", ""), (502, PROSE.replace(" ", ""), "junk"), (503, "一。" + "我们发现该方法的速度更快。" * 20, "prose"), (504, PROSE * 4 + "\n\n" + kinds["table"]()[:100], "prose")]
    got = {r["id"]: r["text_type"] for r in textquality.text_types(spark.createDataFrame(data, "id long, text string, text_type string"), "id", "text").collect()}
    assert 500 not in got and 501 not in got
    assert all((got[i] == "prose") == (k == "prose") for i, t, k in data if i in got)
    assert textquality.text_types(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


def test_text_statistics(spark):
    text = "Two words.\nof the 42\ufffd ==\n\n" + "The end is near? " * 3
    data = [(1, text, 2), (2, text, 0), (3, "x", None), (3, "x", None)]
    got = textquality.text_types(spark.createDataFrame(data, "id long, text string, pages int"), "id", "text", "pages").collect()
    a = next(r for r in got if r["id"] == 1)
    tokens, dense = text.split(), len("".join(text.split()))
    letters = sum(c.isalpha() for c in text)
    words = re.findall(r"[^\W\d_]+", text)
    assert a["word_count"] == len(tokens) and a["chars_per_page"] == dense / 2 and a["alpha_ratio"] == pytest.approx(letters / dense) and a["symbol_ratio"] == pytest.approx(1 - letters / dense)
    assert a["mean_word_length"] == pytest.approx(dense / len(tokens)) and a["replacement_char_ratio"] == pytest.approx(1 / len(text)) and a["ended_lines"] == pytest.approx(2 / 3)
    assert a["common_words"] == pytest.approx(sum(w.lower() in textquality.COMMON for w in words) / len(words)) and a["p_prose"] + a["p_list"] + a["p_table"] + a["p_junk"] == pytest.approx(1)
    assert next(r for r in got if r["id"] == 2)["chars_per_page"] is None and sum(r["id"] == 3 for r in got) == 2


# ---- scan noise -------------------------------------------------------------------------------
def test_scan_noise(spark):
    body = "The memory of the model explains the fine-grained results of every measurement, and we interpret the behaviour of the interactive system again.\n" * 3
    clean = [(i, body + f"Text {i}.\n", "x") for i in range(30)]
    page = "\n".join(["A Running Title Of It   3", "The rnemory of the model explains the fine-", "grained results of every measure-", "ment, and we interpret the bebaviour of the", "interactive system again. The memory of the inter-", "active system.", "", "7", "more of it follows here in the body again.", "- 12 -"])
    text = page + "\f" + page.replace("12", "13").replace("rnemory", "memory")
    df = spark.createDataFrame([*clean, (99, text, "x")], "id long, text string, marks string")
    rows_ = scannoise.numbered(df)
    fixed = scannoise.repair(rows_, scannoise.learn_model(rows_)).where("id = 99").first()
    marks = {(m["line_no"], m["kind"]) for m in fixed["marks"]}
    assert marks == {(0, "furniture"), (1, "misread"), (2, "hyphen"), (3, "misread"), (4, "hyphen"), (9, "furniture"), (10, "furniture"), (12, "hyphen"), (13, "misread"), (14, "hyphen"), (19, "furniture")}
    assert "fine-grained results of every measurement, and we interpret the behaviour" in fixed["repaired"] and "Running" not in fixed["repaired"]
    empty = scannoise.numbered(df.limit(0))
    assert scannoise.repair(empty, scannoise.learn_model(empty)).count() == 0


def noisy_corpus(n=40):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("aeioucnrmtlsdbh") for _ in range(rng.randrange(4, 9))) for _ in range(500)})
    weights = [1 / (k + 1) for k in range(len(words))]
    texts = []
    for i in range(n):
        lines = []
        for _ in range(25):
            line = rng.choices(words, weights, k=9)
            if rng.random() < 0.3:
                k = rng.randrange(9)
                read, printed = rng.choice(scannoise.CONFUSIONS)
                line[k] = line[k].replace(printed, read, 1)
            if rng.random() < 0.2 and len(line[-1]) > 5:
                head, tail = line[-1][:3], line[-1][3:]
                lines.append(" ".join([*line[:-1], head + "-"]))
                line = [tail]
            lines.append(" ".join(line) + ".")
        texts.append((i, f"Journal of Odd Words {i % 3}\n" + "\n".join(lines) + f"\n\f{i}\n" + " ".join(rng.choices(words, weights, k=8)) + "."))
    return texts


def marks_of(df, **how):
    rows_ = scannoise.numbered(df)
    return {(r["id"], m["line_no"], m["kind"]) for r in scannoise.repair(rows_, scannoise.learn_model(rows_, **how)).collect() for m in r["marks"]}


def test_copies_prove_nothing(spark):
    texts = noisy_corpus()
    once = marks_of(spark.createDataFrame(texts, "id long, text string"))
    tenfold = marks_of(spark.createDataFrame([(i + 1000 * k, t) for k in range(10) for i, t in texts], "id long, text string"))
    assert {(i, n, k) for i, n, k in tenfold if i < 1000} == once and len(tenfold) == 10 * len(once) and len({k for _, _, k in once}) == 3


def test_what_is_not_sent_is_joined(spark):
    df = spark.createDataFrame(noisy_corpus(), "id long, text string")
    whole, joined = marks_of(df, share=2e-3), marks_of(df, share=2e-3, most_entries=0)
    assert whole == joined and whole != marks_of(df, share=2e-3, least=10**6)


def test_every_query_runs(spark):
    import __spark_entry__ as e

    for n in (1, 2, 3, 4, 5, 6, 8, 9):
        assert f"p{n}_found" in e.queries()
    assert "p7_ids" in e.queries()
    path = Path("/root/testdata/sf0.001")
    if path.exists():
        for name in (n for n in e.queries() if re.match(r"p\d_", n)):
            assert e.queries()[name](spark, str(path)).select(F.count(F.lit(1))).first()[0] >= 0


def test_a_lone_line_can_be_furniture():
    body = "We measured how the trained system reads {0} over many pages.\nIt reads them line by line and keeps what {0} said.\n"
    pages = scannoise.lines_of(f"{body.format('long texts')}\f\n8\n\f{body.format('short notes')}\f15   Tavask and Bremel\f  Proc. Workshop on Invented Methods, p. 7\f{body.format('old tables')}\fThe Last Sentence stands alone")
    lone = [next(n for n, x in p if x.strip()) for p in pages if sum(bool(x.strip()) for _, x in p) == 1]
    got = scannoise.furniture(pages, set())
    assert got == set(lone[:3])  # the top-line guess is not made for a lone line
    assert scannoise.furniture(scannoise.lines_of("\n12\n"), set()) == scannoise.furniture(scannoise.lines_of("12\n\f\n"), set()) == set()


def test_channel_learns_from_every_kept_word(spark):
    rng = random.Random(11)
    common = sorted({"".join(rng.choice("pxyzkw") for _ in range(7)) for _ in range(5600)})[:5200]
    lines = [" ".join(common[i : i + 40]) for i in range(0, len(common), 40)] * 4 + ["zzheyp"] * 3 + ["zzhcyp"] * 2
    lines = [f"{t} q{i}" for i, t in enumerate(lines)]
    model = scannoise.learn_model(scannoise.numbered(spark.createDataFrame(list(enumerate(lines)), "id long, text string")), least=3).model
    assert len(model.words) == len(common) + 1
    assert model.channel[("c", "e")] > 2 * model.channel[("5", "s")]


def test_candidates_are_not_cut():
    channel = dict.fromkeys(scannoise.CONFUSIONS, 1e-3)
    long = "nu" * 90 + "eye"  # its misread end lies behind more than 400 ways to change one place
    assert [v for v, _, _ in scannoise.Model({long: 50}, {}, {}, set(), 10_000, channel).candidates("nu" * 90 + "cyc")] == ["nu" * 90 + "cyc", long]
    words = {"xixux": 100, "x1xux": 100, "xlxiix": 100, "xlxvx": 100, "xlxnx": 10, "before": 20}
    model = scannoise.Model(words, {"before xlxnx": 10}, {}, set(), 10_000, channel)
    assert len(model.candidates("xlxux")) == 6
    assert [v for v, _, _ in model.decode(["before", "xlxux"])] == ["before", "xlxnx"]


def test_reach_loses_no_candidate():
    rng, channel = random.Random(5), dict.fromkeys(scannoise.CONFUSIONS, 1e-3)
    words = {"".join(rng.choice("celiodnrum") for _ in range(rng.randrange(3, 9))): 50 for _ in range(400)}
    model = scannoise.Model(words, {}, {}, set(), 20_000, channel)

    def changed(w, start):
        return {(w[:i] + printed + w[i + len(read) :], i + len(printed)) for read, printed in channel for i in range(start, len(w)) if w.startswith(read, i)}

    for word in [rng.choice(sorted(changed(w, 0)) or [(w, 0)])[0] for w in words]:
        once = changed(word, 0)
        want = {v for v, _ in once if v in words and v != word}
        if not want and len(word) > 5:
            want = {v for u, i in once for v, _ in changed(u, i) if v in words and v != word}
        if word not in words:
            assert {v for v, _, at in model.candidates(word) if at >= 0} == want


def test_every_order_of_a_class_is_sketched(spark):
    rng, texts = random.Random(2), []
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        mixed = rng.sample(words, 60)
        near = [f"z{rng.randrange(10**6)}" if i in (20, 40) else w for i, w in enumerate(mixed)]
        texts += [words, mixed, near]
    for order in (1, -1):  # whichever member of a class comes first
        df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)][::order], "id long, text string").coalesce(1)
        found = {tuple(r) for r in neardup.expand(*neardup.near_duplicates(df, "id", "text")).collect()}
        assert found == {p for i in range(0, 120, 3) for p in combinations(range(i, i + 3), 2)}


def test_bucket_pairs_take_repeats_once(spark):
    hits = [(c, s) for s in range(3) for c in range(5 + 3 * s)]
    df = spark.createDataFrame(hits * 3, "class_id long, sketch long")
    assert rows(neardup.bucket_pairs(df, small=6)) == sorted(combinations(range(11), 2))


def test_chance_candidates_are_ruled_out_where_they_meet(spark):
    rng = random.Random(9)
    sets = [rng.sample(range(10**6), rng.randrange(5, 60)) for _ in range(60)]
    sets += [s[: len(s) - len(s) // 10] + rng.sample(range(10**6), len(s) // 10) for s in sets] + [sets[0] + sets[1]]
    values = np.array([h for s in sets for h in s * 2], np.int32)
    starts = np.cumsum([0, *(2 * len(s) for s in sets[:-1])])
    bits = list(zip(*(x.tolist() for x in neardup.parity_bits(values, starts)), strict=True))
    assert [n for n, _, _ in bits] == [len(set(s)) for s in sets]
    df = spark.createDataFrame([(c, 1, *own) for c, own in enumerate(bits)], "class_id long, sketch long, size int, low long, high long")
    alike = {(a, b) for a, b in combinations(range(len(sets)), 2) if len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})}
    for small in (256, 5):
        got = {tuple(r) for r in neardup.bucket_pairs(df, small, 0.8).collect()}
        assert alike <= got and len(alike) > 40 and len(got) < 400  # 7260 pairs share the sketch


def test_sketches_in_rounds_are_the_same():
    values, starts, weights = np.arange(200, dtype=np.int32) * 7919 % 301, np.array([0, 50, 120]), np.ones(neardup.BINS, np.float32)
    whole = neardup.sketches(values, starts, weights, 8, 4, 1)
    assert (np.hstack([neardup.sketches(values, starts, weights, 3, 4, 1), neardup.sketches(values, starts, weights, 5, 4, 1, 3)]) == whole).all()


def test_rarer_pairs_and_words_two_confusions_away_count(spark):
    rng = random.Random(4)
    filler = ["".join(rng.choice("gkpwxyz") for _ in range(6)) for _ in range(300)]
    texts = [" ".join(rng.choices(filler, k=300)) + f" grey matter\nblue motter domain\n{i}" for i in range(8)]  # 8 times in about 2,450 words, a share under 0.02
    df = spark.createDataFrame(list(enumerate([*texts, "white matter clomoin"])), "id long, text string")
    learned = scannoise.learn_model(scannoise.numbered(df), share=0.02, pair_share=0.02)
    assert learned.model.pairs["grey matter"] == learned.model.pairs["blue motter"] == 8
    assert "domain" in [v for v, _, _ in learned.model.candidates("clomoin")]  # cl for d and o for a
    how = {"share": 0.02, "pair_share": 0.02, "most_entries": 0}
    assert (8, 0, "misread") in marks_of(df) and marks_of(df) == marks_of(df, **how)


def test_joined_pairs_and_forms_equal_the_sent_ones(spark):
    df = spark.createDataFrame(noisy_corpus(60), "id long, text string")
    for share in (1e-3, 5e-3, 0.03):
        assert marks_of(df, share=share) == marks_of(df, share=share, pair_share=share, most_entries=0)


def test_a_misread_pair_proves_nothing():
    channel = dict.fromkeys(scannoise.CONFUSIONS, 1e-4)
    words = {"remains": 900, "unclear": 500, "undear": 6}
    first = lambda pairs: scannoise.Model(words, pairs, {}, set(), 100_000, channel).decode(["remains", "undear"])[1][0]
    assert first({"remains unclear": 400, "remains undear": 6}) == "unclear"
    assert first({"remains unclear": 40, "remains undear": 6}) == "undear"


def test_known_given_names_do_not_depend_on_their_number(spark):
    spelled = [*BASE, *[f"Wendeline {m}. {f}" for m, f in (("A", "Brenolak"), ("B", "Stuvigor"), ("C", "Wulimant"))], *[f"Anne-Marie {m}. {f}" for m, f in (("A", "Brenolak"), ("B", "Stuvigor"), ("C", "Wulimant"))]]
    spelled += ["Wenni Abelu", "Wendeline Abelu", "Abelu Wendeline", "Abelu Anne-Marie", "Anne Abelu", "Bob Oskar", "Oskar, Robert", "Kathrine Oskar", "Oskar Katherine", "Vamod Genome Collaboration", "Vamod Genome Collab."]
    df = spark.createDataFrame(list(enumerate(spelled)), "id long, name string")
    lists = spark.createDataFrame([("p1", ["Wenni Brenolak"]), ("p1", ["Wendeline A. Brenolak"]), ("p1", ["Wendeline Brenolak"])], "grp string, names array<string>")
    groups = lambda most: {frozenset(g) for g in _groups(names.link_names(df, "id", "name", lists, most_given=most), spelled)}
    want = groups(200_000)
    assert frozenset({"Wenni Abelu", "Wendeline Abelu", "Abelu Wendeline"}) in want and frozenset({"Abelu Anne-Marie", "Anne Abelu"}) in want
    assert groups(1) == want  # a share of 1 / most_given of the names left no given name
