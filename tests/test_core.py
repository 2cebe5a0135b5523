import json
import math
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from scholium.functions import models
from scholium.functions import text as T
from scholium.functions.analysis import porter
from scholium.operators import answering, chunking, context, evaluation, history, retrieval, state
from scholium.session import release
from scholium.settings import Settings
from scholium.sources import arxiv, feeds
from scholium.sources.index_store import IndexStore, conform


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


# ---- history ----------------------------------------------------------------------------------
def stamp(day, hour=0):
    return datetime(2020, 1 + day // 28, 1 + day % 28, hour, tzinfo=UTC)


def history_of(spark, data, every=3):
    df = spark.createDataFrame(data, "id string, version int, title string, at timestamp, seen timestamp, value int, k string")
    store = history.build_store(df, "id", "at", ("version", "title"), rank=("seen",), required=("title",), compare={"title": history.squeeze("title")}, every=every)
    return store, history.reconstruct(store, "id", ("version", "title"))


def test_history_matches_a_fold(spark):
    import random

    rng, data = random.Random(4), []
    for i in range(6):
        for _ in range(60 if i else 200):
            d = rng.randrange(300)
            data.append((f"p{i}", rng.randrange(1, 4), rng.choice(["a b", "a  b", " a b\n", "c", None]), stamp(d) if rng.random() > 0.05 else None, stamp(rng.randrange(300), 1), 1, "x"))
    data += data[:20]
    want = set()
    for key in {r[0] for r in data}:
        best = {}
        for r in data:
            if r[0] == key and r[2] is not None and r[3] is not None:
                new = (r[4], r[1], r[2])
                best[r[3]] = max(best.get(r[3], new), new)
        last = None
        for at in sorted(best):
            s = (best[at][1], "".join(best[at][2].split()))
            if s != last:
                want.add((key, s, at.timestamp()))
            last = s
    store, got = history_of(spark, data)
    assert {(r["id"], (r["version"], "".join(r["title"].split())), r["valid_from"].timestamp()) for r in got.collect()} == want
    assert store.where("kind = 'full'").count() < store.count()
    # the next period begins where one ends
    by = {}
    for r in got.collect():
        by.setdefault(r["id"], []).append((r["seq"], r["valid_from"], r["valid_to"]))
    for v in by.values():
        v.sort()
        assert [x[2] for x in v[:-1]] == [x[1] for x in v[1:]] and v[-1][2] is None


def test_history_edge_cases(spark):
    assert history_of(spark, [])[1].count() == 0
    data = [(None, 1, "t", stamp(1), stamp(1), 1, "x"), ("p", 1, "t", None, stamp(1), 1, "x"), ("p", None, "t", stamp(2), None, 1, "x"), ("p", None, "t", stamp(2), None, 1, "x")]
    assert [(r["version"], r["title"]) for r in history_of(spark, data)[1].collect()] == [(None, "t")]


def test_state_that_returns_starts_anew(spark):
    data = [("p", v, "t", stamp(d), stamp(d), 1, "x") for d, v in ((1, 1), (2, 2), (40, 1), (41, 1))]
    store, got = history_of(spark, data)
    assert [r["version"] for r in got.orderBy("seq").collect()] == [1, 2, 1]
    now = history.as_of(store, "id", ("version", "title"), F.lit(stamp(10)))
    assert [r["version"] for r in now.collect()] == [2]


def test_appended_store_equals_one_built_at_once(spark, tmp_path):
    rng = random.Random(8)
    data = sorted({(f"p{rng.randrange(4)}", rng.randrange(1, 3), rng.choice("abc"), stamp(d), stamp(d), 1, "x") for d in rng.choices(range(300), k=260)}, key=lambda r: r[3])
    data = list({(r[0], r[3]): r for r in data}.values())
    names, how = ("version", "title"), {"rank": ("seen",), "every": 3}
    schema = "id string, version int, title string, at timestamp, seen timestamp, value int, k string"
    whole = history.build_store(spark.createDataFrame(data, schema), "id", "at", names, **how)
    first = history.build_store(spark.createDataFrame(data[:100], schema), "id", "at", names, **how)
    history.write_store(first, str(tmp_path / "s"))
    new = spark.createDataFrame([*data[100:], ("p0", 1, "z", stamp(0), stamp(0), 1, "x"), ("new", 1, "t", stamp(9), stamp(9), 1, "x")], schema)
    grown, late = history.append(history.read_store(spark, str(tmp_path / "s")), new, "id", "at", names, **how)
    assert [r["title"] for r in late.collect()] == ["z"]
    key = ["id", "seq", "block", "kind", "valid_from", "block_to", "patch_version", "patch_title"]
    assert sorted(map(str, grown.where("id <> 'new'").select(key).collect())) == sorted(map(str, whole.select(key).collect()))
    assert grown.where("id = 'new'").count() == 1
    for day in (0, 50, 299):
        at = lambda s: {(r["id"], r["version"], r["title"]) for r in history.as_of(s, "id", names, F.lit(stamp(day))).where("id <> 'new'").collect()}  # noqa: B023, E731
        assert at(grown) == at(whole) == {(r["id"], r["version"], r["title"]) for r in history.reconstruct(whole, "id", names).collect() if r["valid_from"] <= stamp(day).replace(tzinfo=None) and (r["valid_to"] is None or r["valid_to"] > stamp(day).replace(tzinfo=None))}


# ---- functions --------------------------------------------------------------------------------
@pytest.mark.parametrize("text", ["", "  \n", "Überraschend gute Ergebnisse, 3.14!", "word " * 50, "a_b x1 ½ naïve", "數據 集 — test…"])
def test_token_estimate_agrees_with_the_packer(spark, text):
    assert one(spark, T.token_estimate(F.col("t")), t=text) == chunking.count_tokens(text)


def test_text_functions(spark):
    assert one(spark, T.squeeze_blanks(F.col("t")), t=" a \n b ") == "a b"
    assert one(spark, T.squeeze_blanks(F.col("t")), t=" \n ") is None
    assert one(spark, T.sanitise(F.col("t")), t="a\x00b\tc\x0cd") == "ab\tc\x0cd"
    assert one(spark, T.author_key(F.col("t")), t="Ø. O'Neil-Smith, Jr.") == "ø o neil smith jr"
    name, version = T.versioned_id(F.col("t"))
    assert one(spark, name, t="http://x.org/abs/hep-th/9901001v3") == "hep-th/9901001"
    assert one(spark, version, t="http://x.org/abs/2101.00001") == 1
    for url, ok in (("https://export.example.org/a", True), ("https://evilexample.org", False), ("file:///etc/passwd", False), ("http://example.org.evil.com", False), ("HTTPS://EXAMPLE.ORG:8080/x", True), (None, False)):
        assert one(spark, T.url_allowed(F.col("t"), ["example.org"]), t=url) is ok


def test_quality(spark):
    def q(text, pages):
        c = T.quality(F.col("t"), F.lit(pages))
        return spark.createDataFrame([(text,)], "t string").select(c["score"], T.needs_recognition(c)).first()

    assert tuple(q("", 10)) == (0.0, True)
    assert q(None, 1)[1] is True
    score, again = q("#$%^&*()_+ " * 200, 1)
    assert score < 0.5 and again is False
    assert q("Natural sentences contain words of ordinary length. " * 60, 2)[0] > 0.9


def test_quality_reasons_and_choice(spark):
    q = lambda c: T.quality(F.col(c), F.lit(1))
    df = spark.createDataFrame([("good", "Plain words of ordinary length. " * 40, "x"), ("empty", None, "Recognised words of a page. " * 9), ("split", "a b c " * 90, "")], "k string, n string, o string")
    why = {r["k"]: r["r"] for r in df.select("k", q("n")["reasons"].alias("r")).collect()}
    assert why["good"] == [] and why["empty"] == ["extraction produced no text at all"] and why["split"] == ["mean word length 1.0 suggests character-level fragmentation"]
    choice = T.choose_extraction(q("n"), q("o"), F.col("o") != "")
    assert {r["k"]: (r["m"], r["s"]) for r in df.select("k", choice["method"].alias("m"), choice["ocr_skipped_reason"].alias("s")).collect()} == {"good": ("pymupdf", None), "empty": ("ocr", None), "split": ("pymupdf", "ocr_disabled_by_configuration")}
    assert spark.range(1).select(T.page_ratio(F.lit("x" * 60 + "\f"), F.lit(2)), T.page_ratio(F.lit("x"), F.lit(0))).first() == (0.5, 0.0)


def test_labels(spark):
    labels = lambda t: one(spark, F.array_join(T.citation_labels(F.col("t")), ","), t=t)
    assert labels("x [P1, P2] y [p 1] z [P07] [1] [note](P3) [P9") == "P1,P2,P7"


# ---- retrieval --------------------------------------------------------------------------------
def test_fusion_by_hand(spark):
    lists = spark.createDataFrame([("q", "s", 1, 3, 40.0), ("q", "s", 2, 3, 0.1), ("q", "a", 1, 1, 10.0), ("q", "b", 2, 1, 0.9)], "query_id string, chunk_id string, li int, rank int, score double")
    got = {r["chunk_id"]: (r["score"], r["rank"]) for r in retrieval.reciprocal_rank(lists).collect()}
    assert got["s"] == (round(2 / 63, 12), 1) and got["a"] == (round(1 / 61, 12), 2) and got["b"][1] == 3
    w = {r["chunk_id"]: r["score"] for r in retrieval.weighted(lists, [0.5, 0.5]).collect()}
    assert w == {"s": 0.5, "a": 0.0, "b": 0.5}


def test_alike_is_greedy(spark):
    base = "granite basalt marble slate quartz"
    data = [("q", "a", 1, f"{base} onyx"), ("q", "b", 2, f"{base.upper()} jade"), ("q", "c", 3, None), ("q", "d", 4, " "), ("q", "e", 5, base)]
    df = spark.createDataFrame(data, "query_id string, chunk_id string, rank int, text string")
    # a and b share 5 of 7 words, e is 5 of the 6 words of either
    assert rows(retrieval.drop_alike(df, threshold=0.9).select("chunk_id")) == [("a",), ("b",), ("e",)]
    assert rows(retrieval.drop_alike(df, threshold=0.8).select("chunk_id")) == [("a",), ("b",)]
    assert rows(retrieval.drop_alike(df, threshold=0.7).select("chunk_id")) == [("a",)]


def test_alike_takes_long_lists_whole(spark):
    import random

    rng, data = random.Random(7), []
    for q, n in (("hot", 400), ("cold", 30)):
        texts = []
        for _ in range(n):
            words = list(rng.choice(texts)) if texts and rng.random() < 0.5 else [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 25))]
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(60)}"
            texts.append(words)
        data += [(q, f"{q}{i:03}", i + 1, " ".join(w)) for i, w in enumerate(texts)]
    df = spark.createDataFrame(data, "query_id string, chunk_id string, rank int, text string").repartition(5)
    for threshold in (0.5, 0.8, 0.9, 1.0):
        want, kept = [], {}
        for q, c, _, t in data:
            own, before = set(t.split()), kept.setdefault(q, [])
            if not any(len(own & k) / len(own | k) >= threshold for k in before):
                before.append(own)
                want.append((q, c, len(before)))
        assert rows(retrieval.drop_alike(df, threshold=threshold)) == sorted(want)


def test_bm25_by_brute_force(spark):
    docs = [(1, "red green red"), (2, "green blue"), (3, None), (4, ""), (5, "Blue blue BLUE sky")]
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.bm25(spark.createDataFrame(docs, "d long, t string"), "d", {"t": (T.word_runs(F.col("t")), 1.0)}, spark.createDataFrame([(9, "red blue blue"), (8, None)], "q long, s string"), "q", {"t": T.word_runs(F.col("s"))}).collect()}
    words = {d: t.lower().split() for d, t in docs if t}
    avg = sum(map(len, words.values())) / len(words)
    want = {}
    for d, w in words.items():
        s = 0.0
        for term, qtf in (("red", 1), ("blue", 2)):
            df, tf = sum(term in x for x in words.values()), w.count(term)
            s += qtf * math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg)) if tf else 0
        if s:
            want[(9, d)] = round(s, 6)
    assert got == pytest.approx(want)


def test_rerank_falls_back(spark):
    data = [("q", "a", 1, 0.1), ("q", "b", 2, 0.9), ("r", "c", 1, None), ("r", "d", 2, 0.9)]
    df = retrieval.rerank(spark.createDataFrame(data, "query_id string, chunk_id string, rank int, s double"), "s", 5)
    assert rows(df.select("chunk_id", "new_rank")) == [("a", 2), ("b", 1), ("c", 1), ("d", 2)]


# ---- evaluation, context, state ----------------------------------------------------------------
def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", d, r) for r, d in enumerate(["oak", "elm", "fir", "yew"], 1)], "query_id string, doc string, rank int")
    relevant = spark.createDataFrame([("q", "elm"), ("q", "yew"), ("q", "ash"), ("none", "z")], "query_id string, doc string")
    m = {r["query_id"]: r for r in evaluation.query_metrics(ranked, relevant, (4,)).collect()}
    ideal = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert m["q"]["ndcg_4"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / ideal, abs=1e-6) and m["q"]["precision_4"] == 0.5 and m["q"]["recall_4"] == pytest.approx(2 / 3, abs=1e-6) and m["q"]["mrr"] == 0.5
    assert m["none"]["ndcg_4"] == 0.0 and m["none"]["hit_4"] == 0.0
    assert rows(evaluation.misses(ranked, relevant)) == [("none",)]
    assert rows(evaluation.missing_labels(relevant, ranked.select("doc"))) == [("ash", 1), ("z", 1)]


def test_latency_by_brute_force(spark):
    rng, data = random.Random(3), []
    for g, n in (("big", 4000), ("one", 1), ("two", 2), (None, 7)):
        data += [(g, float(rng.choice([rng.randrange(50), rng.random() * 1000]))) for _ in range(n)]
    df = spark.createDataFrame([*data, ("big", None)], "g string, v double").repartition(4)
    for accuracy in (100, 10_000):  # the first brackets the large group, the second takes it whole
        for r in evaluation.latency(df, "g", "v", accuracy).collect():
            own = sorted(v for g, v in data if g == r["grp"])
            n = len(own)
            assert (r["n"], r["least"], r["most"], r["p90"]) == (n, round(own[0], 6), round(own[-1], 6), round(own[min(n - 1, int(n * 0.9))], 6))
            assert r["median"] == pytest.approx((own[(n - 1) // 2] + own[n // 2]) / 2, abs=1e-5) and r["mean"] == pytest.approx(sum(own) / n, abs=1e-5)
    assert evaluation.latency(df.limit(0), "g", "v").count() == 0


def test_sweep_and_report(spark, tmp_path):
    runs = {"a": spark.createDataFrame([("q", "p1", 1), ("q", "p1", 2), ("q", "p2", 3)], "query_id string, arxiv_id string, rank int"), "b": spark.createDataFrame([("q", "p2", 1)], "query_id string, arxiv_id string, rank int")}
    examples = spark.createDataFrame([("q", "conceptual"), ("r", "conceptual"), ("unjudged", "x")], "query_id string, category string")
    relevant = spark.createDataFrame([("q", "p2"), ("r", "p9")], "query_id string, doc string")
    means = evaluation.sweep(runs, examples, relevant)
    assert rows(means.select("config", F.coalesce("category", F.lit("")), "queries", "mrr")) == [("a", "", 2, 0.25), ("a", "conceptual", 2, 0.25), ("b", "", 2, 0.5), ("b", "conceptual", 2, 0.5)]
    text = evaluation.report(means, evaluation.review_line(2, 0), metrics=("mrr",))
    assert "| b | 2 | 0.500 |" in text and "unreviewed" in text and evaluation.review_line(0, 0) != "0 examples, all human-reviewed"
    assert '"rrf_k": 60' in evaluation.config_snapshot("a", retrieval.Search())
    evaluation.write_results(means, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4


# ---- context and answers ------------------------------------------------------------------------
def offered(spark, sizes):
    data = [("q", i, f"c{i}", f"p{i}", 1, "T", ["A", "B"], "2024", None, None, "word " * n) for i, n in sizes]
    return spark.createDataFrame(data, "query_id string, rank int, chunk_id string, arxiv_id string, version int, title string, authors array<string>, published_at string, section string, subsection string, text string")


def test_pack_skips_what_does_not_fit(spark):
    df = offered(spark, ((1, 50), (2, 500), (3, 20)))
    packed = context.pack(context.costed(df), budget=150)
    assert rows(packed.select("rank", "chunk_id", "label")) == [(1, "c1", "P1"), (3, "c3", "P2")]
    text = context.render(packed, df).first()["context"]
    assert text.startswith("[P1] T (A et al., 2024) — body\nword") and "\n\n[P2] T" in text
    assert rows(context.totals(df, packed).select("included", "dropped", "truncated", "labels")) == [(2, 1, True, 2)]


def test_pack_walks_the_whole_list(spark):
    sizes = [50, *[500] * 130, 20]  # what fits at last stands behind rank 100
    packed = context.pack(context.costed(offered(spark, enumerate(sizes, 1))), budget=150)
    assert rows(packed.select("rank", "chunk_id", "label")) == [(1, "c1", "P1"), (132, "c132", "P2")]
    assert rows(context.citations(packed).select("label", "chunk_ids")) == [("P1", "c1"), ("P2", "c132")]


@pytest.mark.parametrize(
    ("text", "labels", "left"),
    [("Seen [P4; P7].", ["P7"], "Seen [P4]."), ("Seen [P7, P4] twice [ p7 ].", ["P7"], "Seen [P4] twice ."), ("a , b\tc  d [P1]", ["P3"], "a , b\tc d [P1]"), (" kept as it is  ", [], " kept as it is  "), ("x\n\n[P2]\ny", ["P2"], "x\n\n\ny")],
)
def test_labels_are_stripped(spark, text, labels, left):
    assert one(spark, T.strip_labels(F.col("t"), F.array(*map(F.lit, labels)).cast("array<string>")), t=text) == left


def test_malformed_labels(spark):
    assert one(spark, F.array_join(T.malformed_labels(F.col("t")), "|"), t="a [3] b [ Source 12 ] c [P1, 4] d [note] e [ref7]") == "3|Source 12|ref7"


def test_answers(spark):
    asked = [(1, "q1", "ctx", ["P1", "P2"], False), (2, "q2", " ", ["P1"], True), (3, "q3", None, None, None), (4, "q4", "ctx", ["P1"], True), (5, " ", "ctx", ["P1"], False), (6, "q6", "ctx", ["P1"], False)]
    replies = [(1, " Yes [P2] [P8] [4]. ", "length"), (2, "made up [P1]", "stop"), (4, "INSUFFICIENT_EVIDENCE, sorry", "stop")]
    a = spark.createDataFrame(asked, "query_id int, question string, context string, supplied array<string>, truncated boolean")
    r = spark.createDataFrame(replies, "query_id int, text string, finish_reason string")
    got = {x["query_id"]: x for x in context.answers(a, r).collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    x = got[1]
    assert (x["text"], x["used"], x["invented"], x["malformed"], x["uncited"], x["grounded"], x["has_problems"], x["hit_token_limit"]) == ("Yes [P2] [P8] [4].", ["P2"], ["P8"], ["4"], ["P1"], False, True, True)
    assert x["summary"] == "18 chars, 1/2 sources cited, INVENTED P8, malformed 4, hit token limit"
    assert got[2]["refusal_reason"] == got[3]["refusal_reason"] == "no_evidence" and got[2]["supplied"] == []
    assert got[4]["refusal_reason"] == "model_declined" and got[4]["supplied"] == ["P1"] and got[4]["truncated_context"] and got[6]["text"] is None and not got[6]["refused"]


# ---- state --------------------------------------------------------------------------------------
def test_first_arrival_wins_ties(spark):
    batch = spark.createDataFrame([("k", 5, "late", 2), ("k", 5, "early", 1), ("k", 3, "old", 0), ("n", None, "x", 1)], "key string, at int, item string, n int")
    none = spark.createDataFrame([("k", 5, "stored"), ("other", 1, "kept")], "key string, at int, item string")
    assert rows(state.advance(none.limit(0), batch, "key", "at", "item", "n")) == [("k", 5, "early")]
    assert rows(state.advance(none, batch, "key", "at", "item", "n")) == [("k", 5, "stored"), ("other", 1, "kept")]
    assert rows(state.read_checkpoint(none, spark.createDataFrame([("k",), ("new",)], "key string"), "key", "at").fillna(-1)) == [("k", 5), ("new", -1)]


def test_runs(spark):
    t = lambda h: F.lit(datetime(2024, 1, 1, h, tzinfo=UTC))
    run = state.start_run(spark, "r1", "incremental", t(5))
    done = state.finish_run(run, "r1", {"failed": 2, "fetched": 9}, t(3)).first()
    assert done["status"] == "PARTIAL" and done["finished_at"] == done["started_at"] and done["fetched"] == 9
    assert state.finish_run(run, "r1", {}, t(9), "boom").first()["status"] == "FAILED" and state.recent_runs(run).count() == 1


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 2)], "id string, v int")
    new = spark.createDataFrame([("a", 1, 1), ("a", 3, 2), ("a", 2, 3), ("b", 1, 4), ("b", 1, 5), (None, 1, 6)], "id string, v int, t int")
    got = {(r["id"], r["v"]): (r["outcome"], r["is_latest"]) for r in state.upsert(old, new, "id", "v", "t").collect()}
    assert got == {("a", 1): ("UPDATED", False), ("a", 2): (None, False), ("a", 3): ("UPDATED", True), ("b", 1): ("CREATED", True)}
    again = state.upsert(spark.createDataFrame(list(got), "id string, v int"), new, "id", "v", "t")
    assert {r["outcome"] for r in again.collect()} == {None}


def test_backoff(spark):
    got = spark.range(8).select(T.backoff(F.col("id")))
    assert [r[0] for r in got.collect()] == [60, 120, 240, 480, 960, 1920, 3600, 3600]


# ---- structure --------------------------------------------------------------------------------
PAPER = "A Title\nJane Roe\n\nAbstract\nShort text here.\n\n1 Introduction\n" + "This is a sentence about things. " * 60 + "\n\n2 Method\nIntro of it.\n2.1 Data\nSome data were used, e.g. These ones.\nRESULTS AND MORE\nFine.\n\nReferences\n[1] x"


def test_sections_and_chunks(spark):
    df = spark.createDataFrame([(1, PAPER, "x"), (2, None, "x"), (3, "", "x")], "id long, text string, title string")
    got = [(r["title"], r["parent"], r["level"], r["kind"]) for r in chunking.sections(df, "id", "text").orderBy("doc", "section_index").collect()]
    assert got == [(None, None, 1, "title"), ("Abstract", None, 1, "abstract"), ("Introduction", None, 1, "body"), ("Method", None, 1, "body"), ("Data", "Method", 2, "body"), ("Results And More", None, 1, "body"), ("References", None, 1, "references")]
    limits = chunking.Limits(most=100, least=20, overlap=20)
    chunks = chunking.chunk_texts(df, "id", "text", limits).orderBy("chunk_index").collect()
    assert [c["chunk_index"] for c in chunks] == list(range(len(chunks))) and all(c["tokens"] <= 100 for c in chunks) and len(chunks) > 5
    assert not any("[1] x" in c["text"] for c in chunks) and all(c["tokens"] == chunking.count_tokens(c["text"]) for c in chunks)


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("4.2 Sampling of Leaves", ("Sampling of Leaves", "4.2", 2, "body")), ("vi. Outlook", ("Outlook", "VI", 1, "body")), ("LX. FIELD NOTES", ("Field Notes", "LX", 1, "body")),
        ("appendix C. Tables", ("Appendix C: Tables", "C", 1, "appendix")), ("Appendix", ("Appendix", None, 1, "appendix")), ("Works cited:", ("Works cited", None, 1, "references")),
        ("Supplementary Material", ("Supplementary Material", None, 1, "appendix")), ("7 References and Data", ("References and Data", "7", 1, "references")), ("OUR O'NEIL-SET", ("Our O'Neil-Set", None, 1, "body")),
        ("Summary", ("Summary", None, 1, "abstract")), ("3 we begin here", None), ("3 We begin here.", None), ("AB", None), ("A plain line of text", None), ("X" * 91, None), ("REFERENCES", ("References", None, 1, "references")),
    ],
)
def test_headings(spark, line, want):
    got = spark.createDataFrame([(line,)], "t string").select(chunking.heading(F.col("t")).alias("h")).first()["h"]
    assert (tuple(got) if got else None) == want


def spans_one_by_one(texts, most, overlap, count):
    """Runs found by trying every end and every beginning."""
    spans, a, b = [], 0, 0
    while b < len(texts):
        if spans and overlap:
            back = b - 1
            while back > a and sum(map(count, texts[back - 1 : b])) <= overlap:
                back -= 1
            while back < b and count("\n\n".join(texts[back : b + 1])) > most:
                back += 1
            a = back
        else:
            a = b
        b = next((e for e in range(len(texts), b, -1) if count("\n\n".join(texts[a:e])) <= most), b + 1)
        spans.append((a, b))
    return spans


def test_runs_by_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        texts = [" ".join(rng.choice(["word", "extraordinary", "x-1", "3.5"]) for _ in range(rng.randrange(1, 15))) for _ in range(rng.randrange(1, 14))]
        most, overlap = rng.randrange(5, 60), rng.randrange(0, 25)
        assert list(chunking.Units(texts, chunking.EstimatedTokens()).runs(most, overlap)) == spans_one_by_one(texts, most, overlap, chunking.count_tokens)


def test_stray_passages(spark):
    counter, limits = chunking.EstimatedTokens(), chunking.Limits(most=60, least=20, overlap=0, noise=8, absolute=3)
    make = lambda place, n: chunking.Passage((place, None), "body", " ".join(["word"] * n), (n, 0, 0))
    sizes = lambda ps: [(p.place[0], p.counts[0]) for p in chunking.consolidate(ps, limits, counter)]
    assert sizes([make("a", 3), make("a", 30)]) == [("a", 30)]  # a stray start is gone before it can be joined
    assert sizes([make("a", 30), make("a", 3)]) == [("a", 33)]
    assert sizes([make("a", 40), make("a", 12), make("b", 5), make("c", 1)]) == [("a", 40), ("a", 12), ("b", 5)]
    assert sizes([make("a", 1), make("b", 2), make("b", 1)]) == [("b", 2)] and sizes([]) == []


def test_other_tokenizers_can_count(spark):
    df = spark.createDataFrame([(1, "Alpha beta gamma. " * 40)], "id long, text string")
    got = chunking.chunk_texts(df, "id", "text", chunking.Limits(most=90, least=0, overlap=0), counter=chunking.ExactTokens(list)).collect()
    assert len(got) > 6 and all(r["tokens"] <= 90 for r in got)


def test_long_texts_keep_their_end(spark):
    text = "1 Introduction\n" + "\n\n".join(f"Part {i} " + "has some more words of its own " * 12 + "." for i in range(700)) + "\n\nThe very end of it is here."
    df = spark.createDataFrame([(1, text)], "id long, text string")
    limits = chunking.Limits(most=100, least=20, overlap=0)
    whole = chunking.chunk_texts(df, "id", "text", limits).orderBy("chunk_index").collect()
    assert len(whole) > 600 and whole[-1]["text"].endswith("The very end of it is here.")
    assert chunking.chunk_texts(df, "id", "text", chunking.Limits(most=100, least=20, overlap=0, chunks=500)).count() <= 500


def test_sentences_keep_abbreviations(spark):
    got = one(spark, F.array_join(chunking.split_sentences(F.col("t")), "|"), t="It took approx. 40 tries by Dr.  Quist. 12 failed! As in Tab. 3 we stop? no")
    assert got == "It took approx. 40 tries by Dr. Quist.|12 failed!|As in Tab. 3 we stop? no"


# ---- sources ----------------------------------------------------------------------------------
def test_query_string():
    q = arxiv.Query(categories=["math.CO", "hep-th"], authors=['Ada "B" Curie'], updated=(datetime(2021, 7, 9, 10, 11, tzinfo=UTC), None))
    assert q.search() == '(cat:math.CO OR cat:hep-th) AND (au:"Ada B Curie") AND lastUpdatedDate:[202107091011 TO 999912312359]'
    assert q.page(20, 5000) == {"search_query": q.search(), "start": 20, "max_results": 2000, "sortBy": "lastUpdatedDate", "sortOrder": "ascending"}
    at = datetime(2021, 1, 1, tzinfo=UTC)
    for bad in ({}, {"categories": ["CS!"]}, {"updated": (datetime(2021, 1, 1), None)}, {"submitted": (at, at.replace(year=2020))}, {"updated": (None, at)}, {"keywords": ["x"], "sort_by": "size"}):
        with pytest.raises(ValueError):
            arxiv.Query(**bad)
    with pytest.raises(ValueError):
        arxiv.Query(keywords=[' " ']).search()


def feed(*entries, total=2):
    return f'<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom" xmlns:o="http://a9.com/-/spec/opensearch/1.1/"><o:totalResults>{total}</o:totalResults>{"".join(entries)}</feed>'


def test_feed(spark, tmp_path):
    entry = '<entry><id>http://arxiv.org/abs/1907.00321v5</id><title> On\n moss </title><summary>s</summary><published>2019-07-01T00:00:00Z</published><updated>2020-02-01T00:00:00Z</updated><author><name>J. Roe</name></author><arxiv:primary_category term="q-bio.PE"/><category term="math.CO"/><category term="q-bio.PE"/><link href="http://arxiv.org/pdf/x" title="pdf" rel="related"/></entry>'
    bad = "<entry><id>http://arxiv.org/api/errors#x</id><title>Error</title></entry>"
    (tmp_path / "f.xml").write_text(feed(entry, bad))
    feeds.register(spark)
    for raw in (arxiv.read_feed(spark, str(tmp_path / "f.xml")), spark.read.format("stored_feed").load(str(tmp_path / "*.xml"))):
        good, aside = arxiv.split_valid(arxiv.parse_entries(raw))
        ok = good.first()
        assert (ok["arxiv_id"], ok["version"], ok["title"], ok["categories"], ok["pdf_url"]) == ("1907.00321", 5, "On moss", ["q-bio.PE", "math.CO"], "http://arxiv.org/pdf/x") and good.count() == aside.count() == 1
        assert arxiv.by_ids(good, spark.createDataFrame([("1907.00321",), (None,)], "arxiv_id string")).count() == 1
    page = feeds.parse_page(feed(entry, total=77))
    assert (page.total, page.start, len(page.entries)) == (77, 0, 1)


def test_paged_scan():
    asked = []

    def fetch(start, size):
        asked.append((start, size))
        return feeds.Page(11, start, list(range(11))[start : start + min(size, 4)])

    assert list(feeds.scan(fetch, 5)) == list(range(11)) and asked == [(0, 5), (4, 5), (8, 5)]
    assert list(feeds.scan(fetch, 5, limit=6)) == list(range(6)) and list(feeds.scan(fetch, 5, limit=0)) == []
    assert list(feeds.scan(lambda a, n: feeds.Page(9, a, ["x"] if a == 0 else []))) == ["x"]
    waits, now = [], [0.0]
    pace = feeds.Pace(3.0, lambda: now[0], lambda s: (waits.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(3):
        pace.wait()
    assert waits == [3.0, 3.0]
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise feeds.Transient
        return "ok"

    assert feeds.with_retries(flaky, 3, sleep=waits.append) == "ok" and waits[2:] == [1.0, 2.0]
    with pytest.raises(KeyError):
        feeds.with_retries(lambda: {}["x"], 3)


def test_dataset(spark, tmp_path):
    item = {"id": "e1", "query": "q", "category": "conceptual", "relevant_arxiv_ids": ["1"], "notes": "n", "label_source": "human_verified"}

    def load(*items):
        (tmp_path / "d.json").write_text(json.dumps({"version": "1", "created": "x", "examples": list(items)}))
        return arxiv.read_dataset(spark, str(tmp_path / "d.json"))

    assert rows(load(item, item | {"id": "e2", "reviewed": True}).select("id", "reviewed")) == [("e1", False), ("e2", True)]
    for bad in ((), (item, item), (item | {"category": "odd"},), (item | {"notes": " "},), (item | {"relevant_arxiv_ids": []},), (item | {"label_source": None},)):
        with pytest.raises(ValueError):
            load(*bad)


def test_settings():
    s = Settings.read({"SCHOLIUM_CATEGORIES": "cs.CL, cs.IR,", "SCHOLIUM_PDF_HOSTS": '["a.org"]', "SCHOLIUM_TOP_K": "7", "SCHOLIUM_INTERVAL": "0.5"})
    assert (s.categories, s.pdf_hosts, s.top_k, s.interval, s.search().k, s.limits().most) == (("cs.CL", "cs.IR"), ("a.org",), 7, 0.5, 7, 512)
    for bad in ({"SCHOLIUM_TOP_K": "0"}, {"SCHOLIUM_TOP_K": "x"}, {"SCHOLIUM_MODE": "magic"}):
        with pytest.raises(ValueError):
            Settings.read(bad)


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    from scholium.streaming.incremental import ingest

    seen = []
    for n in range(2):
        spark.createDataFrame([(n,)], "n int").write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark, str(tmp_path / "in"), "n int", str(tmp_path / "cp"), lambda df, i: seen.extend(r[0] for r in df.collect())).awaitTermination()
    assert seen == [0, 1]


def test_index_store(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    name, refused = store.build(spark.createDataFrame([("a", 1, "p", 1), ("a", 2, "p", 1), ("b", 1, "p", 2), (None, 3, "p", 1)], "chunk_id string, indexed_at int, arxiv_id string, version int"), "one")
    assert store.live is None
    store.switch(name)
    assert refused.count() == 1 and rows(store.read().select("chunk_id", "indexed_at")) == [("a", 2), ("b", 1)]
    again = IndexStore(spark, str(tmp_path))  # the pointer outlives the object
    assert again.live == "one" and again.ensure_ready(store.read()) == "one"
    new = again.delete_paper("p", 1)
    assert again.live == new != "one" and rows(again.read().select("chunk_id")) == [("b",)] and again.count("one") == 2
    with pytest.raises(ValueError):
        again.delete(new)
    assert again.delete("one")


def test_index_documents_conform(spark):
    docs = spark.createDataFrame([("a", "Running tests", [0.1, 0.2]), (None, "x", None), ("b", None, [0.1])], "chunk_id string, text string, embedding array<double>")
    got = {r["chunk_id"]: (r["refused"], r["text_stems"], r["text_exact"]) for r in conform(docs, 2).collect()}
    assert got == {"a": (None, ["run", "test"], ["running", "tests"]), None: ("no chunk_id", ["x"], ["x"]), "b": ("embedding length", None, None)}
    with pytest.raises(ValueError):
        conform(docs.withColumn("odd", F.lit(1)))


# ---- analysers and models -----------------------------------------------------------------------
@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("sized", "size"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("hopefulness", "hope"), ("electrical", "electr"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("sky", "sky"), ("is", "is"), ("naïve", "naïve")])
def test_stems(word, stem):
    assert porter(word) == stem


def test_search_modes(spark):
    texts = ["Granite cliffs of the north. They weather slowly", "Weathering of granite. A long study of cliffs", "Bread and butter. Recipes", None, "Weathering of granite. A long study of cliffs"]
    chunks = spark.createDataFrame([(f"c{i}", "p" if i in (1, 4) else f"p{i}", t, (t or "").split(".")[0]) for i, t in enumerate(texts)], "chunk_id string, arxiv_id string, text string, title string")
    chunks = models.embed(chunks, "text", models.get_provider())
    ask = models.embed(spark.createDataFrame([("q", "weathered granite"), ("none", None)], "query_id string, query string"), "query", models.get_provider(), queries=True)
    keyword = retrieval.search(chunks, ask, retrieval.Search("keyword")).collect()
    assert [(r["chunk_id"], r["rank"]) for r in sorted(keyword, key=lambda r: r["rank"])] == [("c1", 1), ("c4", 2), ("c0", 3)]
    assert retrieval.search(chunks, ask, retrieval.Search("vector", k=3)).count() == 3
    for fusion in ("rrf", "weighted"):
        hybrid = sorted((r["rank"], r["chunk_id"]) for r in retrieval.search(chunks, ask, retrieval.Search(fusion=fusion)).collect())
        assert {c for _, c in hybrid} <= {"c0", "c1", "c2", "c4"} and len({"c1", "c4"} & {c for _, c in hybrid}) == 1 and [r for r, _ in hybrid] == [1, 2, 3]
    with pytest.raises(ValueError):
        retrieval.search(chunks, ask, retrieval.Search("odd"))


def test_gathered_context(spark):
    texts = {"a1": "Moss grows on granite in the shade.", "a2": "Granite walls carry moss and lichen.", "b1": "Trains leave at noon.", "c1": None}
    rows_ = [(c, c[0], 1, f"Title {c[0]}", ["Ada"], "2020-01-01", "Intro", None, t) for c, t in texts.items()]
    chunks = spark.createDataFrame(rows_, "chunk_id string, arxiv_id string, version int, title string, authors array<string>, published_at string, section string, subsection string, text string")
    chunks = models.embed(chunks, "text", models.get_provider())
    ask = models.embed(spark.createDataFrame([("q", "moss on granite"), ("void", None)], "query_id string, query string"), "query", models.get_provider(), queries=True)

    class ByLength:
        def warmup(self):
            pass

        def score(self, queries, texts):
            return [-len(t) for t in texts]

    how = retrieval.Search("keyword", k=2)
    _, told = answering.gather(chunks, ask, how)
    got = {r["query_id"]: r for r in told.collect()}
    assert got["q"]["supplied"] == ["P1"] and got["q"]["context"].count("[P1] Title a (Ada, 2020) — Intro") == 2 and got["void"]["context"] is None and not got["q"]["truncated"]
    packed, _ = answering.gather(chunks, ask, how, ByLength())
    assert [r["chunk_id"] for r in packed.orderBy("rank").collect()] == ["a1", "a2"]
    _, tight = answering.gather(chunks, ask, how, budget=30)
    assert tight.where("query_id = 'q'").first()["truncated"]
    replies = spark.createDataFrame([("q", "Moss [P1].", "stop")], "query_id string, text string, finish_reason string")
    assert rows(context.answers(told, replies).select("query_id", "refusal_reason", F.array_join("used", ","))) == [("q", None, "P1")]


def test_lists_merge_with_what_found_them(spark):
    lists = spark.createDataFrame([("q", "a", 2, "vector", 1, 0.5, "late"), ("q", "a", 1, "keyword", 4, 9.0, "early"), ("q", "b", 2, "vector", 2, 0.4, None)], "query_id string, chunk_id string, li int, retriever string, rank int, score double, title string")
    got = {r["chunk_id"]: (r["title"], [tuple(c) for c in r["contributions"]]) for r in retrieval.merge_lists(lists, "title").collect()}
    assert got == {"a": ("early", [("keyword", 4, 9.0), ("vector", 1, 0.5)]), "b": (None, [("vector", 2, 0.4)])}
    for bad in (lambda: retrieval.reciprocal_rank(lists, 0), lambda: retrieval.cap_per_paper(lists, "title", 0)):
        with pytest.raises(ValueError):
            bad()


def test_times_and_places(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2020-01-01T00:00:00Z",), ("2020-01-01T00:00:00",), ("2020-01-01T02:00:00+02:00",), ("soon",), (None,)], "at string")
        assert [r[0] for r in df.select(F.unix_seconds(arxiv.moment("at"))).collect()] == [1577836800] * 3 + [None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.createDataFrame([("A", "B", "k"), ("A", None, "k"), (None, "B", "k"), ("", "", "k")], "s string, u string, kind string")
    assert [r[0] for r in df.select(T.location(F.col("s"), F.col("u"), F.col("kind"))).collect()] == ["A > B", "A", "k", "k"]


def test_result_rows(spark):
    hits = spark.createDataFrame([("q", "a", 2.5, 1), ("q", "b", None, 2), ("r", "c", 1.0, 1)], "query_id string, chunk_id string, score double, rank int")
    made = {r["chunk_id"]: (r["score"], [tuple(c) for c in r["contributions"]]) for r in retrieval.hit_rows(hits, "keyword").collect()}
    assert made["b"] == (0.0, [("keyword", 2, 0.0)]) and made["a"][0] == 2.5
    assert rows(retrieval.result_summary(hits.where("query_id = 'q' AND rank = 1"), hits, "hybrid").select("query_id", "summary")) == [("q", "hybrid: 1 of 2 candidates"), ("r", "hybrid: 0 of 1 candidates")]
    kept = retrieval.rerank(hits, "score", 5)
    assert {r["query_id"]: (r["applied"], r["reason"]) for r in kept.collect()} == {"q": (False, "missing_scores"), "r": (True, None)}
    assert retrieval.rerank(hits, "score", 5, enabled=False).select("reason").distinct().first()[0] == "disabled"


def test_operators_take_empty_tables(spark):
    lists = spark.createDataFrame([], "query_id string, chunk_id string, li int, retriever string, rank int, score double, arxiv_id string, text string")
    assert retrieval.reciprocal_rank(lists).count() == retrieval.weighted(lists, [0.5, 0.5]).count() == retrieval.drop_alike(lists).count() == retrieval.cap_per_paper(lists, "arxiv_id").count() == 0
    docs = spark.createDataFrame([], "d string, t string, e array<double>")
    asked = spark.createDataFrame([("q", "x", [1.0])], "q string, s string, v array<double>")
    words = {"t": (T.word_runs(F.col("t")), 1.0)}
    assert retrieval.bm25(docs, "d", words, asked, "q", {"t": T.word_runs(F.col("s"))}).count() == retrieval.nearest(docs, "d", "e", asked, "q", "v").count() == 0
    full = docs.union(spark.createDataFrame([("a", "x y", [1.0])], docs.schema))
    assert retrieval.bm25(full, "d", words, asked.limit(0), "q", {"t": T.word_runs(F.col("s"))}).count() == retrieval.nearest(full, "d", "e", asked.limit(0), "q", "v").count() == 0
    assert chunking.chunk_texts(docs, "d", "t").count() == chunking.sections(docs, "d", "t").count() == 0
    assert context.pack(context.costed(offered(spark, ((1, 1),)).limit(0))).count() == 0


def test_search_in_blocks_of_queries(spark, monkeypatch):
    rng = random.Random(4)
    v = spark.createDataFrame([(i, [rng.random() - 0.5 for _ in range(5)] if i % 9 else [0.0] * 5, 0) for i in range(60)], "id long, e array<double>, score int")
    whole = rows(retrieval.nearest(v, "id", "e", v, "id", "e", 4))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    assert rows(retrieval.nearest(v, "id", "e", v, "id", "e", 4)) == whole and len(whole) == 4 * 53
    release(spark)


def test_models(spark):
    df = models.embed(spark.createDataFrame([("a",), (None,)], "t string"), "t", models.StableEmbeddings(48))
    got = df.withColumn("own", T.stable_vector(F.col("t"), 48)).orderBy(F.asc_nulls_last("t")).collect()
    assert got[0]["vector"] == pytest.approx(got[0]["own"]) and got[1]["vector"] is None

    class Lengths:
        def warmup(self):
            self.ready = True

        def score(self, queries, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError
            return [len(t) for t in texts]

    pairs = spark.createDataFrame([("q", "abc"), ("q", None), ("r", "bad")], "query string, text string").coalesce(1)
    assert [r["rerank_score"] for r in models.score_pairs(pairs, "query", "text", Lengths(), batch=1).collect()] == [3.0, 0.0, None]
    scripted = models.ScriptedModel(["one", "two"])
    assert [scripted.complete([]) for _ in range(3)] == ["one", "two", "two"]


def test_entry_has_every_core_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "p5_found" in e.queries()
