"""Operators that SQL does not express, against plain Python, and rules on small inputs."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import article_index as A
from lectern.operators import blocks as B
from lectern.operators import grams as G
from lectern.operators import journal as J
from lectern.operators import similarity as S
from lectern.operators import visual as V
from lectern.sources import bundles, sheet
from lectern.streaming import outbox


def column(spark, expr, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(expr).collect()]


ARTICLE = "document_id string, title string, content string, topics array<string>, technical_entities array<string>, key_parameters array<string>, methods array<string>, application_scenarios array<string>, validation_methods array<string>"
ARTICLES = [
    ("a", "Quad frame", "A frame of carbon for a small quad, 250 mm, with notes on vibration.", ["frame", "quad"], ["STM32"], ["250 mm"], ["test"], ["indoor"], ["bench"]),
    ("b", "Quad frame two", "A frame of carbon for a larger quad, 450 mm, with notes on heat.", ["frame"], ["STM32", "GPS"], ["450 mm"], ["test", "log"], [], ["bench"]),
    ("c", "Soup", "Onions, water and time.", [], [], [], [], [], []),
    ("d", "飞控 固件", "飞控固件的标定与验证 PX4", ["飞控"], ["PX4"], [], [], [], []),
]


def plain_score(q, d, corpus):
    norm = lambda t: "".join(c for c in t.lower() if c in "0123456789abcdefghijklmnopqrstuvwxyz" or "一" <= c <= "鿿")
    tf = {x[0]: Counter(norm(x[2])[i : i + n] for n in (2, 3, 4) for i in range(len(norm(x[2])) - n + 1)) for x in corpus}
    df = Counter(g for c in tf.values() for g in c)
    w = {k: {g: n * (math.log((1 + len(corpus)) / (1 + df[g])) + 1) for g, n in c.items()} for k, c in tf.items()}
    dot = sum(v * w[d[0]].get(g, 0) for g, v in w[q[0]].items())
    size = math.sqrt(sum(v * v for v in w[q[0]].values()) * sum(v * v for v in w[d[0]].values()))
    sets = lambda i: ({norm(x) for x in q[i]}, {norm(x) for x in d[i]})
    jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    scen = ({norm(x) for x in q[7] + q[8]}, {norm(x) for x in d[7] + d[8]})
    parts = [dot / size if size else 0, SequenceMatcher(None, norm(q[1]), norm(d[1])).ratio(), *(jac(*sets(i)) for i in (3, 4, 5, 6)), jac(*scen)]
    return round(sum(a * b for a, b in zip((0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05), parts, strict=True)), 6)


def test_scores_over_query_and_candidates(spark):
    index = spark.createDataFrame(ARTICLES, ARTICLE)
    new = ("n", "Quad frame", "A frame of carbon for a quad.", ["frame"], [], [], ["test"], ["indoor"], [])
    got = {(r["query"], r["document_id"]): r["final"] for r in S.score_articles(spark.createDataFrame([ARTICLES[0], new], ARTICLE), index).collect()}
    assert len(got) == 3 + 4
    for q in (ARTICLES[0], new):
        corpus = [q, *(x for x in ARTICLES if x[0] != q[0])]
        for d in corpus[1:]:
            assert abs(got[q[0], d[0]] - plain_score(q, d, corpus)) < 2e-6
    assert S.score_articles(spark.createDataFrame([("e", "t", "", *[[]] * 6)], ARTICLE), index).count() == 0


TERMS = ["frame", "quad", "STM32", "GPS", "test", "log", "indoor", "bench", "飞控", "250 mm"]


def some_articles(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(40)] + ["飞控", "固件", "the", "of"]
    pick = lambda k, of: [str(x) for x in rng.choice(of, rng.integers(0, k + 1), replace=False)]
    return [(f"d{i}", " ".join(pick(3, words)), " ".join(rng.choice(words, rng.integers(0, 25))), *[pick(3, TERMS) for _ in range(6)]) for i in range(n)]


def test_new_articles_equal_all_scores(spark, monkeypatch, tmp_path):
    rows = some_articles(60, 1) + [("e", "", None, *[[]] * 6), ("f", "x", "", *[[]] * 6)]
    changed = [(f"d{i}", *x[1:]) for i, x in enumerate(some_articles(12, 2))] + [(f"n{i}", *x[1:]) for i, x in enumerate(some_articles(12, 3))] + [("e", "Quad", "w1 w2 w3", *[["frame"]] * 6)]
    index, asked = spark.createDataFrame(rows, ARTICLE), spark.createDataFrame(changed, ARTICLE)
    every = S.score_articles(asked, index)
    corpus = {x[0]: x for x in rows if x[2] is not None}
    for r in every.filter("query in ('d1', 'n3', 'e')").collect():
        q = next(x for x in changed if x[0] == r["query"])
        others = [q, *((*x[:2], x[2] or "", *x[3:]) for x in rows if x[0] != q[0])]
        if r["document_id"] in corpus:
            assert abs(r["final"] - plain_score(q, corpus[r["document_id"]], others)) < 2e-6
    want = sorted(tuple(r) for r in S.ranked(every, "query", "document_id", "final", threshold=0.15).filter("selected").select("query", "document_id", "final", "rank").collect())
    assert len(want) > 30
    built = A.build(index, "document_id", "content")
    A.save(built, f"{tmp_path}/index")
    for kept, several, hot in ((None, G.QUERIES, G.HOT), (A.load(spark, f"{tmp_path}/index"), 4, 3), (A.build(index, "document_id", "content", most=0), 1000, 0)):
        monkeypatch.setattr(G, "QUERIES", several)
        monkeypatch.setattr(G, "HOT", hot)
        monkeypatch.setattr(G, "TEXTS", 7)
        got = sorted(tuple(r) for r in S.new_articles(asked, index, kept, 0.15).collect())
        assert [(q, d, r) for q, d, _, r in got] == [(q, d, r) for q, d, _, r in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))
    assert S.new_articles(asked.limit(0), index, built).count() == 0 and S.new_articles(asked, index.limit(0)).count() == 0


def test_ranks(spark):
    rows = spark.createDataFrame([("q", "b", 0.5), ("q", "a", 0.5), ("q", "c", 0.9), ("q", "d", 0.34999999), ("q", "e", 0.4), ("q", "f", 0.4), ("q", "g", 0.4)], "query string, id string, s double")
    got = [(r["id"], r["rank"], r["selected"]) for r in S.ranked(rows, "query", "id", "s").orderBy("rank").collect()]
    assert got == [("c", 1, True), ("a", 2, True), ("b", 3, True), ("e", 4, True), ("f", 5, True), ("g", 6, False), ("d", 7, False)]


def test_text_functions(spark):
    x = F.col("x")
    assert column(spark, T.normal(x), "Añb-飞 9!", "") == ["ab飞9", ""]
    assert column(spark, T.content_hash(x), "A b　C\n") == [hashlib.sha256(b"abc").hexdigest()]
    assert column(spark, T.meaningful_chars(x), "![a](b) 12 飞x", None) == [4, 0]
    assert column(spark, T.markdown_headings(x), "# One\ntext\n## Two  \n####### no\n# one") == [["One", "Two"]]
    assert column(spark, T.parameters(x), "用24 V 和 12V，3~5 kHz, x5mm, 40 V.") == [["12V", "3~5 kHz", "40 V"]]
    assert column(spark, T.technical_entities(x), "stm32F4 and GPS, ABC-12, usb") == [["stm32F4", "GPS", "ABC-12", "usb"]]
    assert column(spark, T.clean_body(x), "# h\n- a  b\n1. a b\n\n> c |\nA B") == ["a b\nc"]
    assert column(spark, T.evenly(F.split(x, ""), 3), "abcdefg") == [["a", "d", "g"]]
    assert column(spark, T.cuts(x, 3), "abcdefg", "", "abc") == [["abc", "def", "g"], [], ["abc"]]
    assert column(spark, T.column_letters(x.cast("int")), "1", "26", "27", "702", "703", "18278") == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ"]
    assert column(spark, T.moment_text(x), "45292.5", "1704067200", "1704067200000", "2024/01/01 00:00:00", "later", "") == ["2024/01/01 12:00:00", "2024/01/01 00:00:00", "2024/01/01 00:00:00", "2024/01/01 00:00:00", "later", ""]
    assert column(spark, T.node_token(x), "see https://h/wiki/Ab_1?x", "abcdefghij", "short") == ["Ab_1", "abcdefghij", ""]
    assert column(spark, T.without_fence(x), '```JSON\n{"a":1}\n```', "{}") == ['{"a":1}', "{}"]
    assert column(spark, T.grounding(x, F.lit("abcd")), "abxy", "a", "") == [1 / 3, None, None]


def test_message_parts():
    assert B.split_message("short", 10) == ["short"]
    parts = B.split_message("aa\n\nbb\n\n" + "飞" * 10, 8)
    assert [p.split("\n", 1)[1] for p in parts][:1] == ["aa\n\nbb"] and len(parts) == 1 + 5
    assert "".join(p.split("\n", 1)[1] for p in parts[1:]) == "飞" * 10


def test_folds(spark):
    rows = spark.createDataFrame([("d", i, b, h, float(x), 0.0, float(x) + 5, 5.0) for i, (b, h, x) in enumerate([(5, 0, 0), (9, 1, 3), (3, 255, 50), (2, 254, 6), (1, 2**40, 9)])], "doc string, id long, bytes long, hash long, x0 double, y0 double, x1 double, y1 double")
    assert V.within_budget(rows, "doc", "id", "bytes", [F.col("id")], 3, 10).first()["selected"] == [0, 2, 3]
    assert V.unlike(rows, "doc", "id", "hash", [F.col("id")], 2).first()["kept"] == [0, 2]
    groups = V.boxes_grouped(rows, "doc", [F.col("id")], 1.0).first()["groups"]
    assert [tuple(g) for g in groups] == [(-1.0, -1.0, 15.0, 6.0, 4)]


def test_journal(spark):
    rows = spark.createDataFrame([("k", "a", 1, "x"), ("k", "a", 2, "y"), ("k", "b", 3, "z")], "kind string, key string, seq long, payload string")
    assert {(r["key"], r["payload"], r["seq"]) for r in J.last_wins(rows, ["kind", "key"], "seq", "payload").collect()} == {("a", "y", 1), ("b", "z", 3)}
    assert {(r["key"], r["payload"], r["refused"]) for r in J.first_wins(rows, ["kind", "key"], "seq", "payload").collect()} == {("a", "x", 1), ("b", "z", 0)}
    new = spark.createDataFrame([("a", "y"), ("b", "other"), ("c", "n")], "key string, payload string")
    assert {r["key"]: r["action"] for r in J.append_plan(J.latest(rows, ["key"], "seq"), new, "key", "payload").collect()} == {"a": "noop", "b": "conflict", "c": "insert"}
    assert {r["key"]: r["payload"] for r in J.upsert(J.latest(rows, ["key"], "seq"), new.filter("key <> 'a'"), "key").collect()} == {"a": "y", "b": "other", "c": "n"}


def test_tables(spark):
    cells = spark.createDataFrame([("t", 0, 0, "a"), ("t", 2, 1, "x|y")], "k string, r int, c int, text string")
    assert B.grid(cells, "k").first()["grid"] == "| a |  |\n|  |  |\n|  | x\\|y |"
    assert [tuple(r)[1:] for r in B.markdown_cells(spark.createDataFrame([("t", "| a | b |\n| --- | --- |\n| 1 |")], "k string, x string"), "k", "x").orderBy("r", "c").collect()] == [(0, 0, "a"), (0, 1, "b"), (2, 0, "1")]


def test_bundles(spark, tmp_path):
    for name, mock in (("one", '{"behavior": "return", "response": "ok"}'), ("two", '{"raw_output": "x"}'), ("three", None)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "source_document.json").write_text(f'{{"case_id": "{name}",\n "title": "T", "review_round": 1}}')
        if mock:
            (tmp_path / name / "mock_llm_result.json").write_text(mock)
    (tmp_path / "three" / "mock_llm_result.json").write_text("{not json")
    assert [r[0] for r in bundles.cases(spark, str(tmp_path)).collect()] == ["one", "three", "two"]
    got = {r["case"]: (r["title"], r["review"], r["error"]) for r in bundles.bundles(spark, str(tmp_path)).collect()}
    assert got == {"one": ("T", "ok", "document_blocks.json"), "two": ("T", None, "document_blocks.json"), "three": ("T", None, "document_blocks.json")}


def test_sheet(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("a,b\n" + "x,\n" * 1200 + ",\n" + "y,1\n" + ",\n" * 50)
    rows = sheet.read_sheet(spark, str(path), 3)
    assert rows.count() == 1203 and rows.filter("row_no = 1203").first()["cells"] == ["y", "1", ""]


def test_outbox():
    state = "pending"
    for report in ["send", "lost", "send", "retry", "restart"]:
        state = outbox.after(state, report)
    assert state == "uncertain"
    assert outbox.after("sent", "retry") == "sent" and outbox.after("uncertain", "resolve_retry") == "pending"


def test_outbox_replay(spark):
    reports = ["send", "ok", "fail", "retry", "lost", "cancel", "restart", None]
    rows = [(None if i % 11 == 0 else f"k{i % 11}", (i * 7919) % 1009, reports[(i * i + i // 5) % len(reports)]) for i in range(1000)]
    want = {}
    for key, _, report in sorted(rows, key=lambda r: r[1]):
        want[key] = outbox.after(want.get(key, "pending"), report)
    default = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r) for r in outbox.replay(spark.createDataFrame(rows, "key string, seq int, report string").repartition(5)).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", default)
    assert len(got) == len(want) == 11 and dict(got) == want
    assert outbox.replay(spark.createDataFrame([], "key string, seq int, report string")).count() == 0


def test_first_events_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01"), ("b", "2024-01-01 00:00:02")]
    spark.createDataFrame(rows, "key string, at string").selectExpr("key", "cast(at as timestamp) as at").write.parquet(f"{tmp_path}/in")
    stream = outbox.first_events(spark.readStream.schema("key string, at timestamp").parquet(f"{tmp_path}/in"), "key", "at", "1 minute")
    q = stream.writeStream.format("memory").queryName("first_events").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["key"] for r in spark.sql("SELECT * FROM first_events").collect()) == ["a", "b"]


def test_short_candidates_contaminate(spark):
    from lectern.plans.text import contaminated

    texts = {1: "abcdefghijklmnopqrstuvwxyz0123456789", 2: "xyz", 3: "", 4: None, 5: "id42"}
    marks = {1: "abc", 2: "abcdefghijklmnopqrstuvwxyz01", 3: "z", 4: "", 5: None, 6: "id42", 7: "abcdefghijklmnopqrstuvwxzz"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, s string")
    b = spark.createDataFrame(list(marks.items()), "item_id long, c string")
    want = sorted((i, j) for i, t in texts.items() for j, m in marks.items() if t and m and m in t)
    assert len(want) == 5
    for few in (100, 0):
        assert sorted(map(tuple, contaminated(d, b, few).collect())) == want
        own = d.withColumn("source", F.when(F.col("doc_id") == 1, "xabcx"))
        assert sorted(map(tuple, contaminated(own, b, few).collect())) == [x for x in want if x != (1, 1)]


def test_lengths_without_corrections_of_hot_grams_are_bounded():
    rng = np.random.default_rng(8)
    n, words = 4000, 50
    counts = rng.integers(1, 4, (200, words)) * (rng.random((200, words)) < 0.6)
    df = rng.integers(n // 4, n // 2, words)
    plain = np.log((1.0 + n) / (1.0 + df)) + 1.0
    idf = np.log((1.0 + n) / (1.0 + df + (np.arange(words) % 2))) + 1.0
    asked = counts[:20]
    flat = [np.concatenate([f(q)[q > 0] for q in asked]) for f in (lambda q: np.arange(words), lambda q: q * idf**2, lambda q: idf**2 - plain**2)]
    cut = np.cumsum([(q > 0).sum() for q in asked])[:-1]
    lists = [pa.array([x.tolist() for x in np.split(f, cut)]) for f in flat]
    norm = np.sqrt(((asked * idf) ** 2).sum(axis=1))
    a = np.full(20, np.log(1.0 + n) + 1.0)
    block = A.Block(pa.table({"query": [f"q{i}" for i in range(20)], "codes": lists[0], "dots": lists[1], "more": lists[2], "a": a, "norm": norm}))
    grams = block.met([np.flatnonzero(c) for c in counts], [c[c > 0] for c in counts])
    logs = np.log(1.0 + df)
    s = np.stack([(counts**2).sum(axis=1), (counts**2 * logs).sum(axis=1), (counts**2 * logs**2).sum(axis=1)], axis=1)
    scores = []
    for kind in (np.float64, np.float32):
        block.prepare(kind)
        scores.append(block.cosine((s[:, :1], s[:, 1:2], s[:, 2:]), slice(None), *block.products([""] * 200, grams)))
    unsure = block.unsure()
    assert (np.abs(scores[1] - scores[0]) <= unsure * scores[0]).all() and 0 < unsure.max() < 0.01
    i, j = np.nonzero(scores[1] > 0)
    assert np.abs(block.exact_cosine(grams, s, i, j) - scores[0][i, j]).max() < 1e-12
    best = G.Best(20, 0.01, 3, unsure)
    sent = 0
    for first in range(0, 200, 10):
        i, j = best.pairs(scores[1][first : first + 10])
        sent += len(i)
        scores[0][i + first, j] = -scores[0][i + first, j]
    for q in range(20):
        assert (np.sort(scores[0][:, q])[:3] == -np.sort(np.abs(scores[0][:, q]))[::-1][:3]).all()
    # Twenty batches with three each, if every batch sent its own best.
    assert sent < 0.6 * 20 * 3 * 20
