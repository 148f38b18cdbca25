"""Grams as numbers against grams as strings, and blocks of queries against the join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import article_index as A
from lectern.operators import grams as G
from lectern.operators import similarity as S

TEXTS = {1: "abcabc 飞控固件 0z9", 2: "", 3: None, 4: "a", 5: "zz", 6: "abcabc 飞控固件 0z9", 7: "abca", 8: "The frame, the frame!", 9: "frame 飞控", 10: "一鿿一鿿a0"}


def articles(spark, texts=None):
    return spark.createDataFrame(list((TEXTS if texts is None else texts).items()), "id long, text string").repartition(3)


def test_numbers_stand_for_grams(spark):
    d = articles(spark)
    want = sorted(map(tuple, S.document_frequency(S.term_counts(d, "id", "text")).collect()))
    assert sorted(map(tuple, G.gram_frequencies(d, "text").collect())) == want
    counts = S.term_counts(d, "id", "text").groupBy("id").agg(F.count("*"), F.sum("c"), F.max("c"))
    assert sorted(map(tuple, G.measures(d, "id", "text").collect())) == sorted(map(tuple, counts.collect()))
    for text in ("", "q", "az09", "一鿿飞a"):
        codes, n = G.coded(text)
        assert sorted(np.repeat(G.spelled(codes), n).tolist()) == sorted(text[i : i + k] for k in (2, 3, 4) for i in range(len(text) - k + 1))


def test_long_texts_are_whole(spark):
    text = "ab" * 300_000 + "飞"
    d = articles(spark, {1: text, 2: "b飞"})
    assert [tuple(r) for r in G.measures(d.filter("id = 1"), "id", "text").collect()] == [(1, 9, 3 * len(text) - 6, 300_000)]
    assert [(r["query"], r["id"]) for r in G.cosines(d, "id", "text", F.col("id") == 2).collect()] == [(2, 1)]


def test_blocks_equal_the_join(spark, monkeypatch):
    d = articles(spark)
    is_query = F.col("id") % 2 == 1
    rows = lambda df: {(r["query"], r["id"]): r["text_score"] for r in df.select("query", "id", "text_score").collect()}
    want = rows(S.cosines(S.tfidf(S.term_counts(d, "id", "text"), d.count()), "id", is_query))
    indexed = rows(S.article_cosines(d, "id", "text", is_query, most=3))
    assert indexed.keys() == want.keys() and all(abs(indexed[k] - want[k]) < 1e-9 for k in want)
    assert want and G.cosines(d, "id", "text", is_query, most=3) is None
    for postings, hot in ((G.POSTINGS, G.HOT), (8, G.HOT), (G.POSTINGS, 0), (G.POSTINGS, 2)):
        monkeypatch.setattr(G, "HOT", hot)
        got = rows(G.cosines(d, "id", "text", is_query, postings=postings))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_texts_are_coded_once_for_all_blocks(spark, tmp_path):
    articles(spark).write.parquet(str(tmp_path / "articles"))
    d, is_query = spark.read.parquet(str(tmp_path / "articles")), F.col("id") % 2 == 1
    for found in (G.cosines(d, "id", "text", is_query, postings=8), G.cosines(d, "id", "text", is_query, 0.1, 2, postings=8), G.tallies(d, "id", "text", is_query, 0.1, postings=8)):
        assert found.count() > 0 and not [f for f in found.inputFiles() if str(tmp_path) in f]


def test_best_scores_keep_ties(spark, monkeypatch):
    monkeypatch.setattr(G, "TEXTS", 4)
    d = articles(spark, {i: "the same text" if i % 3 else f"other words {i}" for i in range(40)})
    pairs = lambda *a: S.ranked(G.cosines(d, "id", "text", F.col("id") % 20 == 1, *a).withColumn("score", F.round("text_score", 6)), "query", "id", "score").filter("selected")
    want = sorted(map(tuple, pairs().select("query", "id", "rank").collect()))
    assert want == sorted(map(tuple, pairs(S.THRESHOLD, S.TOP).select("query", "id", "rank").collect()))
    assert [w[1] for w in want if w[0] == 1] == [2, 4, 5, 7, 8]


def test_nothing_to_score(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert G.cosines(empty, "id", "text", F.col("id") > 0).count() == 0 and G.gram_frequencies(empty, "text").count() == 0
    assert G.cosines(articles(spark), "id", "text", F.col("id").isin(2, 3, 4)).count() == 0
    twice = articles(spark, {1: "abc", 2: "abd"}).withColumn("query", F.lit("x"))
    assert sorted((r["query"], r["id"]) for r in G.cosines(twice.union(twice), "id", "text", F.col("id") == 1).collect()) == [(1, 2)] * 4


def test_normal_forms_by_code_point(spark):
    points = [chr(i) for i in range(1, 0x11000) if not 0xD800 <= i < 0xE000] + ["A\U0001f600b"]
    d = spark.createDataFrame([(i, c) for i, c in enumerate(points)], "id long, text string")
    want = [r[0] for r in d.select(F.concat(F.lit("0"), T.normal(F.col("text")))).collect()]
    got = [G.DIGITS[np.minimum(np.frombuffer(c.encode("utf-32-le"), np.uint32), 0xFFFF)] for c in points]
    assert [G.DIGITS[[ord(x) for x in w[1:]]].tolist() for w in want] == [g[g > 0].tolist() for g in got]
    assert "regexp" not in G.texts(d, "id", "text")._jdf.queryExecution().toString()
    broken = d.limit(1).select("id", F.expr("cast(x'61ff4262' as string)").alias("text"))
    assert [tuple(r) for r in G.measures(broken, "id", "text").collect()] == [(0, 3, 3, 1)]


def test_counts_are_made_where_pairs_are_scored(spark, monkeypatch):
    d, is_query = articles(spark), F.col("id") % 2 == 1
    pairs = G.cosines(d, "id", "text", is_query).collect()
    line = round(sorted(r["text_score"] for r in pairs)[len(pairs) // 2], 6)
    want = {q: (sum(r["query"] == q for r in pairs), sum(r["query"] == q and round(r["text_score"], 6) >= line for r in pairs)) for q in {r["query"] for r in pairs}}
    for postings, hot in ((G.POSTINGS, G.HOT), (8, G.HOT), (G.POSTINGS, 0), (G.POSTINGS, 2)):
        monkeypatch.setattr(G, "HOT", hot)
        got = G.tallies(d, "id", "text", is_query, line, postings=postings)
        assert {r["query"]: (r["scored"], r["over"]) for r in got.collect()} == want
    assert G.tallies(d, "id", "text", is_query, line, most=3) is None
    assert G.tallies(d.limit(0), "id", "text", is_query, line).count() == 0


def test_searches_in_single_precision_are_exact():
    rng = np.random.default_rng(5)
    grams = []
    for _ in range(120):
        at = np.sort(rng.choice(60, 25, replace=False))
        w = rng.random(25) ** 4
        grams.append((at, w / np.sqrt(w @ w)))
    grams[7] = grams[3]
    asked = range(0, 120, 3)
    block = G.Block(60, np.concatenate([grams[i][0] for i in asked]), np.repeat(np.arange(40, dtype=np.int32), 25), np.concatenate([grams[i][1] for i in asked]), list(asked))
    whole = np.zeros((120, 60))
    for i, (at, w) in enumerate(grams):
        whole[i, at] = w
    want = whole @ whole[list(asked)].T
    want[list(asked), range(40)] = 0
    block.prepare(np.float32)
    best, found, sent = G.Best(40, 0.2, 5, block.unsure()), {}, 0
    for first in range(0, 120, 10):
        part = grams[first : first + 10]
        i, j = best.pairs(block.products(list(range(first, first + 10)), part)[0])
        exact = block.exact(part, i, j)[0]
        found |= {(a, b): x for a, b, x in zip((i + first).tolist(), j.tolist(), exact.tolist(), strict=True)}
        sent += len(i)
    assert all(abs(want[k] - x) < 1e-12 for k, x in found.items())
    for j in range(40):
        top = [i for i in np.argsort(-want[:, j], kind="stable")[:5] if want[i, j] >= 0.2]
        assert all((i, j) in found for i in top)
    # Batches after the first send only what is better than the best before; ten batches on their own would send 5 of 10.
    assert sent < 0.75 * 40 * 5 * 12


def test_queries_of_an_index_make_no_row_a_gram(spark):
    d = articles(spark)
    index = A.build(d.filter("id <> 5"), "id", "text")
    changed = d.filter("id % 2 = 1").withColumn("text", F.concat("text", F.lit(" and more")))
    for own in (True, False):
        found = A.asked(index, changed, "text", own)
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
        got, want = ({r["query"]: r for r in x.collect()} for x in (found, A.asked(index, changed, "text", own, most=0)))
        assert got.keys() == want.keys() and len(got) > 2
        for q, r in got.items():
            assert r["codes"] == want[q]["codes"]
            assert all(np.allclose(r[c], want[q][c], rtol=1e-12, atol=1e-14) for c in ("dots", "more", "squares", "a", "norm"))


def test_lengths_are_corrected_where_it_matters():
    more, square = np.array([0.9, 1e-4, 0.0, 0.5]), np.array([9.0, 4.0, 4.0, 5.0])
    block = G.Block(2, np.array([0, 1, 0, 1]), np.array([0, 0, 1, 1], np.int32), np.ones(4), ["a", "b"], more, square)
    block.prepare(np.float32)
    assert block.unsure().max() < 1e-4
    dot, length = block.products(["c"], [(np.array([0, 1], np.int32), np.array([1.0, 2.0]))])
    assert dot.tolist() == [[3.0, 3.0]] and length.tolist() == [[0.9, 2.0]]
