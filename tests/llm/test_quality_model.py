"""The quality classifier on labels that it did not see, and odd rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import quality_model


def auc(score: np.ndarray, y: np.ndarray) -> float:
    rank = score.argsort().argsort() + 1
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.filter("crc32(cast(doc_id as string)) % 2 = 0").select("doc_id", "quality")
    rows = quality_model.classify(docs, seen).join(labels.filter("crc32(cast(doc_id as string)) % 2 = 1").select("doc_id", F.col("quality").alias("y")), "doc_id").toPandas()
    y = rows["y"].to_numpy()
    assert auc(rows["quality"].to_numpy(), y) > 0.97
    assert ((rows["quality"] >= 0.5) == (y == 1)).mean() > 0.95
    assert rows.loc[y == 1, "kept"].mean() > 0.98


def test_words_are_evidence(spark):
    """Good and bad texts of one shape, told apart by their words alone."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    text = lambda k: " ".join(words[i] for i in rng.integers(200 * k, 200 * k + 300, 60) % 400)
    rows = [(i, text(i % 2), "s", "en") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = {r["doc_id"]: r["evidence"] for r in quality_model.classify(docs, spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")).collect()}
    assert auc(np.array([out[i] for i in range(300, 600)]), np.array([i % 2 for i in range(300, 600)])) > 0.95
    noise = spark.createDataFrame([(i, int(x)) for i, x in enumerate(rng.integers(0, 2, 300))], "doc_id long, quality int")
    own = {r["doc_id"]: r["y"] for r in noise.withColumnRenamed("quality", "y").collect()}
    out = {r["doc_id"]: r["evidence"] for r in quality_model.classify(docs, noise).collect()}
    assert auc(np.array([out[i] for i in range(300)]), np.array([own[i] for i in range(300)])) < 0.65, "a label is no evidence of itself"


def test_against_plain_posteriors(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    y = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] is not None}
    out = {r["doc_id"]: r for r in quality_model.query(spark, sf).collect()}
    good = {i: float(y.get(i, out[i]["evidence"])) for i in docs}
    part = lambda i, k: (docs[i]["source"], docs[i]["lang"] or "")[:k]
    n, s = ({k: {} for k in (1, 2)} for _ in range(2))
    for i in docs:
        for k in (1, 2):
            n[k][part(i, k)] = n[k].get(part(i, k), 0) + 1
            s[k][part(i, k)] = s[k].get(part(i, k), 0.0) + good[i]
    total = len(docs)
    mean = sum(good.values()) / total

    def firm(rates, spread):
        between = (sum(n[k][g] * (s[k][g] / n[k][g] - r) ** 2 for (k, g), r in rates.items()) - spread * len(rates) / total) / total
        return quality_model.FIRM if between <= 0 else max(1e-6, spread / total / between - 1)

    f1 = firm({(1, g): mean for g in n[1]}, mean * (1 - mean) * total)
    host = lambda g, own, one: (s[1][g] - own + mean * f1) / (n[1][g] - one + f1)
    f2 = firm({(2, g): host(g[:1], 0, 0) for g in n[2]}, sum(n[2][g] * host(g[:1], 0, 0) * (1 - host(g[:1], 0, 0)) for g in n[2]))
    odds = lambda p: min(1 - 1e-6, max(1e-6, p)) / (1 - min(1 - 1e-6, max(1e-6, p)))
    for i, r in out.items():
        g = part(i, 2)
        assert np.isclose(r["host_rate"], host(g[:1], 0, 0)) and np.isclose(r["path_rate"], (s[2][g] + f2 * host(g[:1], 0, 0)) / (n[2][g] + f2))
        others = (s[2][g] - good[i] + f2 * host(g[:1], good[i], 1)) / (n[2][g] - 1 + f2)
        o = odds(r["evidence"]) * odds(others) / odds(mean)
        assert np.isclose(r["quality"], o / (1 + o)) and r["kept"] == (r["quality"] >= 0.5)


def test_sparse_sites_shrink(spark):
    good = " ".join(f"word{i}" for i in range(80)) + "."
    rows = [(i, good, "big", "en") for i in range(400)] + [(1000 + i, "junk " * 50, "bad", "en") for i in range(400)] + [(2000, good, "new", "en"), (2001, "junk " * 50, "new2", "de")]
    labels = [(i, 1) for i in range(200)] + [(1000 + i, 0) for i in range(200)] + [(5, None), (None, 1)]
    out = {r["doc_id"]: r for r in quality_model.classify(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(out) == len(rows)
    assert out[0]["kept"] and not out[1000]["kept"] and out[2000]["kept"] and not out[2001]["kept"]
    assert out[0]["host_rate"] > out[2000]["host_rate"] > 0.5 > out[2001]["host_rate"] > out[1000]["host_rate"]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, "x"), (2, "", "a", None, "y"), (2, "", "a", None, "y"), (None, "text " * 9, "a", "en", None), (4, "z " * 100_000, "b", "en", None)], "doc_id long, text string, source string, lang string, quality string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_model.classify(docs, none).collect()
    assert len(rows) == 5 and all(r["evidence"] == 0.5 for r in rows)
    assert quality_model.classify(docs.limit(0), none).count() == 0


def test_plans_hold_no_tables(spark, monkeypatch):
    """A table of words in a plan is held, written out and sent again by the driver at each step; here none has one."""
    sizes, write = [], quality_model.checkpoint

    def noted(df):
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df)

    monkeypatch.setattr(quality_model, "checkpoint", noted)
    out = quality_model.query(spark, "/root/testdata/sf0.001")
    assert out.count() and len(sizes) > 3 and max(sizes) < 50_000, sizes
