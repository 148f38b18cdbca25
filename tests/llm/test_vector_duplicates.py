from __future__ import annotations

import numpy as np
import pytest

from lectern.llm import vector_duplicates
from lectern.llm.vector_duplicates import collision, shape

SCHEMA = "vec_id long, embedding array<double>, n string, fp int, node int"


def brute(rows, least=0.9):
    """Rows (id, vector) as (id, n_links, component_id, kept), by all pairs."""
    ok = [i for i, (key, v) in enumerate(rows) if key is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near, label = [[] for _ in rows], list(range(len(rows)))
    for d in {len(rows[x][1]) for x in ok}:
        own = np.array([x for x in ok if len(rows[x][1]) == d])
        v = np.array([np.array(rows[x][1]) / np.abs(rows[x][1]).max() for x in own])
        v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
        for x, cosines in zip(own, v @ v.T, strict=True):
            near[x] = [y for y in own[cosines >= least].tolist() if y != x]
    todo = True
    while todo:
        todo = False
        for x, links in enumerate(near):
            low = min([label[x], *(label[y] for y in links)])
            todo, label[x] = todo or low < label[x], low
    ids = {g: min(rows[x][0] for x in range(len(rows)) if label[x] == g) if rows[g][0] is not None else None for g in set(label)}
    return sorted(((key, len(near[x]), ids[label[x]], key is None or key == ids[label[x]]) for x, (key, _) in enumerate(rows)), key=str)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA).repartition(parts)


def found(spark, rows, parts=3):
    got = vector_duplicates.vector_duplicates(frame(spark, rows, parts))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def turned(rng, v, cosine):
    """A vector at the cosine to v."""
    w = rng.normal(size=len(v))
    w -= (w @ v) * v / (v @ v)
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def test_laws():
    assert collision(0.1) > collision(0.5) > collision(1.4) > 0
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=200_000), rng.uniform(0, 2, 200_000)
    assert abs(np.mean(np.floor(b / 2) == np.floor((0.7 * a + b) / 2)) - collision(0.7)) < 0.005
    for n in (10, 10_000, 10**9):
        k, tables = shape(n)
        assert 1 - (1 - collision(np.sqrt(0.2)) ** k) ** tables >= 0.995 and n * collision(np.sqrt(2)) ** k <= 256 + n * (n < 256)


def test_groups_copies_and_chains(spark):
    rng = np.random.default_rng(11)
    rows, base = [], rng.normal(size=16)
    rows += [(100 + i, (base + 0.04 * rng.normal(size=16)).tolist()) for i in range(700)]  # near copies, beyond a block
    rows += [(5000 + i, [1.0, 2.0, 0.0, -1.0]) for i in range(300)] + [(4000, [2.0, 4.0, 0.0, -2.0])]  # copies, and one as long again
    step = [np.array([np.cos(t), np.sin(t), 0.0, 0.0, 0.0]) for t in 0.4 * np.arange(7)]  # a chain, neighbours linked only
    rows += [(9000 - i, (s * 10.0**i).tolist()) for i, s in enumerate(step)]
    rows += [(20_000 + i, rng.normal(size=16).tolist()) for i in range(200)]
    assert found(spark, rows, 7) == brute(rows)


@pytest.mark.parametrize("size", [20, 39, 40, 41, 80])
def test_parts_of_a_bucket_meet(spark, size, monkeypatch):
    monkeypatch.setattr(vector_duplicates, "BLOCK", 20)
    monkeypatch.setattr(vector_duplicates, "ROWS", 16)
    rng = np.random.default_rng(size)
    base = rng.normal(size=8)
    rows = [(i, (base + 0.05 * rng.normal(size=8)).tolist()) for i in range(size)] + [(500 + i, rng.normal(size=8).tolist()) for i in range(30)]
    assert found(spark, rows) == brute(rows)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(17)
    rows = []
    for i in range(1500):
        v = rng.normal(size=24)
        rows += [(2 * i, v.tolist()), (2 * i + 1, turned(rng, v, 0.9 + 1e-9 + 0.02 * (i % 2)).tolist())]
    rows += [(10_000 + i, turned(rng, np.array(rows[2 * i][1]), 0.8999).tolist()) for i in range(100)]
    got, want = found(spark, rows), brute(rows)
    have, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert have <= all_links and have >= 0.985 * all_links
    exact = {r[0]: r for r in want}
    assert all(r[1] <= exact[r[0]][1] and r[2] >= exact[r[0]][2] for r in got)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (None, [1.0, 1.0])]
    rows += [(7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1e200, 1e200]), (9, [1e-200, 1.1e-200]), (10, [1.0, 1.0, 0.0]), (11, [-1.0, -1.0]), (12, [0.0, 1.0]), (12, [0.0, -1.0]), (13, [-0.0, -3.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == [(1, 0, 1, True)]


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query(spark, sf):
    from lectern.llm.queries import queries

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    got = queries()["op12_vector_duplicates"](spark, f"/root/testdata/{sf}")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
