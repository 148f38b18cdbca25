from __future__ import annotations

import math

import numpy as np
import pytest

from lectern.llm import whitening
from lectern.llm.queries import queries

SCHEMA = "vec_id long, embedding array<float>, n string, w int"


def brute(vectors):
    """By vec_id: exact deviations, and the whole whitening, from plain numbers."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    c = np.array([[(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    values, axes = np.linalg.eigh(c.T @ c / n)
    return deviations, c, values[::-1], axes[:, ::-1]


def by_component(rows):
    out = {}
    for r in rows:
        out.setdefault(r["component"], {})[r["vec_id"]] = r
    return out


def test_equals_plain_numbers(spark):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(300, 12)) * np.linspace(0.05, 0.4, 12)).tolist()
    got = by_component(whitening.whiten(spark.createDataFrame([(i, x, "a", 1) for i, x in enumerate(v)], SCHEMA).repartition(5)).collect())
    deviations, c, values, axes = brute(v)
    assert sorted(got) == list(range(1, 9))
    for k in got:
        own = got[k]
        want = c @ axes[:, k - 1] / np.sqrt(values[k - 1])
        have = np.array([own[i]["whitened"] for i in range(300)])
        assert np.allclose(have * np.sign(have @ want), want, atol=1e-8)
        assert {r["n"] for r in own.values()} == {300} and [own[i]["deviation"] for i in range(300)] == deviations
        assert all(abs(r["explained"] / (values[k - 1] / values.sum()) - 1) < 1e-9 for r in own.values())
    w = np.array([[got[k][i]["whitened"] for k in range(1, 9)] for i in range(300)])
    w -= w.mean(axis=0)
    error = {r["identity_error"] for own in got.values() for r in own.values()}
    assert len(error) == 1 and error.pop() < 1e-9 and np.abs(w.T @ w / 300 - np.eye(8)).max() < 1e-9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    big = (1 << 60) + 1
    rows = [(big, [0.1, 0.2, 0.3]), (2, [0.4, -0.2, 0.1]), (2, [0.4, -0.2, 0.1]), (None, [0.0, 0.9, -0.3]), ((1 << 60) + 1, None), (4, []), (5, [nan, 0.0, 0.0]), (6, [inf, 0.0, 0.0]), (7, [None, 0.0, 0.0]), (8, [0.5, 0.5]), (9, [3e38, 0.0, 0.0])]
    got = whitening.whiten(spark.createDataFrame([(*r, "x", 2) for r in rows], SCHEMA)).collect()
    assert sorted((r["vec_id"] or -1, r["component"]) for r in got) == sorted((i, k) for i in (-1, big, 2, 2) for k in (1, 2, 3))
    deviations, *_ = brute([v for i, v in rows[:4]])
    assert {r["vec_id"]: r["deviation"] for r in got} == dict(zip([big, 2, 2, None], deviations, strict=True))
    assert {r["n"] for r in got} == {4}
    # three different points lie in a plane: the third component is empty
    assert all((r["whitened"] is None) == (r["component"] == 3) and (r["explained"] == 0) == (r["component"] == 3) and r["identity_error"] < 1e-9 for r in got)
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5], "x", 2)], SCHEMA)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0, 0.0), (2, 0, None, 0.0, 0.0)]
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_wide_entries_are_exact(spark):
    v = [[1e12, 0.5], [-1e12, 0.25], [3e11, -0.5]]
    got = whitening.whiten(spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    x = [[math.floor(1024 * c) + 100000 for c in row] for row in v]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((3 * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    assert all(r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 1 << 63 else None) for r in got)
    assert all(math.isfinite(r["whitened"]) for r in got if r["component"] == 1)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query(spark, sf):
    got = queries()["op11_whitening"](spark, f"/root/testdata/{sf}").collect()
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()}
    ids = sorted(vectors)
    deviations, c, values, axes = brute([vectors[i] for i in ids])
    assert len(got) == 8 * len(ids) and max(r["identity_error"] for r in got) < 1e-9
    want = dict(zip(ids, deviations, strict=True))
    assert all(r["deviation"] == want[r["vec_id"]] for r in got)
    for k, own in by_component(got).items():
        have, plain = np.array([own[i]["whitened"] for i in ids]), c @ axes[:, k - 1] / np.sqrt(values[k - 1])
        assert np.allclose(have * np.sign(have @ plain), plain, atol=1e-7)
