"""Every query that SQL expresses, against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from lectern import catalog
from lectern.plans.tables import TABLES

SF = "/root/testdata/sf0.001"


def cell(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in names) for r in df.collect())
    cursor = duck.execute(catalog.ORACLES[name])
    place = [[d[0] for d in cursor.description].index(c) for c in names]
    want = sorted(tuple(cell(r[i]) for i in place) for r in cursor.fetchall())
    assert len(cursor.description) == len(names) and got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
