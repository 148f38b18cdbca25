"""Queries against DuckDB on tables made for a case that the small tables lack."""

from __future__ import annotations

import time
import weakref

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern import catalog
from lectern.functions import text as T
from lectern.operators import grams as G
from lectern.operators import trees


def written(folder, **tables: dict) -> str:
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), folder / f"{name}.parquet")
    return str(folder)


def same(spark, sf: str, name: str, *tables: str) -> list[tuple]:
    """The rows of a query, which are those of its SQL."""
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf)
    cursor = db.execute(catalog.ORACLES[name])
    place = [[d[0] for d in cursor.description].index(c) for c in df.columns]
    got, want = sorted(map(tuple, df.collect()), key=repr), sorted((tuple(r[i] for i in place) for r in cursor.fetchall()), key=repr)
    assert got == want
    return got


def test_samples_keep_digits_at_the_ends_of_lines(spark, tmp_path):
    texts = ["0 first 0\n1 second 1\n  2 third 2  ", "0", "1\n1\n1", "  \n a ", None]
    sf = written(tmp_path, documents={"doc_id": list(range(5)), "text": texts})
    same(spark, sf, "evenly_sampled_segments", "documents")
    rows = spark.createDataFrame([("0 a. b 0\n 1 c 1 ",)], "t string").select(T.segments(F.col("t")))
    assert rows.first()[0] == ["0 a. b 0", "1 c 1"]


def test_trees_of_over_a_million_nodes(spark, tmp_path):
    n = 1_010_000
    sf = written(tmp_path, part={"p_partkey": pa.array(range(1, n + 1), pa.int64())})
    found = catalog.QUERIES["block_tree_flatten"](spark, sf)
    assert found.agg(F.count("*"), F.countDistinct("id"), F.max("pos") > 300_000).first()[:] == (n, n, True)


def test_numbers_of_repeated_nodes(spark, tmp_path):
    sf = written(tmp_path, part={"p_partkey": pa.array([1, 1, 2, 4, 5, 16, 64, 257, 1030, 1031, 4121, 90, None], pa.int64())})
    same(spark, sf, "block_tree_flatten", "part")
    same(spark, sf, "block_tree_unreachable", "part")


def test_messages_of_items_of_one_place(spark, tmp_path):
    n = 6
    items = {"l_orderkey": [3] * n, "l_partkey": [7, 9, 7, 7, 8, 7], "l_suppkey": [50, 1, 40, 30, 6, 20], "l_linenumber": pa.array([1] * n, pa.int32()), "l_quantity": [1.0, 2.0, 3.0, 5.0, 6.0, 1.0], "l_returnflag": ["A"] * n, "l_linestatus": ["O"] * n}
    orders = {"o_orderkey": [3, 4], "o_custkey": [1, 2], "o_orderstatus": ["F", "O"], "o_orderpriority": ["1", "2"]}
    same(spark, written(tmp_path, lineitem=items, orders=orders), "online_messages", "lineitem", "orders")


def test_unique_of_many_values_takes_no_square(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(60_000))
    sf = written(tmp_path, documents={"doc_id": [1, 2], "text": [f"a  A b\nB a {words}", "x"]})
    start = time.perf_counter()
    rows = dict(map(tuple, catalog.QUERIES["stable_unique_cap"](spark, sf).collect()))
    assert rows == {1: " ".join(["a", "b", *[f"w{i}" for i in range(38)]]), 2: "x"} and time.perf_counter() - start < 10
    same(spark, sf, "stable_unique_cap", "documents")


@pytest.mark.parametrize("name", ["reliable_text_filter", "valid_text_filter"])
def test_characters_are_counted_once(spark, tmp_path, name):
    texts = ["a" * 20, "-" * 30 + "b" * 19, "![x](y)" + "c" * 21, "", None, "中" * 20 + "[图片说明：zz]", "; a ;" * 20]
    sf = written(tmp_path, documents={"doc_id": list(range(7)), "text": texts})
    same(spark, sf, name, "documents")
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2


def test_norms_hold_the_grams_of_one_text(monkeypatch):
    made = []
    monkeypatch.setattr(G, "coded", lambda text: made.append(weakref.ref(c := np.arange(3))) or (c, np.ones(3)))
    held = []

    def measured(text):
        found = G.coded(text)[0]
        held.append(sum(r() is not None for r in made))
        return (len(found),)

    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["abc"] * 50)], names=["k", "s"])
    assert next(G.by_text(measured, pa.int64(), ["k", "n"])(iter([batch]))).column(1).to_pylist() == [3] * 50
    assert max(held) <= 2


def test_manifests_are_summed_in_one_pass(spark, tmp_path):
    rows = [(1, 1, 5.0, 50, 3), (1, 1, 2.0, 7, 20), (1, 2, 5.0, 7, 40), (1, 3, 5.0, 7, 3), (1, 3, 1.0, 8, 3), (2, 1, None, 50, 1), (None, 1, 4.0, 7, 1), (3, None, 4.0, 7, 1), (4, 1, 4.0, None, 1), (5, 1, 4.0, 7, None), (6, 1, 4.0, 100, 1)]
    names = ["l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey"]
    sf = written(tmp_path, lineitem=dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
    same(spark, sf, "manifest_integrity", "lineitem")
    assert "Join" not in catalog.QUERIES["manifest_integrity"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_tables_of_trees_do_not_pass_through_the_driver(spark):
    docs = spark.createDataFrame([("d", '[{"block_id":"d","block_type":1,"children":["a"]},{"block_id":"a","block_type":2,"text":{"elements":[{"text_run":{"content":"x"}}]}}]')], "doc string, blocks string")
    found = trees.flattened(docs, "doc", "blocks")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("d", 0, "paragraph", None, "x", None)]
