"""Sharding by a k-d tree over document metadata, with leaves of nearly equal bytes.

Each level cuts every open node once, along the dimension in which the node is widest against all documents, at the
weighted median of its bytes (for an odd number of leaves, at the fraction that its left side gets). A cut is found by
histograms: all nodes of a level count bytes in at most BINS bins, the driver picks the bin of the cut, and the next
histogram is of that bin alone, until one value is left. What reaches the driver is bounded by nodes times BINS.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import checkpoint, read

BINS = 1024
#: A cut separates equal texts only where keeping them together would move a shard by more than this share of its bytes.
SLACK = 0.02
#: Rows that get their slots in one task, about.
CHUNK = 20_000


def default_dims(text: str) -> dict[str, Column]:
    """Three measures of a text; equal texts are at the same point."""
    t = F.coalesce(F.col(text), F.lit(""))
    return {"bytes": F.octet_length(t), "wide": F.octet_length(t) - F.length(t), "lines": F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))}


def by_node(of: Mapping[int, object], kind: str) -> Column:
    """The value that each node has in the mapping, null elsewhere: a place of one literal array, however many there are."""
    values = [of.get(i) for i in range(max(of, default=0) + 1)]
    return F.get(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), F.col("_node"))


def locate(rows: DataFrame, value: Column, ends: dict[int, list[int]], before: dict[int, int], target: dict[int, int]) -> tuple[dict[int, int], dict[int, int], dict[int, int]]:
    """For each node the value at which the running bytes reach its target, the bytes below it, and its own bytes."""
    at, below, own = {}, {}, {}
    ends, before = {n: list(x) for n, x in ends.items()}, dict(before)
    while ends:
        width = {n: -(-(hi - lo + 1) // BINS) for n, (lo, hi) in ends.items()}
        low, high = (by_node({n: x[i] for n, x in ends.items()}, "decimal(20,0)") for i in (0, 1))
        b = F.floor((value.cast("decimal(20,0)") - low) / by_node(width, "decimal(20,0)")).cast("long")
        found = rows.filter(value.between(low, high)).groupBy("_node", b.alias("b")).agg(F.sum("_size").alias("s")).collect()
        for n in list(ends):
            lo, hi = ends[n]
            run = before[n]
            for i, s in sorted((r["b"], r["s"]) for r in found if r["_node"] == n):
                at[n], below[n], own[n] = i, run, s
                if (run := run + s) >= target[n]:
                    break
            start = lo + at[n] * width[n]
            before[n] = below[n]
            ends[n] = [start, min(hi, start + width[n] - 1)]
            if ends[n][0] == ends[n][1]:
                at[n] = start
                del ends[n]
    return at, below, own


def cut(rows: DataFrame, open_: dict[int, int], dims: list[str], span: dict[str, int]) -> tuple[Column, dict[int, int]]:
    """Whether a row goes right in its node, and the leaves of the new nodes."""
    first = lambda r, d: (r[f"{d}_hi"] - r[f"{d}_lo"]) / max(1, span[d])
    ranges = [x for d in dims for x in (F.min(d).alias(f"{d}_lo"), F.max(d).alias(f"{d}_hi"))]
    stats = {r["_node"]: r for r in rows.filter(F.col("_node").isin(*open_)).groupBy("_node").agg(F.sum("_size").alias("s"), F.min("_crc").alias("crc_lo"), F.max("_crc").alias("crc_hi"), F.min("_id").alias("id_lo"), F.max("_id").alias("id_hi"), *ranges).collect()}
    dim = {n: max(dims, key=lambda d: (first(r, d), -dims.index(d))) for n, r in stats.items()}
    target = {n: r["s"] * (open_[n] // 2) // open_[n] for n, r in stats.items()}
    value = F.coalesce(*[F.when(by_node({n: True for n in dim if dim[n] == d}, "boolean"), F.col(d)) for d in dims]).cast("long")
    here = rows.filter(F.col("_node").isin(*stats) if stats else F.lit(False))
    at, below, _ = locate(here, value, {n: [r[f"{dim[n]}_lo"], r[f"{dim[n]}_hi"]] for n, r in stats.items()}, {n: 0 for n in stats}, target)
    here = here.filter(value == by_node(at, "long"))
    crc, below, own = locate(here, F.col("_crc"), {n: [r["crc_lo"], r["crc_hi"]] for n, r in stats.items()}, below, target)
    top = 2**63 - 1
    last = {n: (top if below[n] + own[n] - target[n] <= target[n] - below[n] else -top) for n in stats}
    split = [n for n in stats if min(below[n] + own[n] - target[n], target[n] - below[n]) > SLACK * stats[n]["s"] / open_[n]]
    if split:
        ids, below, own = locate(here.filter(F.col("_node").isin(*split) & (F.col("_crc") == by_node(crc, "long"))), F.col("_id"), {n: [stats[n]["id_lo"], stats[n]["id_hi"]] for n in split}, {n: below[n] for n in split}, {n: target[n] for n in split})
        last |= {n: ids[n] if below[n] + own[n] - target[n] <= target[n] - below[n] else ids[n] - 1 for n in split}
    v, c, i = by_node(at, "long"), by_node(crc, "long"), by_node(last, "long")
    right = (value > v) | ((value == v) & ((F.col("_crc") > c) | ((F.col("_crc") == c) & (F.col("_id") > i))))
    return right, {child: leaves for n, k in open_.items() for child, leaves in ((2 * n, k // 2), (2 * n + 1, k - k // 2))}


def shard_documents(docs: DataFrame, shards: int = 8, dims: Mapping[str, Column] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: key, size, text_crc32, law, shard, slot and grown_shard.

    size is the UTF-8 bytes of the text (null: none) plus 1. Shards are the leaves of the tree, from 0, of nearly equal
    bytes; at most SLACK of a shard's bytes or one row are on the wrong side of each cut. Ties in a dimension are cut by
    the checksum of the text, so that equal texts stay together unless there are too many, and then by key; rows of
    equal text and key stay together (keys should be unique). A null key counts as 0, a null in a dimension too, and a
    null text is empty; a text of any length is one row. Slots number the rows of a shard from 0 without gaps, in an order
    that follows from how the table is cut into partitions. A shard may be empty where there are few rows. No rows in, no
    rows out. Other columns of docs are neither read nor returned.
    """
    spark, t = docs.sparkSession, F.coalesce(F.col(text), F.lit(""))
    dims = {f"_d{i}": c for i, c in enumerate((dims or default_dims(text)).values())}
    meta = docs.select(F.col(key), (F.octet_length(t) + 1).cast("long").alias("_size"), F.crc32(t.cast("binary")).alias("_crc"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("_id"), F.lit(1).alias("_node"), F.monotonically_increasing_id().alias("_row"), *[F.coalesce(c.cast("long"), F.lit(0)).alias(d) for d, c in dims.items()])
    meta = checkpoint(meta)
    names = list(dims)
    whole = meta.agg(F.count("*").alias("n"), *[(F.max(d) - F.min(d)).alias(d) for d in names]).first()
    leaves = {1: shards}
    while whole["n"] and (open_ := {n: k for n, k in leaves.items() if k > 1}):
        right, new = cut(meta, open_, names, whole.asDict())
        meta = checkpoint(meta.withColumn("_node", F.when(F.col("_node").isin(*open_), 2 * F.col("_node") + F.coalesce(right.cast("int"), F.lit(0))).otherwise(F.col("_node"))))
        leaves = {n: k for n, k in leaves.items() if k == 1} | new
    depth = max(n.bit_length() for n in leaves)
    order = sorted(leaves, key=lambda n: n << (depth - n.bit_length()))
    chunks = max(1, -(-whole["n"] // CHUNK))
    rows = meta.withColumn("shard", by_node({n: i for i, n in enumerate(order)}, "int")).withColumn("_chunk", F.pmod(F.xxhash64("_id", "_crc", "_row"), F.lit(chunks)))
    counts = rows.groupBy("shard", "_chunk").agg(F.count("*").alias("n"))
    start = F.sum("n").over(Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "_chunk", F.coalesce(start, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy("_id", "_crc", "_row"))
    slots = rows.withColumn("_place", place).join(counts, ["shard", "_chunk"])
    return slots.select(key, F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("_start") + F.col("_place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents", "doc_id", "text"))
