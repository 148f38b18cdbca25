"""Near duplicates of embeddings by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted at random and cut into buckets of WIDTH; as many
projections as it takes for a bucket to hold no more than CHANCE unrelated vectors make a table, and there are as many
tables as find a pair at the threshold with the probability RECALL. Both follow from the number of vectors by the
collision probability of the 2-stable law, so the method behaves alike at every size.

Equal vectors are one, with a weight. The members of a bucket are compared in blocks of BLOCK by BLOCK: a larger bucket
is dealt into parts, and each two parts meet in a block of their own. A block returns numbers, not pairs: each vector's
links that no earlier table has shown, and one edge a vector that joins it to what it is connected to in the block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_duplicates import components
from .shared import attach_groups, bound_batches, checkpoint, lean, read

SIMILARITY = 0.9
#: Width of the buckets of a projection, in standard deviations of the directions' entries.
WIDTH = 2.0
#: Unrelated vectors, at right angles, that a bucket holds by chance at most, on average.
CHANCE = 256
#: Probability with which a pair at the threshold shares a bucket of at least one table; closer pairs have more.
RECALL = 0.995
#: Vectors of a part of a bucket, on average: what a task compares at a time is two parts.
BLOCK = 256
#: Vectors that are projected at a time.
ROWS = 512
SEED = 20_240_817

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits are as good as random."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that two points at the distance fall in one bucket of a projection."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def shape(n: int, least: float = SIMILARITY) -> tuple[int, int]:
    """Projections of a table and tables for n vectors."""
    k = max(1, math.ceil(math.log(max(n, 1) / CHANCE) / -math.log(collision(math.sqrt(2.0)))))
    hit = collision(math.sqrt(2 - 2 * least)) ** k
    return k, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - hit))) if hit < 1 else 1


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1, also where squares of their entries are no finite numbers or vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def by_length(vectors: pa.ListArray, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows of the vectors of each length that can be compared, all together or so many at a time."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = vectors.value_lengths().fill_null(0).to_numpy()
    at = np.cumsum(size) - size
    for d in np.unique(size[size > 0]):
        own = np.flatnonzero(size == d)
        for part in np.array_split(own, -(-len(own) // most) if most else 1):
            rows = flat[at[part][:, None] + np.arange(d)] + 0.0
            ok = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
            if ok.any():
                yield part[ok], rows[ok]


def sketch(k: int, tables: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows id, v become id, fp (null: takes no part), keys (the bucket in each table) and v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            fp, keys = np.full(len(batch), None, dtype=object), np.zeros((len(batch), tables), dtype=U)
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for place, rows in by_length(batch.column(1), ROWS):
                d = rows.shape[1]
                if d not in planes:
                    rng = np.random.default_rng([SEED, d])
                    planes[d] = rng.normal(size=(d, tables * k)), rng.uniform(0, WIDTH, tables * k)
                a, b = planes[d]
                q = np.floor((unit(rows) @ a + b) / WIDTH).astype(np.int64).view(U).reshape(len(rows), tables, k)
                own = mixed(np.arange(tables, dtype=U) * U(0x9E3779B97F4A7C15) + U(d))[None, :].repeat(len(rows), axis=0)
                for i in range(k):
                    own = mixed(own ^ (q[:, :, i] * U(0xD6E8FEB86659FD93) + U(i)))
                keys[place] = own
                fp[place] = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in rows]
            fp[~named] = None
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.tolist(), pa.binary()), lists, batch.column(1)], names=["id", "fp", "keys", "v"])

    return run


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least one that it is connected to by links a, b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def compared(node: np.ndarray, weight: np.ndarray, part: np.ndarray, table: int, keys: np.ndarray, rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: nodes that have links, how many of these earlier tables have not, and the node each is joined to."""
    u = unit(rows)
    left, right = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
    a, b = np.nonzero(u[left] @ u[right].T >= least)
    a, b = left[a], right[b]
    if len(left) == len(node):
        a, b = a[a < b], b[a < b]
    new = ~(keys[a, :table] == keys[b, :table]).any(axis=1)
    links = np.bincount(a[new], weight[b[new]], len(node)) + np.bincount(b[new], weight[a[new]], len(node))
    on = np.unique(np.concatenate([a, b]))
    return node[on], links[on].astype(np.int64), node[connected(len(node), a, b)[on]]


def blocks(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows bucket, low, high, part, table, node, n, keys, v, sorted by block, become node, links and other."""

    def of(t: pa.Table, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        s = t.slice(start, end - start).combine_chunks()
        part, table, node, weight = (s.column(c).to_numpy() for c in ("part", "table", "node", "n"))
        if part.min() == part.max() and s["low"][0].as_py() != s["high"][0].as_py():
            return
        lists = s.column("keys").combine_chunks()
        keys = lists.flatten().to_numpy().reshape(len(node), -1)
        v = s.column("v").combine_chunks()
        for place, rows in by_length(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v):
            if len(place) > 1:
                yield compared(node[place], weight[place], part[place], int(table[0]), keys[place], rows, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def done(t: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
            got = [x for i, j in zip(edges[:-1], edges[1:], strict=True) if j - i > 1 for x in of(t, i, j)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got, strict=True)], names=["node", "links", "other"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if not len(t):
                continue
            key = [t.column(c).to_numpy() for c in ("bucket", "low", "high")]
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in key])) + 1
            yield from done(t, np.r_[0, new])
            rest = t.slice(new[-1] if len(new) else 0)
        if rest is not None and len(rest):
            yield from done(rest, np.array([0, len(rest)]))

    return run


def links(own: DataFrame, least: float) -> DataFrame:
    """node, links and other of all blocks; own: node, n, keys, v."""
    each = own.select("node", "n", "keys", "v", F.posexplode("keys").alias("table", "bucket"))
    large = checkpoint(each.groupBy("bucket").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK))
    each = attach_groups(each, large, "bucket", "m").withColumn("parts", F.coalesce(F.ceil(F.col("m") / BLOCK), F.lit(1)))
    each = each.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    key = ["bucket", "low", "high"]
    dealt = each.select("bucket", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part", "table", "node", "n", "keys", "v").repartition(*key).sortWithinPartitions(*key)
    return checkpoint(dealt.mapInArrow(lean(blocks(least)), "node long, links long, other long"))


def vector_duplicates(vectors: DataFrame, least: float = SIMILARITY, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row a vector: key, n_links (other rows whose cosine with it is at least the threshold), component_id (the
    least key that links reach from it, its own included) and kept (whether this is its own).

    All found pairs are checked by their cosine in double precision, so there are no wrong links; a pair at the
    threshold is missed with the probability 1 - RECALL, a closer one with less, and equal vectors never. Vectors that
    are null, empty or zero, or hold null or non-finite entries, link with nothing, as do rows with a null key, which
    have a null component_id and are kept. Only vectors of the same length are compared. Repeated rows link with each
    other as rows of their own, under one key. Keys are whole numbers. No rows in, no rows out. Other columns are
    neither read nor returned.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    kind = "array<float>" if dict(vectors.dtypes)[column] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast(kind).alias("v"))
    k, tables = shape(rows.count(), least)
    sketches = checkpoint(rows.mapInArrow(lean(sketch(k, tables)), f"id long, fp binary, keys array<long>, v {kind}").withColumn("node", F.monotonically_increasing_id()))
    known = sketches.select("id", "fp")
    groups = checkpoint(sketches.filter("fp is not null").groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.min("node").alias("node")))
    own = checkpoint(sketches.join(groups.select("node", "n"), "node").select("node", "n", "keys", "v"))
    found = links(own, least)
    label = components(found.filter("other <> node").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct())
    nodes = groups.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    nodes = checkpoint(nodes.join(label.select(F.col("id").alias("node"), "label"), "node", "left").withColumn("label", F.coalesce("label", "node")))
    least_of = checkpoint(nodes.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("size")).filter("size > 1"))
    nodes = attach_groups(nodes, least_of, "label", "size").select("fp", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = attach_groups(known, checkpoint(nodes), "fp", "n")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.9),
r AS (SELECT vec_id, vec_id AS to_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.to_id),
c AS (SELECT vec_id, min(to_id) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""
