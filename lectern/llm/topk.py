"""Exact top-k inner products by distributed histogram selection.

Queries are taken in blocks of bounded size, each against all rows; what a block finds is written before the next. A pass scores everything and counts each query's
scores in BINS bins of its range; the summed histogram tells in which bin the kth score lies, and the next pass has only
that bin's range. Once few scores are at or above a bin, or bins are one score wide, a last pass returns the scores from
there on and ties go to the smaller id. A task sends, per query, bins that hold its own k best and no more than k rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import checkpoint, lean, new_path, read

BINS = 256
#: Queries that a pass over all rows takes: a task holds BLOCK * BINS counts of 4 bytes, and scores of BLOCK * ROWS.
BLOCK = 8192
ROWS = 256
SCALE = 256
#: Whole numbers up to the first are exact as floating-point sums, up to the second as sums of longs.
EXACT, LONG = 2.0**53, 2.0**62
#: The largest score, at which larger ones end, and what stands for no score.
MOST, LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min
U = np.uint64


def whole(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values.astype(np.float64))


def products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exactly, as long; each by what its own two vectors need.

    No sum of a pair's products, nor a part of it, is beyond the product of their largest entries and their length: that
    tells whether floating point or longs are exact, else these few pairs are multiplied without a limit.
    """
    with np.errstate(all="ignore"):
        bound = np.abs(q).max(axis=1, initial=0.0)[:, None] * np.abs(rows).max(axis=1, initial=0.0)[None, :] * max(q.shape[1], 1)
        bound = np.where(np.isnan(bound), np.inf, bound)
        s = np.where(bound < EXACT, q @ rows.T, 0.0).astype(np.int64)
    if (bound >= EXACT).any():
        longs = (bound >= EXACT) & (bound < LONG)
        a, b = longs.any(axis=1), longs.any(axis=0)
        if a.any():
            whole_of = lambda x: np.where(np.abs(x) < LONG, x, 0.0).astype(np.int64)
            s[np.ix_(a, b)] = np.where(longs[np.ix_(a, b)], whole_of(q[a]) @ whole_of(rows[b]).T, s[np.ix_(a, b)])
        for i, j in zip(*np.nonzero(bound >= LONG), strict=True):
            s[i, j] = max(-MOST, min(MOST, sum(int(x) * int(y) for x, y in zip(q[i], rows[j], strict=True))))
    return s


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and whole-number vectors of equal length, ROWS at most."""
    for batch in batches:
        ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        flat = whole(vectors.flatten().to_numpy(zero_copy_only=False))
        at = vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
        size = np.diff(at)
        for d in np.unique(size):
            of = np.flatnonzero(size == d)
            for part in np.array_split(of, -(-len(of) // ROWS)):
                yield ids[part], flat[at[part][:, None] + np.arange(d)]


class Block:
    """Queries of one block, by the length of their vectors."""

    def __init__(self, ids: list[int], vectors: list[list[float]], largest: float):
        self.ids = np.array(ids, dtype=np.int64)
        self.of = {}
        for d in {len(v) for v in vectors}:
            own = np.array([i for i, v in enumerate(vectors) if len(v) == d])
            self.of[d] = own, whole(np.array([vectors[i] for i in own], dtype=np.float64).reshape(len(own), d))
        #: No score of a query is beyond its reach; largest is the largest length of any vector.
        self.reach = np.zeros(len(ids), dtype=np.int64)
        for own, q in self.of.values():
            with np.errstate(all="ignore"):
                most = np.sqrt((q * q).sum(axis=1)) * largest * (1 + 1e-9)
            self.reach[own] = [MOST if not x < LONG else int(np.ceil(x)) + 1 for x in most]

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of queries, ids of rows and whole scores (LEAST: the query's own row)."""
        for ids, rows in chunks(batches):
            if rows.shape[1] in self.of:
                own, q = self.of[rows.shape[1]]
                s = products(q, rows)
                mine = self.ids[own]
                near = np.minimum(np.searchsorted(mine, ids), len(mine) - 1)
                same = np.flatnonzero(mine[near] == ids)
                s[near[same], same] = LEAST
                yield own, ids, s


def histogram(block: Block, low: np.ndarray, width: np.ndarray, k: int):
    """A function for mapInArrow: counts of scores by query and bin, from the top bin (BINS: above the range) down."""

    def count(batches):
        total = np.zeros((len(block.ids), BINS + 1), dtype=np.int32)
        for own, _, s in block.scores(batches):
            b = np.minimum((s.view(U) - low[own, None].view(U)) // width[own, None], U(BINS)).astype(np.int64)
            at, ok = (np.arange(len(own)) * (BINS + 1))[:, None] + b, (s >= low[own, None]) & (s != LEAST)
            total[own] += np.bincount(at[ok], minlength=len(own) * (BINS + 1)).reshape(len(own), BINS + 1)
        above = np.cumsum(total[:, ::-1], axis=1, dtype=np.int32)[:, ::-1] - total
        q, b = np.nonzero((total > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(total[q, b].astype(np.int64))], names=["q", "b", "n"])

    return count


def best(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to the smaller id."""
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    keep = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) < k
    return q[keep], ids[keep], s[keep]


def select(block: Block, least: np.ndarray, k: int):
    """A function for mapInArrow: rows at or above each query's least score, k a query at most."""

    def pick(batches):
        found = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for own, ids, s in block.scores(batches):
            q, r = np.nonzero((s >= least[own, None]) & (s != LEAST))
            found = best(*(np.r_[a, b] for a, b in zip(found, (own[q], ids[r], s[q, r]), strict=True)), k)
        q, ids, s = found
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(ids), pa.array(s)], names=["query_id", "vec_id", "score"])

    return pick


def thresholds(rows: DataFrame, block: Block, k: int) -> np.ndarray:
    """For each query a score at or above which there are at least k rows (or all), and not many more but for ties."""
    reach = block.reach
    low, width = -reach, (reach // (BINS // 2) + 1).astype(U)
    above = np.zeros(len(reach), dtype=np.int64)
    todo = np.ones(len(reach), dtype=bool)
    while todo.any():
        got = rows.mapInArrow(lean(histogram(block, low, width, k)), "q long, b long, n long").groupBy("q", "b").agg(F.sum("n").alias("n")).toArrow()
        count = np.zeros((len(reach), BINS + 1), dtype=np.int64)
        count[got["q"].to_numpy(), got["b"].to_numpy()] = got["n"].to_numpy()
        run = np.cumsum(count[:, ::-1], axis=1)[:, ::-1]
        enough = run >= k
        at = np.where(enough.any(axis=1), BINS - np.argmax(enough[:, ::-1], axis=1), 0)
        at = np.minimum(at, BINS - 1)
        above, total = run[np.arange(len(at)), at], run[:, 0]
        low = np.where(todo, (low.view(U) + at.astype(U) * width).view(np.int64), low)
        end = ~todo | (width == 1) | (above <= 4 * k) | (total < k)
        width = np.where(end, width, (width + U(BINS - 1)) // U(BINS))
        todo = ~end
    return low


def exact_topk(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """For each query its k rows of highest inner product: query_id, rank, vec_id and score.

    Components become floor(256 * x); scores are exact for all finite vectors, and one that no long can hold ends at the
    largest or least long but one. Rows with the query's own
    id are no candidates. Vectors null or with null or non-finite components, and null ids, take no part. Only vectors as long
    as the query's are compared; empty ones score 0. Of repeated rows each is a candidate; of a query that occurs more
    than once the least vector counts. No rows in, no rows out. Other columns are neither read nor returned.
    """
    vectors = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad)
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + (SCALE * F.abs(x) + 1) * (SCALE * F.abs(x) + 1))
    largest = float(np.sqrt(rows.agg(F.max(squares)).first()[0] or 0.0))
    queries = checkpoint(rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).sort("vec_id"))
    order, last, path = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"), None, None
    while True:
        got = (queries if last is None else queries.filter(F.col("vec_id") > last)).orderBy("vec_id").limit(block).collect()
        if not got and last is None:
            return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        if got:
            own = Block([r[0] for r in got], [r[1] for r in got], largest)
            found = rows.mapInArrow(lean(select(own, thresholds(rows, own, k), k)), "query_id long, vec_id long, score long")
            found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            if last is None and len(got) < block:
                return found
            path = path or new_path(rows.sparkSession)
            found.write.mode("append").parquet(path)
            last = got[-1][0]
        if len(got) < block:
            return rows.sparkSession.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
