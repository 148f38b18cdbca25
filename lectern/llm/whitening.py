"""Whitening of embeddings by the eigenvectors of their covariance.

Entries become whole numbers, so that sums and centred rows are exact: a row's n * x - S is a difference of whole
numbers, S being the sums of the fit list, and only its quotient by n is rounded. The Gramian of these rows, divided by
n, is the covariance, which has as many entries as a vector has pairs of dimensions and is all that the driver gets.
Its leading eigenvectors over the roots of their eigenvalues go to all tasks, which project the centred rows. What
comes out is measured: the covariance of the projections is made the same way and compared with the identity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound_batches, checkpoint, read

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries whose whole number is beyond this are no longs, and their vectors take no part.
WIDEST = 2.0**62
#: Components that are returned.
COMPONENTS = 8
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(vector: Column) -> Column:
    """The entries of an array as whole numbers."""
    return F.transform(vector, lambda c: F.floor(SCALE * c) + F.lit(SHIFT).cast("long"))


def usable(vector: Column) -> Column:
    """Whether an array has entries, and each of them is finite and becomes a long."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * SCALE >= WIDEST))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def fit_list(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, int]:
    """vec_id and x of the vectors of the most frequent length (the longer of two as frequent), and this length."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = top["d"] if top else 0
    return rows.filter(F.size("v") == d).select("vec_id", whole(F.col("v")).alias("x")), d


def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows x become, once a task, count, sum (in a high and a low half), least and greatest entry by dimension."""
    n, high, low, least, most = 0, 0, 0, None, None
    for batch in batches:
        if len(batch):
            x = np.stack(batch["x"].to_numpy())
            n += len(x)
            high, low = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
            least = x.min(axis=0) if least is None else np.minimum(least, x.min(axis=0))
            most = x.max(axis=0) if most is None else np.maximum(most, x.max(axis=0))
    if n:
        yield pd.DataFrame({"pos": np.arange(len(low)), "n": n, "high": high, "low": low, "least": least, "most": most})


def totals(rows: DataFrame) -> tuple[int, list[int], list[int], list[int]]:
    """n, and sum, least and greatest entry of each dimension, exactly; one row a dimension comes to the driver."""
    parts = rows.select("x").mapInPandas(partial_sums, "pos int, n long, high long, low long, least long, most long")
    big = "decimal(38,0)"
    got = parts.groupBy("pos").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast(big)).alias("h"), F.sum(F.col("low").cast(big)).alias("l"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("pos").collect()
    return got[0]["n"], [(int(r["h"]) << 32) + int(r["l"]) for r in got], [r["least"] for r in got], [r["most"] for r in got]


def covariance(rows: DataFrame, n: int) -> np.ndarray:
    """The Gramian of the centred rows (v, an array of double) divided by n."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("v").alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray() / n


def centred(x: Column, n: int, sums: list[int], wide: bool) -> Column:
    """(n * x - S) / n by entry: a difference of whole numbers, then one division."""
    kind = "decimal(38,0)" if wide else "long"
    s = F.array(*[F.lit(str(v)).cast(kind) for v in sums])
    return F.zip_with(x, s, lambda a, b: (a.cast(kind) * F.lit(n).cast("decimal(18,0)" if wide else "long") - b).cast("double") / F.lit(float(n)))


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """For each vector and leading component a row: vec_id, component (from 1, by falling eigenvalue), n, deviation,
    whitened, explained and identity_error.

    Vectors that are null or empty, or hold null or non-finite entries or such as no long can hold once they are whole
    numbers, give no rows; nor do those of another length than the most frequent one, which have no covariance with the
    others. A null id keeps its row, repeated rows are rows of their own and count as often in the fit list. n is the
    length of the fit list; deviation is exact, null where no long can hold it. Components on which all vectors are equal
    have explained 0 and a null whitened, and are left out of identity_error; of equal eigenvalues any basis of their
    space may come out, the same for all rows. Shorter vectors than components have as many components as entries. No
    rows in, no rows out. Other columns are neither read nor returned.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows, d = fit_list(vectors, key, column)
    if not d:
        return spark.createDataFrame([], OUT)
    n, sums, least, most = totals(rows)
    reach = [max(n * b - s, s - n * a) for s, a, b in zip(sums, least, most, strict=True)]
    wide = max(map(abs, sums)) >= 1 << 62 or n * max(map(abs, least + most)) >= 1 << 62
    long = not wide and sum(r * r for r in reach) < 1 << 63
    values, axes = np.linalg.eigh(covariance(rows.select(centred(F.col("x"), n, sums, wide).alias("v")), n))
    trace, order = float(np.maximum(values, 0.0).sum()), np.argsort(-values, kind="stable")[: min(components, d)]
    values, axes = np.maximum(values[order], 0.0), axes[:, order]
    on = values > d * np.finfo(float).eps * max(trace, 1e-300)
    weights = spark.sparkContext.broadcast(np.where(on, axes / np.sqrt(np.where(on, values, 1.0)), 0.0))
    kind = np.int64 if long else object
    total = np.array(sums, dtype=kind)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                off = n * np.stack(batch["x"].to_numpy()).astype(kind) - total
                square = (off * off).sum(axis=1)
                out = pd.DataFrame({"vec_id": batch["vec_id"], "deviation": square if long else pd.array([s if s < 1 << 63 else None for s in square], dtype="Int64")})
                out["w"] = list((off.astype(np.float64) / n) @ weights.value)
                yield out

    told = rows.withColumn("vec_id", F.col("vec_id").cast("string"))  # as numbers beside nulls, pandas would round ids
    done = checkpoint(told.mapInPandas(project, "vec_id string, deviation long, w array<double>").withColumn("vec_id", F.col("vec_id").cast("long")))
    means = [F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(len(values))]
    middle = F.array(*[F.lit(float(m)) for m in done.agg(*means).first()])
    found = covariance(done.select(F.zip_with("w", middle, lambda a, b: a - b).alias("v")), n)[np.ix_(on, on)]
    error = float(np.abs(found - np.eye(len(found))).max()) if len(found) else 0.0
    shares = F.array(*[F.lit(float(v / trace) if trace else 0.0) for v in np.where(on, values, 0.0)])
    some = F.array(*[F.lit(bool(v)) for v in on])
    each = done.select("vec_id", "deviation", F.posexplode(F.arrays_zip(F.col("w").alias("w"), shares.alias("share"), some.alias("on"))).alias("at", "e"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(F.col("e.on"), F.col("e.w")).alias("whitened"), F.col("e.share").alias("explained"), F.lit(error).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
