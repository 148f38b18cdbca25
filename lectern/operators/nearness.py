"""Boxes that overlap and hashes that are near each other, without comparing all pairs of a page or a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..steps import step
from .visual import overlap_ratio

#: Sizes of boxes by powers of two, from the first to the last; larger and smaller ones count as these.
SMALLEST, LARGEST = -20, 40
BOX = ["x0", "y0", "x1", "y1"]


def size_class(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The least n for which a box is no wider or higher than 2 ** n."""
    side = F.greatest(x1 - x0, y1 - y0, F.lit(2.0**SMALLEST))
    return F.least(F.greatest(F.ceil(F.log2(side)), F.lit(SMALLEST)), F.lit(LARGEST)).cast("int")


def in_cells(boxes: DataFrame, page: str, sizes: list[int]) -> DataFrame:
    """boxes once for each cell that they touch, in the grids of their own class and of each larger one of sizes."""
    own = boxes.withColumn("class", size_class(*[F.col(c).cast("double") for c in BOX]))
    grids = own.withColumn("grid", F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda g: g >= F.col("class"))))
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("grid")))
    return grids.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))


def overlapping(left: DataFrame, right: DataFrame, page: str, key: str) -> DataFrame:
    """page, a_key, b_key and ratio (common area over the smaller one) of boxes of a page that have an area in common.

    left and right have page, key, x0, y0, x1 and y1. Two boxes meet in the grid of the larger one's class, where each
    touches four cells at most, and count in the cell that has the lower corner of what they share. Pairs of a box with
    itself are pairs as well where both sides hold it. Boxes with a null or without an area share nothing.
    """
    whole = lambda df: df.select(page, key, *BOX).filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (page, *BOX)]) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    a, b = whole(left), whole(right)
    sizes = sorted({r[0] for df in (a, b) for r in df.select(size_class(*[F.col(c).cast("double") for c in BOX])).distinct().collect()})
    if not sizes:
        return a.select(page, F.col(key).alias("a_key"), F.col(key).alias("b_key"), F.lit(0.0).alias("ratio")).limit(0)
    on = [page, "grid", "cx", "cy"]
    a, b = (in_cells(df, page, sizes).select(*on, *[F.col(c).alias(f"{name}_{c}") for c in (key, "class", *BOX)]) for df, name in ((a, "a"), (b, "b")))
    side = lambda c: F.floor(F.greatest(F.col(f"a_{c}"), F.col(f"b_{c}")) / F.pow(F.lit(2.0), F.col("grid")))
    met = a.join(b, on).filter((F.greatest("a_class", "b_class") == F.col("grid")) & (side("x0") == F.col("cx")) & (side("y0") == F.col("cy")))
    ratio = overlap_ratio(*[[F.col(f"{n}_{c}") for c in BOX] for n in "ab"])
    return met.select(page, F.col(f"a_{key}").alias("a_key"), F.col(f"b_{key}").alias("b_key"), ratio.alias("ratio")).filter("ratio > 0")


def parts_of(hash_: Column, most: int) -> list[Column]:
    """The bits of a hash in one part more than bits may differ, so that near hashes have one part in common."""
    n, at, out = most + 1, 0, []
    for i in range(n):
        width = 64 // n + (i < 64 % n)
        out.append(F.shiftrightunsigned(hash_, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")) if width < 64 else hash_)
        at += width
    return out


def near_hashes(left: DataFrame, right: DataFrame, within: list[str], key: str, hash_: str, most: int = 5) -> DataFrame:
    """within, a_key, b_key and distance of rows of two tables whose hashes differ in at most so many bits.

    Rows meet by an equal part of their hashes, and count at the first of these. within names columns that must be equal.
    A part that very many hashes share makes as many comparisons: hashes should have bits as good as random. Null hashes
    are near nothing.
    """
    cut = lambda df, name: df.filter(F.col(hash_).isNotNull()).select(*within, F.posexplode(F.array(*parts_of(F.col(hash_), most))).alias("at", "part"), F.col(key).alias(f"{name}_key"), F.col(hash_).alias(f"{name}_hash"))
    both = cut(left, "a").join(cut(right, "b"), [*within, "at", "part"])
    apart = parts_of(F.col("a_hash").bitwiseXOR(F.col("b_hash")), most)
    first = F.coalesce(*[F.when(p == 0, F.lit(i)) for i, p in enumerate(apart)])
    return both.filter(F.col("at") == first).select(*within, "a_key", "b_key", F.bit_count(F.col("a_hash").bitwiseXOR(F.col("b_hash"))).alias("distance")).filter(F.col("distance") <= most)


def first_kept(rows: DataFrame, key: str, order: list[Column], hash_: str, most: int = 5) -> DataFrame:
    """rows with kept: taken in order, over all rows, one goes if a kept one before it has a hash within so many bits.

    Rows of one hash are settled by the first of them. Of the others, each turn keeps those that no undecided row before
    them is near, and drops those that a kept one is near; the first undecided row is decided in any turn. Keys should
    differ; rows with a null hash are kept.
    """
    ranked = step(rows.select(F.col(key).alias("id"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("id")).alias("rank"), F.col(hash_).alias("h")))
    first = step(ranked.filter("h is not null").groupBy("h").agg(F.min("rank").alias("rank")).select(F.col("rank.id").alias("id"), "rank", "h"))
    pairs = near_hashes(first, first, [], "id", "h", most).filter(F.col("a_key") != F.col("b_key"))
    ranks = first.select("id", "rank")
    pairs = pairs.join(ranks.select(F.col("id").alias("a_key"), F.col("rank").alias("a_rank")), "a_key").join(ranks.select(F.col("id").alias("b_key"), F.col("rank").alias("b_rank")), "b_key")
    pairs = step(pairs.filter(F.col("a_rank") < F.col("b_rank")).select(F.col("a_key").alias("a"), F.col("b_key").alias("b")))
    open_, dropped = pairs, []
    while not open_.isEmpty():
        kept = open_.select(F.col("a").alias("id")).distinct().join(open_.select(F.col("b").alias("id")), "id", "left_anti")
        gone = step(open_.join(kept.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        dropped.append(gone)
        rest = open_.join(kept.withColumnRenamed("id", "a"), "a", "left_anti")
        open_ = step(rest.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"))
    lost = reduce(DataFrame.unionByName, dropped).withColumn("gone", F.lit(True)) if dropped else first.select("id", F.lit(True).alias("gone")).limit(0)
    kept = first.join(lost, "id", "left").filter("gone is null").select("id").unionByName(ranked.filter("h is null").select("id"))
    return rows.join(kept.select(F.col("id").alias(key), F.lit(True).alias("kept")), key, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
