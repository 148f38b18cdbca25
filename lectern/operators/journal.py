"""Keyed state from an append-only journal: last and first wins, histories and plans to append."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_wins(journal: DataFrame, keys: list[str], seq: str, *values: str) -> DataFrame:
    """The latest values of each key, with the sequence of its first row, which is its place."""
    return journal.groupBy(*keys).agg(*[F.max_by(v, seq).alias(v) for v in values], F.min(seq).alias(seq))


def first_wins(journal: DataFrame, keys: list[str], seq: str, *values: str) -> DataFrame:
    return journal.groupBy(*keys).agg(*[F.min_by(v, seq).alias(v) for v in values], F.min(seq).alias(seq), (F.count("*") - 1).alias("refused"))


def latest(history: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row appended last of each key."""
    return history.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))).filter("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with their key; columns that one lacks are null."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def append_plan(history: DataFrame, new: DataFrame, key: str, body: str) -> DataFrame:
    """new with action: insert, noop for a key known with an equal body, conflict for one with another."""
    known = history.select(F.col(key), F.col(body).alias("_known"), F.lit(True).alias("_there"))
    action = F.when(F.col("_there").isNull(), "insert").when(F.col("_known").eqNullSafe(F.col(body)), "noop").otherwise("conflict")
    return new.join(known, key, "left").withColumn("action", action).drop("_known", "_there")
