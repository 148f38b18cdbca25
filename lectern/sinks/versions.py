"""A table of immutable files with numbered manifests: one writer wins a number, others see it and try again.

A table is a folder with data/ (each commit's files, never changed) and manifests/ (a small file of JSON for each version,
which names the files of each bucket). A version exists when its manifest does, and a manifest is put in place as a whole,
only if there is none of its number. So a reader sees one version whatever is written meanwhile, a stop at any step
leaves the last version as it was, and of two writers at once the second works its change out anew from what the first
has left. A change by key reads and writes the buckets of its keys only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import exists, list_names, link_if_absent, read_text, remove

#: Times that a commit is worked out anew before it gives up.
TRIES = 50


class Conflict(ValueError):
    """The same name with other contents."""


class Version(NamedTuple):
    """A version: its number (0: none yet), schema, key, how many buckets, and the folders of each bucket."""

    number: int
    schema: StructType | None
    key: str | None
    buckets: int
    parts: dict[str, list[str]]


NONE = Version(0, None, None, 1, {})


def latest(spark: SparkSession, path: str) -> int:
    """The number of the last version, 0 where there is none."""
    return max((int(n.removesuffix(".json")) for n in list_names(spark, f"{path}/manifests") if n.endswith(".json")), default=0)


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    n = latest(spark, path) if number is None else number
    if not n:
        return NONE
    m = json.loads(read_text(spark, f"{path}/manifests/{n:012d}.json"))
    return Version(n, StructType.fromJson(m["schema"]), m["key"], m["buckets"], m["parts"])


def frame(spark: SparkSession, path: str, v: Version, buckets: list[str] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets."""
    folders = [f"{path}/data/{p}" for b, parts in v.parts.items() if buckets is None or b in buckets for p in parts]
    return spark.read.schema(v.schema).parquet(*folders) if folders else spark.createDataFrame([], v.schema)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table as of a version, the last one if none is given; what is committed later doesn't change it."""
    v = version(spark, path, number)
    if not v.number:
        raise FileNotFoundError(path)
    return frame(spark, path, v)


def bucket_of(key: str | None, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string") if key else F.lit("0")


def written(df: DataFrame, path: str, key: str | None, buckets: int) -> dict[str, list[str]]:
    """The folders of each bucket of rows that are written now, of no version yet."""
    name = uuid.uuid4().hex
    df.withColumn("_bucket", bucket_of(key, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/data/{name}")
    found = [n for n in list_names(df.sparkSession, f"{path}/data/{name}") if n.startswith("_bucket=")]
    return {n.removeprefix("_bucket="): [f"{name}/{n}"] for n in found}


def commit(spark: SparkSession, path: str, change: Callable[[Version], Version | None]) -> int:
    """The number of the version that change makes of the last one, or of the last where it makes None of it.

    change may be called again, with a newer version, if another writer was first.
    """
    for _ in range(TRIES):
        old = version(spark, path)
        new = change(old)
        if new is None:
            return old.number
        manifest = {"schema": new.schema.jsonValue(), "key": new.key, "buckets": new.buckets, "parts": new.parts}
        if link_if_absent(spark, json.dumps(manifest), f"{path}/manifests/{old.number + 1:012d}.json"):
            return old.number + 1
    raise Conflict(f"{path}: {TRIES} other commits came first")


def replace(df: DataFrame, path: str, key: str | None = None, buckets: int = 1) -> int:
    """All rows of the table are df's; df may read the table."""
    parts = written(df, path, key, buckets)
    return commit(df.sparkSession, path, lambda old: Version(0, df.schema, key, buckets, parts))


def append(df: DataFrame, path: str) -> int:
    """df's rows behind those that are there; a table begins with the first ones."""
    parts: dict[str, list[str]] = {}

    def change(old: Version) -> Version:
        if not parts:
            parts.update(written(df, path, old.key, old.buckets))
        return Version(0, old.schema or df.schema, old.key, old.buckets, {b: old.parts.get(b, []) + parts.get(b, []) for b in {*old.parts, *parts}})

    return commit(df.sparkSession, path, change)


def rewritten(df: DataFrame, path: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """merge(old rows, df's rows) in the place of the old ones, in the buckets that df's keys are in."""
    spark = df.sparkSession

    def change(old: Version) -> Version | None:
        if not old.number:
            raise FileNotFoundError(path)
        touched = sorted(r[0] for r in df.select(bucket_of(old.key, old.buckets)).distinct().collect())
        if not touched:
            return None
        new = written(merge(frame(spark, path, old, touched), df).select(old.schema.names), path, old.key, old.buckets)
        return old._replace(parts={b: p for b, p in old.parts.items() if b not in touched} | new)

    return commit(spark, path, change)


def upsert(df: DataFrame, path: str, key: str, buckets: int = 16) -> int:
    """df's rows instead of those of their keys; of rows of df with one key, any one that is given first. Columns that df
    lacks become null. The first upsert makes the table, with so many buckets by key."""
    if not latest(df.sparkSession, path):
        first = written(df.dropDuplicates([key]), path, key, buckets)
        won = link_if_absent(df.sparkSession, json.dumps({"schema": df.schema.jsonValue(), "key": key, "buckets": buckets, "parts": first}), f"{path}/manifests/{1:012d}.json")
        if won:
            return 1
    return rewritten(df, path, lambda old, new: old.join(new.select(key), key, "left_anti").unionByName(new.dropDuplicates([key]), allowMissingColumns=True))


def delete(keys: DataFrame, path: str, key: str) -> int:
    """The table without the rows of these keys."""
    return rewritten(keys.select(key), path, lambda old, gone: old.join(gone, key, "left_anti"))


def append_history(new: DataFrame, path: str, key: str, body: str) -> int:
    """How many rows of new were appended: those of known keys with the same body are not.

    Another body under a key, in the table or in new itself, is a Conflict, and nothing is appended. Two writers can't
    both add a key: the second looks again at what the first has left.
    """
    spark, count = new.sparkSession, 0
    twice = new.groupBy(key).agg(F.count_distinct(F.struct(F.lit(1), body)).alias("bodies")).filter("bodies > 1")
    if not twice.isEmpty():
        raise Conflict(f"{path}: {twice.first()[key]} comes with different contents")
    once = new.dropDuplicates([key])

    def change(old: Version) -> Version | None:
        nonlocal count
        rows = once
        if old.number:
            touched = sorted(r[0] for r in once.select(bucket_of(old.key, old.buckets)).distinct().collect())
            known = frame(spark, path, old, touched).select(F.col(key), F.col(body).alias("_known"), F.lit(True).alias("_there"))
            both = once.join(known, key, "left")
            if not both.filter(F.col("_there") & ~F.col("_known").eqNullSafe(F.col(body))).isEmpty():
                raise Conflict(path)
            rows = both.filter(F.col("_there").isNull()).select(once.columns)
        count = rows.count()
        if not count and old.number:
            return None
        own, n = (old.key, old.buckets) if old.number else (key, 1)
        parts = written(rows, path, own, n)
        return Version(0, old.schema or new.schema, own, n, {b: old.parts.get(b, []) + parts.get(b, []) for b in {*old.parts, *parts}})

    commit(spark, path, change)
    return count


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Deletes and returns the folders of data that none of the last keep versions names; not while anyone writes."""
    last = latest(spark, path)
    used = {p.split("/")[0] for n in range(max(1, last - keep + 1), last + 1) for parts in version(spark, path, n).parts.values() for p in parts}
    gone = [n for n in list_names(spark, f"{path}/data") if n not in used]
    for n in gone:
        remove(spark, f"{path}/data/{n}")
    for n in range(1, last - keep + 1):
        if exists(spark, f"{path}/manifests/{n:012d}.json"):
            remove(spark, f"{path}/manifests/{n:012d}.json")
    return gone
