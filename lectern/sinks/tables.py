"""Writes that are safe to repeat. A write is a job of Spark into a new folder, which one rename puts in its place.

Tables that change, by replacing, appending or by key, are those of `versions`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import exists, move
from .versions import Conflict


def fingerprint(df: DataFrame) -> tuple:
    """Columns, number and sum of hashes of the rows, whatever their order."""
    names = sorted(df.columns)
    h = F.xxhash64(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))
    r = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(h, F.lit(1)).cast("decimal(38,0)"))).first()
    return (names, *r)


def write_once(df: DataFrame, path: str, same_is_fine: bool = True) -> bool:
    """Whether df was written: not if the same rows are there already; other rows there are a Conflict."""
    spark = df.sparkSession
    if exists(spark, path):
        if same_is_fine and fingerprint(spark.read.parquet(path)) == fingerprint(df):
            return False
        raise Conflict(path)
    staging = f"{path}.{uuid.uuid4().hex}.tmp"
    df.write.parquet(staging)
    move(spark, staging, path)
    return True


def publish(tables: dict[str, DataFrame], path: str, errors: str, check=None) -> DataFrame:
    """The manifest (name, rows, fingerprint) of tables that appear at path together, or not at all.

    A snapshot that is there already stays as it is. check, if given, is called with the folder before it is moved; what
    fails goes to errors, for diagnosis, and is raised.
    """
    spark = next(iter(tables.values())).sparkSession
    if exists(spark, path):
        return spark.read.parquet(f"{path}/manifest")
    staging = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        found = []
        for name, df in tables.items():
            df.write.parquet(f"{staging}/{name}")
            _, n, a, b = fingerprint(spark.read.parquet(f"{staging}/{name}"))
            found.append((name, n, f"{a}:{b}"))
        spark.createDataFrame(found, "name string, rows long, fingerprint string").coalesce(1).write.parquet(f"{staging}/manifest")
        if check:
            check(staging)
        move(spark, staging, path)
    except Exception as e:
        failed = f"{errors}/{uuid.uuid4().hex}"
        spark.createDataFrame([(path, type(e).__name__, str(e)[:500])], "path string, kind string, error string").coalesce(1).write.parquet(f"{failed}/capture_error")
        if exists(spark, staging):
            move(spark, staging, f"{failed}/data")
        raise
    return spark.read.parquet(f"{path}/manifest")


def verify(spark: SparkSession, path: str) -> list[str]:
    """Names of a snapshot's tables that are not what its manifest says."""
    bad = []
    for r in spark.read.parquet(f"{path}/manifest").collect():
        if not exists(spark, f"{path}/{r['name']}"):
            bad.append(r["name"])
            continue
        _, n, a, b = fingerprint(spark.read.parquet(f"{path}/{r['name']}"))
        bad += [r["name"]] * ((n, f"{a}:{b}") != (r["rows"], r["fingerprint"]))
    return bad


def record_errors(errors: DataFrame, path: str) -> None:
    """Errors (action, node, code, seq) appended to a table in which the last of an action and node counts."""
    errors.select("action", "node", "code", "seq", F.sha2(F.to_json(F.array("action", "node")), 256).alias("key")).write.mode("append").parquet(path)


def current_errors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("key").agg(*[F.max_by(c, "seq").alias(c) for c in ("action", "node", "code")], F.max("seq").alias("seq"))


def trace(events: DataFrame, path: str) -> None:
    """Events (run, seq, node, status, details) appended."""
    events.select("run", "seq", "node", "status", "details").write.mode("append").partitionBy("status").parquet(path)
