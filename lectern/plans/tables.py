"""Access to the test tables, and queries whose SQL both engines run as it is."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query of SQL over tables in braces."""
    used = [t for t in TABLES if f"{{{t}}}" in text]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})

    return run


def oracle(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)
