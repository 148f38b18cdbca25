"""Tables between the steps of a long job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's folder inside spark.checkpoint.dir; one of its own only where all runs in one process."""
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not top:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            top = tempfile.mkdtemp(prefix="lectern-steps-")
        _folders[sc.applicationId] = f"{top.rstrip('/')}/steps-{sc.applicationId}"
    return _folders[sc.applicationId]


def step(df: DataFrame) -> DataFrame:
    """df as a written table: its plan starts anew, and lost executors lose none of its rows."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
