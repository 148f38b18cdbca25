"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group is hot when it holds at least one row in this many; there are never more hot groups than this.
HOT = 1000
#: Rows and bytes of an Arrow batch.
BATCH, BATCH_BYTES = 2000, 8 << 20

#: Groups up to which all are joined by broadcast.
FEW = 100_000

#: Words are runs of anything but these (ASCII space, tab to carriage return).
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def trim() -> None:
    """Give memory that this process has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than GNU's
        return


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow, whose Python worker, which Spark uses again, gives free memory back when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        trim()

    return run


_folders: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's folder of intermediate tables, inside spark.checkpoint.dir.

    A folder of our own is set only where none is set and everything runs in one process.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not top:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            top = tempfile.mkdtemp(prefix="lectern-checkpoint-")
            atexit.register(shutil.rmtree, top, ignore_errors=True)
        _folders[sc.applicationId] = f"{top.rstrip('/')}/lectern-{sc.applicationId}"
    return _folders[sc.applicationId]


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session have BATCH rows and BATCH_BYTES at most from now on, unless they are smaller already.

    A DataFrame that goes through Python is executed later, by its caller, and Spark then reads these settings. With
    Spark's own, two tasks of long texts take some hundred MB outside the heap.
    """
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    rows, most = (f"spark.sql.execution.arrow.{name}" for name in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    if not 0 < int(spark.conf.get(rows)) <= BATCH:
        spark.conf.set(rows, str(BATCH))
    if not 0 < size(spark.conf.get(most)) <= BATCH_BYTES:
        spark.conf.set(most, str(BATCH_BYTES))


@contextmanager
def short_plans(spark: SparkSession) -> Iterator[None]:
    """Descriptions of plans, which the driver keeps, are cut for jobs that run inside: literal tables make them long."""
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name)
    spark.conf.set(name, "20000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def new_path(spark: SparkSession) -> str:
    """Where a new intermediate table may be written."""
    return f"{folder(spark)}/{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the folder of spark.checkpoint.dir.

    Executors may be lost, its rows are not. Unlike after DataFrame.checkpoint(), the size that joins are planned by is
    that of the files, not the product of all joins before. Tables stay until release() or the end of the folder.
    """
    path = new_path(df.sparkSession)
    with short_plans(df.sparkSession):
        df.write.parquet(path)
    trim()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete one table of checkpoint() that nothing reads any more."""
    spark = df.sparkSession
    for name in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once a row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def count_of(text: Column, chars: str) -> Column:
    """How many characters of the text are one of chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, n: str, how: str = "left") -> DataFrame:
    """Left or inner join of groups, unique by key, to rows, whatever share of the rows one key has.

    n counts the rows of a group. Up to FEW groups are joined by broadcast; they should be narrow and be read cheaply.
    Of more, a group with a thousandth of all rows or more is joined by broadcast: there are at most HOT of those at any
    size. Other groups meet their rows in a shuffle, where none is large. Rows with a null key have no group and take no
    part in either.
    """
    if groups.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(groups), key, how)
    cols = [c for c in groups.columns if c != key]
    total = groups.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * HOT >= total
    hot, cold = F.broadcast(groups.filter(is_hot)), groups.filter(~is_hot)
    some = rows.filter(F.col(key).isNotNull())
    out = some.join(hot, key)
    out = out.unionByName(some.join(F.broadcast(groups.filter(is_hot).select(key)), key, "left_anti").join(cold, key, how))
    if how == "inner":
        return out
    none = rows.filter(F.col(key).isNull())
    kinds = dict(groups.dtypes)
    return out.unionByName(none.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in cols]))
