"""A sheet as a Python data source: ranges of rows are partitions that seek their bytes; blank rows at the end are left out."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .local import open_bytes

ROWS = 1000
#: Bytes that are read at a time while rows are counted.
CHUNK = 1 << 20


class Range(InputPartition):
    """Rows from first on (from 0), which are the bytes from start to end."""

    def __init__(self, first: int, start: int, end: int):
        self.first, self.start, self.end = first, start, end


def ranges(path: str) -> list[Range]:
    """Where each ROWS rows of a sheet begin and end, from one pass over its bytes; a line break in quotes ends no row."""
    found, rows, begin, at, quotes = [], 0, 0, 0, 0
    with open_bytes(path) as f:
        for line in io.BufferedReader(f, CHUNK):
            at += len(line)
            quotes += line.count(b'"')
            if quotes % 2 == 0:
                rows += 1
                if rows % ROWS == 0:
                    found.append(Range(rows - ROWS, begin, at))
                    begin = at
    if at > begin or not found:
        found.append(Range(len(found) * ROWS, begin, at))
    return found


class SheetReader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def partitions(self) -> list[Range]:
        return ranges(self.path)

    def read(self, partition: Range) -> Iterator[tuple]:
        with open_bytes(self.path) as f:
            f.seek(partition.start)
            text = f.read(partition.end - partition.start).decode()
        for i, row in enumerate(csv.reader(io.StringIO(text, newline=""))):
            yield partition.first + i + 1, [*row[: self.width], *[""] * (self.width - len(row))]


class SheetSource(DataSource):
    """format("sheet") with options path (a CSV export that driver and tasks can read) and width."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> str:
        return "row_no int, cells array<string>"

    def reader(self, schema) -> SheetReader:
        return SheetReader(self.options["path"], int(self.options.get("width", 14)))


def read_sheet(spark: SparkSession, path: str, width: int = 14) -> DataFrame:
    """Rows up to the last that is not blank; blank ones between stay."""
    spark.dataSource.register(SheetSource)
    rows = spark.read.format("sheet").option("path", path).option("width", width).load()
    last = rows.filter(F.exists("cells", lambda c: F.trim(c) != "")).agg(F.coalesce(F.max("row_no"), F.lit(0)).alias("last"))
    return rows.join(F.broadcast(last), F.col("row_no") <= F.col("last")).drop("last")
