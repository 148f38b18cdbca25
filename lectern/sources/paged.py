"""Records that come in pages, each of which names the next one by a cursor, as a batch or as a stream.

A page is a file of JSON, named by its cursor: items, and next, the cursor of the page behind it, if there is one yet. The
driver follows cursors only, and a cursor that comes again is an error; pages are read by tasks, one a partition.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .local import open_bytes


class RepeatedCursor(ValueError):
    """A page that names one before it as the next."""


class Page(InputPartition):
    def __init__(self, cursor: str, number: int):
        self.cursor, self.number = cursor, number


class Pages:
    """Where the pages of a folder are, and in which order."""

    def __init__(self, options: dict):
        self.path, self.first = options["path"].rstrip("/"), options.get("first", "first")

    def page(self, cursor: str) -> dict:
        with open_bytes(f"{self.path}/{cursor}.json") as f:
            return json.load(f)

    def cursors(self, most: int | None = None) -> list[str]:
        """The cursors from the first one on, so many at most; a page that isn't there yet ends them."""
        seen: dict[str, None] = {}
        at = self.first
        while at and (most is None or len(seen) < most):
            if at in seen:
                raise RepeatedCursor(at)
            try:
                following = self.page(at).get("next")
            except FileNotFoundError:
                break
            seen[at], at = None, following
        return list(seen)

    def items(self, page: Page) -> Iterator[tuple]:
        for i, item in enumerate(self.page(page.cursor).get("items") or []):
            yield page.number, i, json.dumps(item, ensure_ascii=False)


class PagesReader(Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return [Page(c, i) for i, c in enumerate(self.cursors())] or [Page("", -1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.items(partition) if partition.number >= 0 else iter(())


class PagesStream(Pages, DataSourceStreamReader):
    """An offset is the number of pages that have been read, so that a restart follows the cursors again to get there."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"pages": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"pages": len(self.cursors())}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(c, i) for i, c in enumerate(self.cursors(end["pages"])) if i >= start["pages"]]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.items(partition)


class PagedSource(DataSource):
    """format("pages") with options path, a folder that driver and tasks can read, and first, the first page's cursor."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "page int, pos int, item string"

    def reader(self, schema) -> PagesReader:
        return PagesReader(dict(self.options))

    def streamReader(self, schema) -> PagesStream:  # noqa: N802
        return PagesStream(dict(self.options))


def read_pages(spark: SparkSession, path: str, first: str = "first") -> DataFrame:
    """page, pos and item (JSON text) of all pages from the first on."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("pages").option("path", path).option("first", first).load()


def stream_pages(spark: SparkSession, path: str, first: str = "first") -> DataFrame:
    """The same as a stream: pages that a next names later come in later batches."""
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("pages").option("path", path).option("first", first).load()


def as_rows(records: DataFrame, names: list[str], fields: Column | None = None) -> DataFrame:
    """Records (page, pos, item) with a map of fields as rows of a sheet: row_no and cells, the header (names) first.

    fields is a map of text by name, by default that of an item's own member fields. A field that a record lacks is an
    empty cell; those that names lacks are left out. What stands before a page is a sum over pages, of which there are few.
    """
    own = F.from_json(F.get_json_object("item", "$.fields"), "map<string,string>") if fields is None else fields
    cells = F.transform(F.array(*map(F.lit, names)), lambda n: F.coalesce(F.try_element_at(own, n), F.lit("")))
    pages = records.groupBy("page").agg(F.count("*").alias("n"))
    before = pages.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = records.join(before, "page").select((F.col("before") + F.col("pos") + 2).alias("row_no"), cells.alias("cells"))
    head = records.sparkSession.range(1).select(F.lit(1).cast("long").alias("row_no"), F.array(*map(F.lit, names)).alias("cells"))
    return head.unionByName(out)
