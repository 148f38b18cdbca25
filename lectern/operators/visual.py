"""Evidence to look at: which regions of a document are kept, by order, likeness and budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType


def overlap_ratio(a: list[Column], b: list[Column]) -> Column:
    """Common area over the smaller area of two boxes x0, y0, x1, y1."""
    side = lambda i: F.greatest(F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]), F.lit(0))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return F.try_divide(side(0) * side(1), F.least(area(a), area(b)))


def first_of_equal(rows: DataFrame, doc: str, sha: str, order: list[str], key: str) -> DataFrame:
    """rows with kept, the key of the first row of the same document and content."""
    return rows.withColumn("kept", F.first(key).over(Window.partitionBy(doc, sha).orderBy(*order)))


def fold(rows: DataFrame, doc: str, order: list[Column], fields: list[str], start: Column, step, finish) -> DataFrame:
    """An order-dependent fold over the rows of each document, a bounded list by the limit on regions of a document."""
    items = F.array_sort(F.collect_list(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *fields)))
    return rows.groupBy(doc).agg(items.alias("_items")).select(doc, finish(F.aggregate("_items", start, step)).alias("out"))


def within_budget(rows: DataFrame, doc: str, key: str, size: str, order: list[Column], most_rows: int, most_bytes: int, whole: str | None = None, most_whole: int = 4) -> DataFrame:
    """Rows doc and selected keys, taken in order; one that does not fit is passed over and smaller ones may follow.

    whole names a boolean column of rows that show a whole page, of which only so many fit.
    """
    start = F.struct(F.array().cast("array<long>").alias("ids"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("pages"))

    def step(s: Column, x: Column) -> Column:
        page = x[whole] if whole else F.lit(False)
        fits = (F.size(s["ids"]) < most_rows) & (s["used"] + x[size] <= most_bytes) & (~page | (s["pages"] < most_whole))
        return F.when(fits, F.struct(F.concat(s["ids"], F.array(x[key])).alias("ids"), (s["used"] + x[size]).alias("used"), (s["pages"] + page.cast("int")).alias("pages"))).otherwise(s)

    return fold(rows, doc, order, [key, size, *([whole] if whole else [])], start, step, lambda s: s["ids"]).withColumnRenamed("out", "selected")


def unlike(rows: DataFrame, doc: str, key: str, hash_: str, order: list[Column], most: int = 5, aspect: str | None = None) -> DataFrame:
    """Rows doc and kept keys: a row goes if its hash is within so many bits of one kept before it.

    aspect names a column of width over height; rows that differ in it by more than a twentieth are not alike.
    """
    start = F.array().cast(f"array<struct<id:long,{hash_}:long,aspect:double>>")
    shape = lambda x: x[aspect].cast("double") if aspect else F.lit(1.0)

    def step(kept: Column, x: Column) -> Column:
        same = lambda k: F.abs(k["aspect"] - shape(x)) <= 0.05 * F.greatest(k["aspect"], shape(x), F.lit(0.01))
        near = F.exists(kept, lambda k: same(k) & (F.bit_count(k[hash_].bitwiseXOR(x[hash_])) <= most))
        return F.when(near, kept).otherwise(F.concat(kept, F.array(F.struct(x[key].alias("id"), x[hash_].alias(hash_), shape(x).alias("aspect")))))

    return fold(rows, doc, order, [key, hash_, *([aspect] if aspect else [])], start, step, lambda s: F.transform(s, lambda k: k["id"])).withColumnRenamed("out", "kept")


def boxes_grouped(rows: DataFrame, doc: str, order: list[Column], reach: float, least: int = 4, page: tuple[float, float] | None = None) -> DataFrame:
    """Boxes widened by reach and joined, in order, to the first group whose box theirs meets; groups of at least so many.

    page is a width and a height: boxes below a two-hundredth of it go first, a document of fewer than least others has no
    group, and groups are cut to the page and cover a twentieth of it to nine tenths.
    """
    box = "struct<x0:double,y0:double,x1:double,y1:double,n:int>"
    area = lambda b: (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
    if page:
        edge = {"x0": F.greatest("x0", F.lit(0.0)), "y0": F.greatest("y0", F.lit(0.0)), "x1": F.least("x1", F.lit(float(page[0]))), "y1": F.least("y1", F.lit(float(page[1])))}
        rows = rows.withColumns(edge).filter((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= 0.005 * page[0] * page[1])
    wide = rows.withColumns({"x0": F.col("x0") - reach, "y0": F.col("y0") - reach, "x1": F.col("x1") + reach, "y1": F.col("y1") + reach})

    def step(groups: Column, b: Column) -> Column:
        meets = F.transform(groups, lambda g: (b["x0"] < g["x1"]) & (b["x1"] > g["x0"]) & (b["y0"] < g["y1"]) & (b["y1"] > g["y0"]))
        at = F.array_position(meets, True)
        grown = lambda g: F.struct(F.least(g["x0"], b["x0"]).alias("x0"), F.least(g["y0"], b["y0"]).alias("y0"), F.greatest(g["x1"], b["x1"]).alias("x1"), F.greatest(g["y1"], b["y1"]).alias("y1"), (g["n"] + 1).alias("n"))
        new = F.array(F.struct(b["x0"], b["y0"], b["x1"], b["y1"], F.lit(1).alias("n"))).cast(f"array<{box}>")
        return F.when(at > 0, F.transform(groups, lambda g, i: F.when(i + 1 == at, grown(g)).otherwise(g))).otherwise(F.concat(groups, new))

    def finish(s: Column) -> Column:
        big = F.filter(s, lambda g: g["n"] >= least)
        if not page:
            return big
        cut = F.transform(big, lambda g: F.struct(F.greatest(g["x0"], F.lit(0.0)).alias("x0"), F.greatest(g["y0"], F.lit(0.0)).alias("y0"), F.least(g["x1"], F.lit(float(page[0]))).alias("x1"), F.least(g["y1"], F.lit(float(page[1]))).alias("y1"), g["n"].alias("n")))
        return F.filter(cut, lambda g: area(g).between(0.05 * page[0] * page[1], 0.90 * page[0] * page[1]))

    return fold(wide, doc, order, ["x0", "y0", "x1", "y1"], F.array().cast(f"array<{box}>"), step, finish).withColumnRenamed("out", "groups")


# Words near a picture that make it important, and marks of pages.
IMPORTANT = "(?i)原理图|电路图|PCB|架构|流程图|框图|schematic|architecture|flow|测试|曲线|日志|波形|result|log|chart"
SCREEN = "(?i)界面|截图|配置|调试|安装|操作|QGC|GUI|console"
PAGE_NUMBER = r"(?i)^(?:第\s*)?\d+(?:\s*页)?$"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def line_key(text: Column) -> Column:
    """A line without control characters and white space, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, CONTROL, ""), r"(?U)\s+", ""))


def body_line(text: Column, repeated: Column) -> Column:
    """Whether a line is part of a page's text: not blank, no page number and none of the repeated marginal lines."""
    key = line_key(text)
    return (key != "") & ~key.rlike(PAGE_NUMBER) & ~F.array_contains(repeated, key)


def picture_counts(width: Column, height: Column, page_area: Column) -> Column:
    """Whether a picture of a page is large enough to be looked at."""
    return (width * height / F.greatest(page_area, F.lit(1.0)) >= 0.01) & (width >= 64) & (height >= 64)


def picture_priority(nearby: Column) -> Column:
    return F.when(nearby.rlike(IMPORTANT), 90).when(nearby.rlike(SCREEN), 70).otherwise(40)


def picture_required(nearby: Column, ratio: Column) -> Column:
    return (picture_priority(nearby) >= 70) | (ratio >= 0.20)


def diagram_priority(nearby: Column) -> Column:
    return F.when(nearby.rlike(IMPORTANT), 100).otherwise(85)


def diagram_counts(box: list[Column], page: list[Column], ratio: Column, most_overlap: Column) -> Column:
    """Whether a drawing is one by itself: not most of the page, not at its edge, and no table or picture."""
    inside = (box[0] > page[0] + 1) & (box[1] > page[1] + 1) & (box[2] < page[2] - 1) & (box[3] < page[3] - 1)
    return (ratio <= 0.85) & inside & (F.coalesce(most_overlap, F.lit(0.0)) <= 0.5)


def selection_summary(rows: DataFrame, doc: str) -> DataFrame:
    """doc, count, bytes and whole pages of rows page, bytes, whole that were selected."""
    return rows.groupBy(doc).agg(F.count("*").alias("selected"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list(F.when(F.col("whole"), F.col("page")))).alias("whole_pages"))


def missing_tables(tables: DataFrame, blocks: DataFrame, doc: str) -> DataFrame:
    """Tables (doc, page, table) whose text the document's blocks (doc, markdown) have not."""
    return tables.join(blocks, doc).filter(~F.contains(line_key(F.col("markdown")), line_key(F.col("table")))).select(*tables.columns)


def shrunk(pixels: bytes, width: int, height: int, to: tuple[int, int]) -> np.ndarray:
    """A picture of three bytes a pixel as means over a grid of so many columns and rows."""
    a = np.frombuffer(pixels, dtype=np.uint8).reshape(height, width, 3).astype(np.float64)
    rows, cols = ([slice(i * n // k, max(i * n // k + 1, (i + 1) * n // k)) for i in range(k)] for n, k in ((height, to[1]), (width, to[0])))
    return np.array([[a[r, c].mean(axis=(0, 1)) for c in cols] for r in rows])


@F.pandas_udf(LongType())
def difference_hash(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """64 bits: whether each of 8 times 8 fields of the grey picture is brighter than the next one to the right."""

    def one(p, w, h):
        grey = shrunk(p, w, h, (9, 8)) @ [0.299, 0.587, 0.114]
        return int.from_bytes(np.packbits(grey[:, :-1] > grey[:, 1:]).tobytes(), "big", signed=True)

    return pd.Series([one(*x) for x in zip(pixels, width, height, strict=True)])


@F.pandas_udf(BooleanType())
def near_solid(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Whether no channel of a picture varies by three or more."""
    return pd.Series([bool(shrunk(p, w, h, (32, 32)).std(axis=(0, 1)).max() < 3.0) for p, w, h in zip(pixels, width, height, strict=True)])
