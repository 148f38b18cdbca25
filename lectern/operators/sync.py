"""A directory of documents against the rows of a review sheet: which row is whose, and what a scan asks to change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What identifies a document, in the order in which it is asked; title, author and wiki together come last.
LEVELS = ("node", "obj", "link", "title")
# States of a row that a scan leaves.
REJECTED, REMOVED = "已拒稿", "已移出待审核"


def squeezed(title: Column) -> Column:
    """A title in lower case without any white space, of whatever kind."""
    return F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)[\s\x1c-\x1f]+", ""))


def identities(rows: DataFrame, key: str) -> DataFrame:
    """key, level (from 1) and k of each identity that a row has; node, obj and link only where they are not empty."""
    own = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.lit(i).alias("level"), F.array(c).alias("k"))) for i, c in enumerate(LEVELS[:3], 1)]
    last = F.struct(F.lit(4).alias("level"), F.array(squeezed(F.col("title")), F.regexp_replace(F.coalesce("author", F.lit("")), "^@+", ""), F.coalesce("wiki", F.lit(""))).alias("k"))
    return rows.select(F.col(key), F.explode(F.array_compact(F.array(*own, last))).alias("i")).select(key, "i.level", "i.k")


def matches(documents: DataFrame, records: DataFrame, doc: str = "doc", row: str = "row_id") -> DataFrame:
    """doc, level, row_id, found and ambiguous of each document that any row matches.

    Both sides have node, obj, link, title, author and wiki. The first level with a match counts, and of that all rows: more
    than one is ambiguous, and row_id is then the least. All levels are one equi-join.
    """
    met = identities(documents, doc).join(identities(records, row), ["level", "k"])
    at = met.groupBy(doc, "level").agg(F.min(row).alias(row), F.count("*").alias("found"))
    first = at.groupBy(doc).agg(F.min_by(F.struct("level", row, "found"), "level").alias("m"))
    return first.select(doc, "m.level", f"m.{row}", "m.found", (F.col("m.found") > 1).alias("ambiguous"))


def merge_plan(documents: DataFrame, records: DataFrame, scanned: DataFrame) -> DataFrame:
    """action, doc and row_id of all that a scan asks for.

    insert: a document with an obj that no row matches; update: a row that one document matches, move if it is in another
    wiki; ambiguous: a document that several rows match. removed: a row of a wiki of scanned (a column wiki: scanned as a
    whole) whose node no document has, unless it is published, rejected or marked already.
    """
    m = matches(documents, records)
    both = documents.select("doc", "obj", "wiki").join(m, "doc", "left").join(records.select("row_id", F.col("wiki").alias("row_wiki")), "row_id", "left")
    action = F.when(F.col("found").isNull(), F.when(F.coalesce("obj", F.lit("")) != "", "insert")).when(F.col("ambiguous"), "ambiguous").when(F.col("wiki").eqNullSafe(F.col("row_wiki")), "update").otherwise("move")
    asked = both.select(action.alias("action"), "doc", F.when(~F.coalesce("ambiguous", F.lit(False)), F.col("row_id")).alias("row_id")).filter("action is not null")
    return asked.unionByName(missing(records, documents, scanned).select(F.lit("removed").alias("action"), F.lit(None).cast(dict(documents.dtypes)["doc"]).alias("doc"), "row_id"))


def missing(records: DataFrame, documents: DataFrame, scanned: DataFrame) -> DataFrame:
    """Rows of wikis that were scanned as a whole whose node the scan has not seen, but for those that are to stay."""
    open_ = records.filter((F.col("published") == "") & ~F.col("status").isin(REJECTED, REMOVED))
    return open_.join(scanned.select("wiki").distinct(), "wiki", "left_semi").join(documents.select("node").distinct(), "node", "left_anti")


def scanned_wikis(scans: DataFrame) -> DataFrame:
    """wiki of scans (wiki, ok) of which none has failed."""
    return scans.groupBy("wiki").agg(F.bool_and("ok").alias("ok")).filter("ok").select("wiki")
