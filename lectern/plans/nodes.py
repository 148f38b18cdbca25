"""Queries of relational.py whose SQL is for the other engine alone.

Spark's recursion keeps at most a million rows and holds each level in one plan; here each level is a written table. What
a manifest wants and what is there are summed in one pass instead of two that are joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..steps import step
from .tables import table

#: Levels below the top that are followed, and rows of a level up to which it is broadcast to its children.
DEPTH, FEW = 64, 10_000
#: Characters of a path by which rows are dealt to be numbered: five ids of eight characters.
HEAD = 44
#: Lines that a task sums by file, on average.
ROWS = 400_000


def reached(nodes: DataFrame, below, top: DataFrame) -> DataFrame:
    """top and what is below it: nodes (id, parent) of each level are joined to the rows of the level above.

    below makes the columns of a child out of its id and the row above, whose columns begin with up_. Rows that are
    repeated reach their children as often.
    """
    levels = [step(top)]
    for _ in range(DEPTH - 1):
        above = levels[-1].select(*[F.col(c).alias(f"up_{c}") for c in top.columns])
        n = levels[-1].count()
        if not n:
            break
        met = nodes.join(above.hint("broadcast" if n <= FEW else "merge"), (F.col("parent") == F.col("up_id")) & (F.col("id") != F.col("up_id")))
        levels.append(step(below(met)))
    return reduce(DataFrame.unionByName, levels)


def numbered(rows: DataFrame, by: str, path: str, name: str) -> DataFrame:
    """rows with their number among those of by, in the order of path.

    Rows are numbered within the heads of their paths, and heads, of which there are few, among each other: a task has
    the rows of one head, not all of by.
    """
    rows = rows.withColumn("_head", F.substring(path, 1, HEAD))
    sizes = rows.groupBy(by, "_head").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = step(sizes.select(by, "_head", before.alias("_before")))
    within = rows.withColumn("_k", F.row_number().over(Window.partitionBy(by, "_head").orderBy(path)))
    return within.join(heads, [by, "_head"]).withColumn(name, (F.col("_k") + F.col("_before")).cast("int")).drop("_head", "_k", "_before")


def block_tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CAST(floor(p_partkey / 4) AS bigint) AS parent")
    name = "lpad(cast(id AS string), 8, '0')"
    top = nodes.filter("parent = 0").selectExpr("id", "1 AS depth", f"{name} AS path")
    rows = reached(nodes, lambda met: met.selectExpr("id", "up_depth + 1 AS depth", f"concat(up_path, '/', {name}) AS path"), top)
    return numbered(rows.withColumn("top", F.substring("path", 1, 8)), "top", "path", "pos").select("id", "depth", "path", "pos")


def block_tree_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 5 = 0 THEN p_partkey + 5 ELSE CAST(floor(p_partkey / 3) AS bigint) END AS parent")
    rows = reached(nodes, lambda met: met.select("id").distinct(), nodes.filter("parent = 0").select("id").distinct())
    return nodes.filter("id is not null").join(rows, "id", "left_anti").select("id", "parent")


def manifest_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file whose key is null is missing, as null keys meet nothing. Almost each line is a file of its own, so that lines
    are dealt to as many tasks as their number asks for, before anything is summed."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS job", "l_linenumber AS file_no", "l_quantity AS want", "l_suppkey % 20 <> 0 AS there", "CASE WHEN l_partkey % 50 = 0 THEN l_quantity + 1 ELSE l_quantity END AS have")
    rows = rows.repartition(max(1, -(-rows.count() // ROWS)), "job", "file_no")
    files = rows.groupBy("job", "file_no").agg(F.sum("want").alias("want"), F.sum(F.when(F.col("there"), F.col("have"))).alias("have"), F.coalesce(F.bool_or("there"), F.lit(False)).alias("there"))
    missing = ~F.col("there") | F.col("job").isNull() | F.col("file_no").isNull()
    return files.filter(missing | (F.col("have") != F.col("want"))).select("job", "file_no", F.when(missing, "missing").otherwise("changed").alias("violation"))


QUERIES = {"manifest_integrity": manifest_integrity, "block_tree_flatten": block_tree_flatten, "block_tree_unreachable": block_tree_unreachable}
