"""Queries of sheet rows as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as R
from .tables import table


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a sheet made of orders, with a header, short and blank rows, objects, synonyms and odd rounds."""
    k, s = F.col("o_orderkey"), lambda c: F.col(c).cast("string")
    pick = lambda m, *v: F.element_at(F.array(*map(F.lit, v)), (k % m + 1).cast("int"))
    link = F.concat(F.lit("https://h/wiki/n"), s("o_orderkey"))
    cells = F.array(
        s("o_orderkey"),
        F.concat(F.lit(" title "), s("o_orderkey"), F.lit(" ")),
        F.when(k % 3 == 0, F.concat(F.lit('{"text":"t","link":"'), link, F.lit('"}'))).when(k % 3 == 1, link).otherwise(F.lit("")),
        s("o_orderpriority"),
        F.concat(F.lit("@a"), s("o_custkey")),
        pick(4, "ai", "人工 ＋ai", "人工", ""),
        F.lit(""),
        F.element_at(F.array(*map(F.lit, ("待分配审稿", "已驳回", "需修改", "AI审稿中", "已修改待复审"))), (F.floor(k / 4) % 5 + 1).cast("int")),
        pick(6, "", "1", "2.0", "1.5", "x", "1e12"),
        pick(2, "45000", "2024/05/06 07:08:09"),
        F.lit(""),
        F.when(k % 11 == 0, "2024/01/01").otherwise(""),
        F.when(k % 2 == 0, F.concat(F.lit("node"), s("o_orderkey"))).otherwise(""),
        F.concat(F.lit("obj"), s("o_custkey")),
    )
    short = F.when(k % 7 == 0, F.slice(cells, 1, 9)).when(k % 13 == 0, F.slice(cells, 1, 1)).otherwise(cells)
    head = spark.range(1).select(F.lit(1).cast("long").alias("row_no"), F.array(*map(F.lit, R.HEADER)).alias("cells"))
    return head.unionByName(table(spark, sf_dir, "orders").select((k + 1).alias("row_no"), short.alias("cells")))


def sheet_rows_to_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.records_of(sheet_rows(spark, sf_dir))
    return rows.withColumn("eligible", R.eligible())


QUERIES = {"sheet_rows_to_records": sheet_rows_to_records}
SQL = {
    "sheet_rows_to_records": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS a, o_orderpriority AS p, o_orderkey % 7 = 0 AS short FROM orders WHERE o_orderkey > 0 AND (o_orderkey % 7 = 0 OR o_orderkey % 13 <> 0)),
      r AS (SELECT k + 1 AS row_no, 'title ' || k AS title, CASE WHEN k % 3 = 2 THEN '' ELSE 'https://h/wiki/n' || k END AS link, p AS wiki_name, '@a' || a AS author, CASE k % 4 WHEN 0 THEN 'AI' WHEN 1 THEN '人工+AI' WHEN 2 THEN '人工' ELSE '' END AS method, '' AS reviewer,
        CASE k // 4 % 5 WHEN 0 THEN '待分配人工审稿' WHEN 1 THEN '已拒稿' WHEN 2 THEN '需修改' WHEN 3 THEN 'AI审稿中' ELSE '已修改待复审' END AS status, (CASE k % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END)::INT AS round, CASE WHEN short THEN '' WHEN k % 2 = 0 THEN '2023/03/15 00:00:00' ELSE '2024/05/06 07:08:09' END AS updated, '' AS reviewed,
        CASE WHEN k % 11 = 0 AND NOT short THEN '2024/01/01' ELSE '' END AS published, CASE WHEN k % 2 = 0 AND NOT short THEN 'node' || k WHEN k % 3 = 2 THEN '' ELSE 'n' || k END AS node, CASE WHEN short THEN '' ELSE 'obj' || a END AS obj, CASE WHEN k % 6 > 2 THEN 'illegal_round' END AS error FROM o)
      SELECT *, method IN ('AI', '人工+AI') AND status IN ('AI审稿中', '已修改待复审') AND published = '' AND node <> '' AND obj <> '' AS eligible FROM r""",
}
