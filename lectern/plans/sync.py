"""Scans of a directory against a sheet: customers are documents, suppliers rows of the sheet, nations directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import sync
from .tables import oracle, table

#: Titles have all kinds of white space; some rows share their node, obj or title with others.
DOCS = """SELECT c_custkey AS doc, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'n' || cast(c_custkey AS string) END AS node, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'o' || cast(c_custkey % 300 AS string) END AS obj,
  CASE WHEN c_custkey % 3 = 0 THEN 'l' || cast(c_custkey AS string) ELSE '' END AS link, 'T' || chr(9) || ' 　' || cast(c_custkey % 40 AS string) AS title, '@a' || cast(c_nationkey % 5 AS string) AS author, 'w' || cast(c_nationkey % 4 AS string) AS wiki FROM {customer}"""
ROWS = """SELECT s_suppkey AS row_id, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'n' || cast(s_suppkey * 3 AS string) END AS node, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'o' || cast(s_suppkey + s_suppkey % 2 AS string) END AS obj,
  CASE WHEN s_suppkey % 6 = 0 THEN 'l' || cast(s_suppkey * 2 AS string) ELSE '' END AS link, 't' || chr(10) || cast(s_suppkey % 40 AS string) AS title, 'a' || cast(s_nationkey % 5 AS string) AS author, 'w' || cast(s_nationkey % 4 AS string) AS wiki,
  CASE s_suppkey % 4 WHEN 0 THEN '已拒稿' WHEN 1 THEN '已移出待审核' ELSE 'AI审稿中' END AS status, CASE WHEN s_suppkey % 9 = 0 THEN '2024/01/01' ELSE '' END AS published FROM {supplier}"""
#: A directory fails where its nation is Brazil.
SCANS = "SELECT 'w' || cast(n_nationkey % 4 AS string) AS wiki, n_name <> 'BRAZIL' AS ok FROM {nation}"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    of = lambda text, name: spark.sql(text, **{name: table(spark, sf_dir, name)})
    return of(DOCS, "customer"), of(ROWS, "supplier"), of(SCANS, "nation")


def document_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rows, _ = sides(spark, sf_dir)
    return sync.matches(docs, rows)


def scan_merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rows, scans = sides(spark, sf_dir)
    return sync.merge_plan(docs, rows, sync.scanned_wikis(scans))


def rows_missing_from_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rows, scans = sides(spark, sf_dir)
    return sync.missing(rows, docs, sync.scanned_wikis(scans)).select("row_id", "wiki", "status")


QUERIES = {"document_matches": document_matches, "scan_merge_plan": scan_merge_plan, "rows_missing_from_scan": rows_missing_from_scan}

TITLE = "lower(replace(replace(replace(replace({0}.title, ' ', ''), chr(9), ''), chr(10), ''), '　', ''))"
#: For each document, level by level, whether any row matches; the first level that any does decides.
MATCHED = f"""d AS ({DOCS}), r AS ({ROWS}), x AS (SELECT d.doc, r.row_id, CASE WHEN d.node <> '' AND d.node = r.node THEN 1 WHEN d.obj <> '' AND d.obj = r.obj THEN 2 WHEN d.link <> '' AND d.link = r.link THEN 3
    WHEN {TITLE.format('d')} = {TITLE.format('r')} AND ltrim(d.author, '@') = ltrim(r.author, '@') AND d.wiki = r.wiki THEN 4 END AS level FROM d, r),
  m AS (SELECT doc, level::INT AS level, row_id, found, found > 1 AS ambiguous FROM (SELECT doc, level, min(row_id) AS row_id, count(*) AS found, row_number() OVER (PARTITION BY doc ORDER BY level) AS k FROM x WHERE level IS NOT NULL GROUP BY doc, level) WHERE k = 1)"""
GONE = f"""s AS ({SCANS}), gone AS (SELECT * FROM r WHERE published = '' AND status = 'AI审稿中' AND wiki NOT IN (SELECT wiki FROM s WHERE NOT ok) AND node NOT IN (SELECT node FROM d))"""
SQL = {
    "document_matches": oracle(f"WITH {MATCHED} SELECT * FROM m"),
    "scan_merge_plan": oracle(f"""WITH {MATCHED}, {GONE} SELECT CASE WHEN m.doc IS NULL THEN 'insert' WHEN ambiguous THEN 'ambiguous' WHEN r.wiki = d.wiki THEN 'update' ELSE 'move' END AS action, d.doc, CASE WHEN NOT ambiguous THEN m.row_id END AS row_id
      FROM d LEFT JOIN m ON m.doc = d.doc LEFT JOIN r ON r.row_id = m.row_id WHERE m.doc IS NOT NULL OR d.obj <> '' UNION ALL SELECT 'removed', NULL, row_id FROM gone"""),
    "rows_missing_from_scan": oracle(f"WITH {MATCHED}, {GONE} SELECT row_id, wiki, status FROM gone"),
}
