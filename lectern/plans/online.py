"""Messages of online reviews: orders are reviews, their items issues, resolutions and similar articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import online
from .tables import oracle, table

REVIEWS = """SELECT o_orderkey AS doc, 't' || cast(o_custkey AS string) AS title, 'https://h/' || cast(o_orderkey AS string) AS link, o_orderkey % 3 AS round, o_orderstatus AS status, o_orderpriority AS summary,
  CASE o_orderkey % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'need_revision' WHEN 2 THEN 'recommend_human_review' WHEN 3 THEN 'incomplete_review' ELSE 'reject' END AS outcome,
  CASE o_orderkey % 4 WHEN 0 THEN 'merge_required' WHEN 1 THEN 'reject_independent_submission' ELSE 'keep_independent' END AS decision, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 's' || cast(o_orderkey % 10 AS string) END AS similarity,
  o_orderkey % 7 = 0 AS handoff, '@a' || cast(o_custkey % 9 AS string) AS author, 'w' || cast(o_custkey % 4 AS string) AS wiki FROM {orders}"""
ITEMS = """SELECT l_orderkey AS doc, l_linenumber * 100000 + l_partkey AS pos, CASE WHEN l_quantity < 4 THEN 'blocking' WHEN l_quantity < 12 THEN 'major' ELSE 'minor' END AS level, l_returnflag AS category,
  l_linestatus AS position, 'p' || cast(l_partkey AS string) AS problem, 's' || cast(l_suppkey AS string) AS suggestion, l_suppkey % 5 AS part FROM {lineitem}"""


def online_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of one place (pos) come in the order of the table's rows, as the other engine reads them."""
    reviews = spark.sql(REVIEWS, orders=table(spark, sf_dir, "orders"))
    placed = table(spark, sf_dir, "lineitem").select("*", F.struct("_metadata.file_name", "_metadata.row_index").alias("nth"))
    items = spark.sql(ITEMS.replace("SELECT ", "SELECT nth, ", 1), lineitem=placed).withColumn("pos", F.struct("pos", "nth"))
    resolutions = items.filter("part = 0").selectExpr("doc", "pos", "problem AS issue_id", "level AS status", "suggestion AS evidence")
    candidates = items.filter("part = 1").selectExpr("doc", "pos", "problem AS title", "category AS wiki", "suggestion AS link", "level AS evidence")
    found = online.messages(reviews, items, resolutions, candidates)
    return found.selectExpr("doc", "md5(author) AS author", "md5(admin) AS admin", "length(author) AS chars")


QUERIES = {"online_messages": online_messages}

N = "chr(10)"
SQL = {
    "online_messages": oracle(f"""WITH r AS ({REVIEWS}), i AS ({ITEMS}), f AS (SELECT doc, string_agg('[' || level || ' / ' || category || '] ' || position || {N} || '问题：' || problem || {N} || '修改建议：' || suggestion, {N} || {N} ORDER BY pos) AS t FROM i WHERE level <> 'minor' GROUP BY doc),
      s AS (SELECT doc, string_agg(problem || '：' || level || {N} || suggestion, {N} ORDER BY pos) AS t FROM i WHERE part = 0 GROUP BY doc), c AS (SELECT doc, string_agg({N} || problem || '（' || category || '）' || {N} || suggestion || {N} || level, '' ORDER BY pos) AS t FROM i WHERE part = 1 GROUP BY doc),
      b AS (SELECT r.*, '1. 审稿结论' || {N} || '当前状态：' || status || {N} || summary || {N} || {N} || '2. 问题等级说明' || {N} || '{online.RULES}' || {N} || {N} || '3. 必须修改的问题' || {N} || coalesce(f.t, '{online.NO_ISSUES}') || {N} || {N} ||
          CASE WHEN round > 0 THEN '4. 复审解决情况' || {N} || coalesce(s.t, '{online.NO_RESOLUTIONS}') ELSE '4. 相似文档检查' || {N} || '处理结论：' || CASE WHEN decision = 'keep_independent' THEN '可独立保留' WHEN decision = 'merge_required' THEN '建议合并' ELSE '不建议独立提交' END || {N} || coalesce(similarity, '') || coalesce(c.t, '') END ||
          CASE WHEN handoff THEN {N} || {N} || '5. 后续处理' || {N} || '{online.AT_LIMIT}' WHEN outcome IN ('need_revision', 'reject') THEN '' WHEN outcome = 'pass' THEN {N} || {N} || '5. 后续处理' || {N} || '{online.TO_CONFIRM}' ELSE {N} || {N} || '5. 后续处理' || {N} || '{online.BY_HUMANS}' END AS body,
          '《' || title || '》AI审稿意见（第' || (round + 1) || '轮）' || {N} || link AS heading FROM r LEFT JOIN f ON f.doc = r.doc LEFT JOIN s ON s.doc = r.doc LEFT JOIN c ON c.doc = r.doc)
      SELECT doc, md5(heading || {N} || {N} || body) AS author, md5(heading || {N} || '投稿人：' || author || {N} || '知识库：' || wiki || {N} || body) AS admin, length(heading || {N} || {N} || body) AS chars FROM b"""),
}
