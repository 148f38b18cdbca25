"""Queries of blocks, tables, messages and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import visual as V
from ..streaming.outbox import FIRST, MOVES, replay
from .journal import replay_sql
from .tables import table


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks whose kind goes by their place."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    kind = F.element_at(F.array(*map(F.lit, ["heading", "bullet", "text", "ordered", "image", "code"])), (F.col("pos") % 6 + 1).cast("int"))
    return d.select("doc_id", "pos", kind.alias("kind"), "text", (F.col("pos") % 9).alias("level"))


def blocks_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.to_markdown(line_blocks(spark, sf_dir), "doc_id").select("doc_id", F.md5("markdown").alias("hash"), "blocks", "images", "chars")


def sparse_cells_to_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("r"), (F.col("l_suppkey") % 4).cast("int").alias("c"), F.concat("l_returnflag", F.lit("|"), F.col("l_partkey").cast("string")).alias("text"))
    return B.grid(cells, "l_orderkey")


def matrix_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    rows = F.array(F.array(F.lit("name"), F.lit("a|b")), F.array("c_name", "c_mktsegment"), F.array(F.col("c_custkey").cast("string"), F.concat("c_mktsegment", F.lit("\n"), F.col("c_nationkey").cast("string"))))
    return c.select("c_custkey", B.matrix_markdown(rows).alias("markdown"))


def heading_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), B.heading_kind(F.col("text")).alias("kind"))


def page_tagged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    page = F.concat(F.lit("[page "), (F.col("turn") + 1).cast("string"), F.lit("]\n"), "text")
    return B.joined(c, ["conv_id"], "turn", F.when(F.col("text") != "", page), "\n\n", "tagged")


def prompt_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    again = F.col("o_orderkey") % 3 == 0
    parts = F.concat_ws("\n", F.concat(F.lit("# document "), F.col("o_orderkey").cast("string")), F.when(F.col("o_orderstatus") == "F", "## attachments"), F.when(again, F.concat(F.lit("## open issues "), "o_orderpriority")), F.when(~again, F.concat(F.lit("## candidates "), F.col("o_custkey").cast("string"))), F.lit("## rules"))
    return o.select("o_orderkey", parts.alias("prompt"))


def notification_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered blocking and major issues of each order."""
    issues = table(spark, sf_dir, "lineitem").filter("l_quantity < 15").withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    line = F.concat(F.col("k").cast("string"), F.lit(". ["), F.when(F.col("l_quantity") < 4, "blocking").otherwise("major"), F.lit("] "), F.col("l_partkey").cast("string"))
    return B.joined(issues, ["l_orderkey"], "k", line, "\n", "message")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).cast("long").alias("id"), F.col("l_quantity").cast("long").alias("bytes"), (F.col("l_partkey") * 7919).alias("hash"), (-F.col("l_quantity")).alias("priority"), (F.col("l_partkey") % 100).cast("double").alias("x0"), (F.col("l_suppkey") % 100).cast("double").alias("y0"))


def greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.within_budget(items(spark, sf_dir), "doc", "id", "bytes", [F.col("priority"), F.col("id")], 4, 90)
    return out.select("doc", F.array_join(F.transform("selected", lambda x: x.cast("string")), ",").alias("selected"))


def greedy_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.unlike(items(spark, sf_dir), "doc", "id", "hash", [F.col("priority"), F.col("id")])
    return out.select("doc", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"))


def rect_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = items(spark, sf_dir).withColumns({"x1": F.col("x0") + 20, "y1": F.col("y0") + 20})
    out = V.boxes_grouped(boxes, "doc", [F.col("id")], 12.0, page=(140.0, 140.0))
    return out.select("doc", F.explode("groups").alias("g")).select("doc", "g.*")


def message_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return B.message_parts(d, "doc_id", "text", 1200).select("doc_id", "part", "parts", F.md5("body").alias("hash"))


REPORTS = ["send", "ok", "fail", "retry", "lost", "cancel"]


def outbox_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = F.element_at(F.array(*map(F.lit, REPORTS)), (F.col("event_id") % 6 + 1).cast("int"))
    return replay(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), report.alias("report")))


QUERIES = {
    "blocks_to_markdown": blocks_to_markdown,
    "sparse_cells_to_grid": sparse_cells_to_grid,
    "matrix_to_markdown": matrix_to_markdown,
    "markdown_table_to_cells": lambda s, d: B.markdown_cells(table(s, d, "documents", "doc_id", "text"), "doc_id", "text"),
    "heading_classifier": heading_classifier,
    "page_tagged_text": page_tagged_text,
    "prompt_sections": prompt_sections,
    "notification_render": notification_render,
    "greedy_budget": greedy_budget,
    "greedy_near_dup": greedy_near_dup,
    "rect_grouping": rect_grouping,
    "message_packing": message_packing,
    "outbox_replay": outbox_replay,
}

#: Regions of a document one after another, as greedy rules take them.
ITEMS = """i AS (SELECT l_orderkey AS doc, l_linenumber * 1000000 + l_partkey AS id, l_quantity::BIGINT AS bytes, l_partkey * 7919 AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY -l_quantity, l_linenumber * 1000000 + l_partkey) AS n FROM lineitem)"""
LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"
SQL = {
    "outbox_replay": f"{replay_sql(MOVES, FIRST, 'user_id::VARCHAR', REPORTS)} SELECT k AS key, state FROM z",
    "greedy_budget": f"""WITH RECURSIVE {ITEMS}, s AS (SELECT DISTINCT doc, 0::BIGINT AS n, 0::BIGINT AS used, []::BIGINT[] AS ids FROM i UNION ALL SELECT s.doc, i.n, if(len(ids) < 4 AND used + bytes <= 90, used + bytes, used), if(len(ids) < 4 AND used + bytes <= 90, list_append(ids, id), ids) FROM s JOIN i ON i.doc = s.doc AND i.n = s.n + 1)
      SELECT doc, array_to_string(ids, ',') AS selected FROM s QUALIFY n = max(n) OVER (PARTITION BY doc)""",
    "greedy_near_dup": f"""WITH RECURSIVE {ITEMS}, s AS (SELECT DISTINCT doc, 0::BIGINT AS n, []::BIGINT[] AS hs, []::BIGINT[] AS ids FROM i UNION ALL SELECT s.doc, i.n, if(len(list_filter(hs, lambda x: bit_count(xor(x, h)) <= 5)) > 0, hs, list_append(hs, h)), if(len(list_filter(hs, lambda x: bit_count(xor(x, h)) <= 5)) > 0, ids, list_append(ids, id)) FROM s JOIN i ON i.doc = s.doc AND i.n = s.n + 1)
      SELECT doc, array_to_string(ids, ',') AS kept FROM s QUALIFY n = max(n) OVER (PARTITION BY doc)""",
    "blocks_to_markdown": f"""WITH {LINES}, n AS (SELECT *, sum((pos % 6 = 4)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS img FROM l),
      m AS (SELECT doc_id, pos, x, CASE pos % 6 WHEN 0 THEN repeat('#', greatest(1, least(6, pos % 9))::INT) || ' ' || x WHEN 1 THEN '- ' || x WHEN 3 THEN '1. ' || x WHEN 4 THEN '[image ' || img::BIGINT || ': ' || x || ']' WHEN 5 THEN '```' || chr(10) || x || chr(10) || '```' ELSE x END AS md FROM n)
      SELECT doc_id, md5(string_agg(md, chr(10) || chr(10) ORDER BY pos)) AS hash, count(*) AS blocks, count(*) FILTER (WHERE pos % 6 = 4) AS images, sum(length(x))::BIGINT AS chars FROM m GROUP BY doc_id""",
    "sparse_cells_to_grid": """WITH c AS (SELECT l_orderkey, l_linenumber - 1 AS r, l_suppkey % 4 AS c, min(l_returnflag || '|' || l_partkey) AS t FROM lineitem GROUP BY ALL), s AS (SELECT l_orderkey, max(r) AS h, max(c) AS w FROM c GROUP BY l_orderkey),
      g AS (SELECT l_orderkey, w, unnest(range(0, h + 1)) AS r FROM s), f AS (SELECT l_orderkey, r, unnest(range(0, w + 1)) AS c FROM g),
      rows_ AS (SELECT f.l_orderkey, f.r, '| ' || string_agg(replace(coalesce(t, ''), '|', '\\|'), ' | ' ORDER BY f.c) || ' |' AS line FROM f LEFT JOIN c USING (l_orderkey, r, c) GROUP BY ALL)
      SELECT l_orderkey, string_agg(line, chr(10) ORDER BY r) AS grid FROM rows_ GROUP BY l_orderkey""",
    "matrix_to_markdown": """SELECT c_custkey, '| name | a\\|b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_name || ' | ' || c_mktsegment || ' |' || chr(10) || '| ' || c_custkey || ' | ' || c_mktsegment || '<br>' || c_nationkey || ' |' AS markdown FROM customer""",
    "markdown_table_to_cells": rf"""WITH {LINES}, b AS (SELECT doc_id, pos, string_split(regexp_replace(regexp_replace(trim(x), '^\|', ''), '\|$', ''), '|') AS c FROM l WHERE contains(x, '|') AND NOT regexp_matches(x, '^[\s|:-]+$'))
      SELECT doc_id, pos AS r, generate_subscripts(c, 1) - 1 AS c, trim(unnest(c)) AS cell FROM b""",
    "heading_classifier": rf"""WITH {LINES} SELECT doc_id, pos, CASE WHEN regexp_matches(x, '^#{{1,6}}\s') THEN 'markdown' WHEN regexp_matches(x, '^[0-9]+([.][0-9]+)*[.)]?\s') THEN 'numbered' WHEN regexp_matches(x, '^第.+[章节]') THEN 'chapter' WHEN regexp_matches(x, '^[-*•]\s') THEN 'bullet'
      WHEN length(x) <= 40 AND NOT regexp_matches(x, '[.。!?,，;；:]$') THEN 'short' ELSE 'text' END AS kind FROM l""",
    "page_tagged_text": "SELECT conv_id, coalesce(string_agg('[page ' || (turn + 1) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE text <> ''), '') AS tagged FROM conversations GROUP BY conv_id",
    "prompt_sections": """SELECT o_orderkey, concat_ws(chr(10), '# document ' || o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '## attachments' END, CASE WHEN o_orderkey % 3 = 0 THEN '## open issues ' || o_orderpriority END, CASE WHEN o_orderkey % 3 <> 0 THEN '## candidates ' || o_custkey END, '## rules') AS prompt FROM orders""",
    "notification_render": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem WHERE l_quantity < 15)
      SELECT l_orderkey, string_agg(k || '. [' || CASE WHEN l_quantity < 4 THEN 'blocking' ELSE 'major' END || '] ' || l_partkey, chr(10) ORDER BY k) AS message FROM k GROUP BY l_orderkey""",
}
