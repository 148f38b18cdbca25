"""Journal and evidence queries by the operators; their SQL is in `relational` and is run by the other engine alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs, nearness, visual
from ..operators import journal as J
from .tables import table


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("rkey"), F.col("event_id").alias("seq"), F.col("value").alias("payload"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("doc"), (F.col("event_id") % 4).alias("round_no"), F.col("event_type").alias("result"), F.col("value").alias("score"))


def idempotent_append_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history(spark, sf_dir).withColumn("key", F.struct("doc", "round_no"))
    known, new = (J.last_wins(rows.filter(F.col("seq") % 2 == odd), ["key"], "seq", "result") for odd in (0, 1))
    return J.append_plan(known, new, "key", "result").select("key.doc", "key.round_no", "action")


def bbox_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page that have an area in common, however many the page has."""
    side = lambda c: F.col(c) % 100
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), side("l_partkey").alias("x0"), side("l_suppkey").alias("y0"), (side("l_partkey") + F.col("l_quantity")).alias("x1"), (side("l_suppkey") + F.col("l_quantity")).alias("y1"))
    out = nearness.overlapping(b, b, "page", "id").filter("a_key < b_key")
    return out.groupBy("page", F.col("a_key").alias("a_id"), F.col("b_key").alias("b_id"), F.round("ratio", 6).alias("ratio")).agg(F.count("*").alias("n"))


def hamming_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("id"), (F.col("l_partkey") * 7919 + F.col("l_suppkey")).alias("h"))
    near = nearness.near_hashes(h, h, ["doc"], "id", "h").filter("a_key < b_key")
    return near.groupBy("doc", F.col("a_key").alias("a_id"), F.col("b_key").alias("b_id"), "distance").agg(F.count("*").alias("n"))


def dedup_exact_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("sha"))
    return visual.first_of_equal(rows, "doc", "sha", ["id"], "id")


REPORTS = ["start", "reviewed", "write", "written", "commit", "fail", "stale", "start"]


def job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine of jobs over the journal, whose kinds and numbers stand for reports."""
    report = F.element_at(F.array(*map(F.lit, REPORTS)), (F.col("event_id") % 8 + 1).cast("int"))
    return jobs.replay(table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), report.alias("report")))


def key_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 12 + 1).alias("page"))
    return jobs.key_pages(rows, "doc", "pos", "page", F.lit(1).cast("long")).select("doc", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


QUERIES = {
    "kv_put_last_wins": lambda s, d: J.last_wins(entries(s, d), ["kind", "rkey"], "seq", "payload"),
    "kv_add_first_wins": lambda s, d: J.first_wins(entries(s, d), ["kind", "rkey"], "seq", "payload"),
    "index_upsert_latest": lambda s, d: J.latest(history(s, d), ["doc"], "seq").select("doc", "result", "score", "seq"),
    "latest_history_for_round": lambda s, d: J.latest(history(s, d).filter("round_no >= 1"), ["doc", "round_no"], "seq").select("doc", "round_no", "result", "seq"),
    "idempotent_append_plan": idempotent_append_plan,
    "bbox_overlap_join": bbox_overlap_join,
    "hamming_near_dup": hamming_near_dup,
    "dedup_exact_first": dedup_exact_first,
    "job_lifecycle": job_lifecycle,
    "key_pages": key_pages,
}


def replay_sql(moves: dict[str, dict[str, str]], first: str, key: str, reports: list[str]) -> str:
    """The states of events by recursion, one report after another; reports come round by number."""
    table_ = ", ".join(f"('{old}', '{report}', '{new}')" for old, own in moves.items() for report, new in own.items())
    return f"""WITH RECURSIVE m(state, report, new) AS (VALUES {table_}), e AS (SELECT {key} AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, {reports!r}[event_id % {len(reports)} + 1] AS report FROM events),
      s AS (SELECT DISTINCT k, 0::BIGINT AS n, '{first}' AS state, 0::BIGINT AS steps FROM e UNION ALL SELECT s.k, e.n, coalesce(m.new, s.state), s.steps + if(m.new IS NULL, 0, 1) FROM s JOIN e ON e.k = s.k AND e.n = s.n + 1 LEFT JOIN m ON m.state = s.state AND m.report = e.report),
      z AS (SELECT * FROM s QUALIFY n = max(n) OVER (PARTITION BY k))"""


SQL = {
    "job_lifecycle": f"{replay_sql(jobs.MOVES, jobs.FIRST, 'user_id', REPORTS)} SELECT k AS job, state, steps FROM z",
    "key_pages": """WITH p AS (SELECT l_orderkey AS doc, l_partkey % 12 + 1 AS page, min(l_linenumber * 100 + l_partkey % 12 + 1) AS seen FROM lineitem GROUP BY ALL),
      f AS (SELECT * FROM p WHERE page <> 1 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY seen) <= 7) SELECT doc, concat_ws(',', '1', (SELECT string_agg(page::VARCHAR, ',' ORDER BY seen) FROM f WHERE f.doc = d.doc)) AS pages FROM (SELECT DISTINCT doc FROM p) d""",
}
