"""Jobs of reviews: their states, what makes them obsolete, cycles, and what is picked from their runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .machines import replayed

# What each report makes of a job's state. A report that a state does not know leaves it.
MOVES = {
    "queued": {"start": "reviewing", "stale": "obsolete", "cancel": "cancelled"},
    "reviewing": {"reviewed": "reviewed", "fail": "review_failed", "stale": "obsolete", "cancel": "cancelled"},
    "review_failed": {"start": "reviewing", "stale": "obsolete", "cancel": "cancelled"},
    "reviewed": {"write": "sheet_pending", "written": "sheet_written", "stale": "obsolete"},
    "sheet_pending": {"written": "sheet_written", "stale": "obsolete"},
    "sheet_written": {"commit": "committed", "stale": "obsolete"},
}
#: Jobs in these states hold nothing back; all others are pending.
ENDED = ("committed", "obsolete", "cancelled")
FIRST = "queued"
#: Why a job's record is no longer what it was made from, in the order in which it is asked.
STALE = ("row_missing_or_duplicate", "document_identity_changed_or_not_docx", "document_version_changed", "document_not_in_enabled_pending_directory", "sheet_version_or_method_changed", "sheet_result_changed", "sheet_review_state_changed", "review_cycle_changed")
KEY_PAGES = 8


def after(state: str, report: str) -> str:
    return MOVES.get(state, {}).get(report, state)


def replay(reports: DataFrame) -> DataFrame:
    """job, state and steps (the reports that moved it) from rows job, seq and report, as `machines.replayed` says."""
    return replayed(reports, "job", "seq", "report", MOVES, FIRST)


def stale_reason(**broken: Column) -> Column:
    """The first of STALE whose condition holds, else null."""
    return F.coalesce(*[F.when(broken[name], name) for name in STALE if name in broken])


def obsolete(jobs: DataFrame, reason: Column) -> DataFrame:
    """jobs with status obsolete and obsolete_reason where there is a reason and they have not ended; their results stay."""
    hit = reason.isNotNull() & ~F.col("status").isin(*ENDED)
    return jobs.withColumn("obsolete_reason", F.when(hit, reason)).withColumn("status", F.when(F.col("obsolete_reason").isNotNull(), "obsolete").otherwise(F.col("status")))


def pending(jobs: DataFrame, node: str = "node") -> DataFrame:
    """Nodes that have a job which has not ended."""
    return jobs.filter(~F.col("status").isin(*ENDED)).select(node).distinct()


def reset_cycles(records: DataFrame, control: DataFrame) -> DataFrame:
    """control (node, cycle, handoff, reset_marker) after records of rejected and then changed submissions.

    records: node, marker, reset. A marker that is known starts no second cycle, so that a repeated run changes nothing.
    Nodes without control begin at cycle 0.
    """
    wanted = records.filter("reset").select("node", F.col("marker").alias("_new")).dropDuplicates(["node"])
    both = control.join(wanted, "node", "full")
    again = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("reset_marker"))
    return both.select("node", (F.coalesce("cycle", F.lit(0)) + again.cast("int")).alias("cycle"), F.when(again, False).otherwise(F.coalesce("handoff", F.lit(False))).alias("handoff"), F.when(again, F.col("_new")).otherwise(F.col("reset_marker")).alias("reset_marker"))


def key_pages(evidence: DataFrame, doc: str, pos: str, page: str, first: Column, most: int = KEY_PAGES) -> DataFrame:
    """doc and pages: the first page, then those of the evidence as they first occur, so many at most."""
    pages = F.transform(F.array_sort(F.collect_list(F.struct(pos, page))), lambda x: x[page])
    return evidence.groupBy(doc).agg(F.slice(F.array_distinct(F.concat(F.array(first), pages)), 1, most).alias("pages"))


def latest_model(calls: DataFrame, key: str, phase: str) -> DataFrame:
    """The model of the last call whose phase begins so: key, model."""
    return calls.filter(F.col("phase").startswith(phase)).groupBy(key).agg(F.max_by("model", "seq").alias("model"))


def enabled_parents(config: DataFrame) -> DataFrame:
    """wiki and parent of config rows (wiki, enabled, parent) that are switched on."""
    return config.filter(F.lower(F.trim("enabled")).isin("true", "1", "yes", "是", "启用") & (F.col("parent") != "")).select("wiki", "parent").distinct()
