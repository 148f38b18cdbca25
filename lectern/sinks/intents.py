"""Changes of cells, or messages, that are told to another system at most once each, with a log of intents before them.

A batch of a stream writes what it wants to change to the log, keyed by batch, row and column, says that it starts, makes
the changes, and notes the outcome of each. A batch that is run again finds its intents there. What had an outcome is not
touched; what had not started is made now; and of what had started without an outcome, which is what a stop leaves, the
target itself is asked: what shows the value was applied, what shows another is made again, and where there is no way
to look it is uncertain, and nobody makes it again without being told to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..steps import step
from . import versions

#: Columns of a sheet that may be changed.
COLUMNS = list("ABCDEFGHIJKLMN")
#: Outcomes that are never changed by running a batch again.
ENDED = ("applied", "failed", "uncertain")
KEY = ["batch", "row", "col"]
SCHEMA = "batch long, row string, col string, value string, state string, seq long"


def states(spark: SparkSession, log: str) -> DataFrame:
    """batch, row, col, value and the last state of each intent."""
    if not versions.latest(spark, log):
        return spark.createDataFrame([], SCHEMA).drop("seq")
    return versions.read(spark, log).groupBy(*KEY).agg(F.max_by("value", "seq").alias("value"), F.max_by("state", "seq").alias("state"))


def note(rows: DataFrame, log: str, state: str) -> None:
    """Appends a state of intents; each note has a higher seq than all before it."""
    seq = versions.latest(rows.sparkSession, log) + 1
    versions.append(rows.select(*KEY, "value", F.lit(state).alias("state"), F.lit(seq).cast("long").alias("seq")), log)


def deliver(changes: DataFrame, batch: int, log: str, apply: Callable[[DataFrame], DataFrame], look: Callable[[DataFrame], DataFrame] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The states of a batch's intents after it was run, for the first time or again; for use in foreachBatch.

    changes: row, col and value as text, each row and column once. apply gets row, col and value and returns row, col
    and ok of those for which it has a receipt: others are uncertain. look, if the target can be read, gets row and col and
    returns row, col and value. A column that is not among columns (COLUMNS if none are given; [] allows all) is an error
    before anything is written.
    """
    spark, allowed = changes.sparkSession, COLUMNS if columns is None else columns
    if allowed and not changes.filter(~F.col("col").isin(allowed)).isEmpty():
        raise ValueError("a column that must not be changed")
    own = lambda: states(spark, log).filter(F.col("batch") == batch)
    known = own()
    new = changes.select(F.lit(batch).cast("long").alias("batch"), F.col("row").cast("string").alias("row"), "col", F.col("value").cast("string").alias("value")).join(known, KEY, "left_anti")
    new = step(new)
    if not new.isEmpty():
        note(new, log, "intended")
    known = step(own())
    begun = known.filter("state = 'started'")
    again = begun.limit(0)
    if not begun.isEmpty():
        if look is None:
            note(begun, log, "uncertain")
        else:
            seen = step(begun.join(look(begun.select("row", "col")).select("row", "col", F.col("value").alias("seen")), ["row", "col"], "left"))
            there = F.col("value").eqNullSafe(F.col("seen"))
            note(seen.filter(there), log, "applied")
            again = seen.filter(~there).drop("seen")
    todo = step(known.filter("state = 'intended'").unionByName(again))
    if not todo.isEmpty():
        note(todo, log, "started")
        receipts = step(apply(todo.select("row", "col", "value")).select("row", "col", "ok"))
        done = todo.join(receipts, ["row", "col"], "left")
        for state, which in (("applied", F.col("ok")), ("failed", ~F.col("ok")), ("uncertain", F.col("ok").isNull())):
            part = done.filter(which)
            if not part.isEmpty():
                note(part, log, state)
    return own()


def resolve(spark: SparkSession, log: str, batch: int, row: str, col: str, state: str) -> None:
    """A person's word on an uncertain intent: applied, failed, or intended, so that the next run makes it."""
    if state not in ("applied", "failed", "intended"):
        raise ValueError(state)
    now = states(spark, log).filter((F.col("batch") == batch) & (F.col("row") == row) & (F.col("col") == col) & (F.col("state") == "uncertain"))
    if now.isEmpty():
        raise ValueError("not uncertain")
    note(step(now), log, state)
