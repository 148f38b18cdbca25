"""State machines over journals: the last state of each key, whatever share of all reports one key has.

What a run of reports does to a state is a function of few states to few states, and such functions can be composed. So
reports are sorted over the whole table, each task turns its part of a key's reports into one function, and the
functions of a key, one a task at most, are composed in their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def states_of(moves: dict[str, dict[str, str]], first: str) -> list[str]:
    return sorted({first, *moves, *(new for own in moves.values() for new in own.values())})


def replayed(reports: DataFrame, key: str, seq: str, report: str, moves: dict[str, dict[str, str]], first: str) -> DataFrame:
    """key, state and steps, the reports that moved it. moves: by state, what each report makes of it.

    Reports are taken in the order of seq, nulls last, ties by report; unknown and null reports move nothing. A null key is
    a key as well. Reports of one key at one seq are one task's; otherwise a key's may be dealt to any number of tasks.
    """
    names = states_of(moves, first)
    place = {s: i for i, s in enumerate(names)}
    known = {r: [place[moves.get(s, {}).get(r, s)] for s in names] for r in {r for own in moves.values() for r in own}}
    stay = list(range(len(names)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, now, steps = TaskContext.get().partitionId(), None, None, None
        for b in batches:
            done = []
            for k, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if now is None or k != at:
                    if now is not None:
                        done.append((at, now, steps))
                    at, now, steps = k, stay, [0] * len(names)
                move = known.get(r)
                if move is not None:
                    new = [move[s] for s in now]
                    steps = [n + (a != c) for n, a, c in zip(steps, now, new, strict=True)]
                    now = new
            yield rows(part, done)
        if now is not None:
            yield rows(part, [(at, now, steps)])

    def rows(part: int, done: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        columns = [pa.array([d[i] for d in done], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([columns[0], pa.array([part] * len(done), pa.int32()), *columns[1:]], names=["key", "part", "next", "steps"])

    some = reports.select(F.col(key).cast("string").alias("key"), F.col(seq).alias("seq"), F.col(report).alias("report"))
    order = [F.col("key"), F.asc_nulls_last("seq")]
    parts = some.repartitionByRange(*order).sortWithinPartitions(*order, "report").select("key", "report").mapInArrow(work, "key string, part int, next array<int>, steps array<long>")
    start = F.struct(F.lit(place[first]).alias("at"), F.lit(0).cast("long").alias("steps"))
    step = lambda s, f: F.struct(F.get(f["next"], s["at"]).alias("at"), (s["steps"] + F.get(f["steps"], s["at"])).alias("steps"))
    folded = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "next", "steps"))).alias("f")).select("key", F.aggregate("f", start, step).alias("s"))
    return folded.select(F.col("key").cast(dict(reports.dtypes)[key]).alias(key), F.get(F.array(*map(F.lit, names)), F.col("s.at")).alias("state"), "s.steps")
