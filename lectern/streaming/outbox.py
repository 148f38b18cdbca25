"""Journals as streams: the first of each event, and the state of each delivery or job in the order of its reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.machines import replayed

#: What each report of a delivery makes of its state. A state that is not named stays: what was sent or may have been is
#: never sent again.
MOVES = {
    "pending": {"send": "sending", "cancel": "cancelled"},
    "sending": {"ok": "sent", "fail": "failed", "lost": "uncertain", "restart": "uncertain"},
    "failed": {"retry": "pending", "cancel": "cancelled"},
    "uncertain": {"resolve_sent": "sent", "resolve_retry": "pending", "cancel": "cancelled"},
}
FIRST = "pending"
#: The store that keeps the state of streams with timers.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def after(state: str, report: str) -> str:
    return MOVES.get(state, {}).get(report, state)


def replay(reports: DataFrame) -> DataFrame:
    """The last state of each delivery from all its reports: key, seq and report become key and state."""
    return replayed(reports, "key", "seq", "report", MOVES, FIRST).select("key", "state")


class InOrder(StatefulProcessor):
    """Reports wait, by their number, until the watermark has passed their time, and then move the state in this order."""

    def __init__(self, moves: dict[str, dict[str, str]], first: str, idle_ms: int):
        self.moves, self.first, self.idle = moves, first, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string, steps long, last long")
        self.waiting = handle.getMapState("waiting", "seq long", "report string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.state.get()[2] if self.state.exists() else None
        for frame in rows:
            for seq, report, at in zip(frame["seq"], frame["report"], frame["at"], strict=True):
                ms = int(pd.Timestamp(at).value // 1_000_000)
                if last is None or seq > last:
                    self.waiting.updateValue((int(seq),), (report, ms))
                    self.handle.registerTimer(ms + 1)
        yield pd.DataFrame({"key": [], "state": [], "steps": []}).astype({"key": str, "state": str, "steps": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((k[0], v[0], v[1]) for k, v in self.waiting.iterator())
        state, steps, last = self.state.get() if self.state.exists() else (self.first, 0, None)
        taken = 0
        for seq, report, at in held:
            if at >= now:
                break
            new = self.moves.get(state, {}).get(report, state)
            state, steps, last = new, steps + (new != state), seq
            self.waiting.removeKey((seq,))
            taken += 1
        if last is not None:
            self.state.update((state, steps, last))
        ended = taken == len(held) and not self.moves.get(state)
        if ended and expiredTimerInfo.getExpiryTimeInMs() <= now - self.idle:
            self.state.clear()
        elif ended and taken:
            self.handle.registerTimer(now + self.idle)
        if taken:
            yield pd.DataFrame({"key": [key[0]], "state": [state], "steps": [steps]})

    def close(self) -> None:
        pass


def states_in_order(reports: DataFrame, moves: dict[str, dict[str, str]], first: str, late: str, idle_ms: int = 86_400_000) -> DataFrame:
    """A stream of reports (key, seq, report, at) becomes one of key, state and steps, a row for each time some are taken.

    The reports of a key are taken by seq, whatever batch they come in, as long as none is later than the watermark,
    late behind the latest at; their at must not fall as seq rises. One that comes after a later one was taken is left
    out. A key whose state no report can move is forgotten idle_ms after its last report. Needs the settings of STORE.
    """
    rows = reports.select("key", "seq", "report", "at").withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(InOrder(moves, first, idle_ms), "key string, state string, steps long", "Update", "EventTime")


def delivery_states(reports: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The states of deliveries, as states_in_order has them."""
    return states_in_order(reports, MOVES, FIRST, late)


def first_events(events: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Each event once; events later than the watermark are taken as known."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
