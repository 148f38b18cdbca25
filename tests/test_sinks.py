"""Versioned tables, intents before a sink, and journals in order, with stops and other writers in between."""

from __future__ import annotations

import random
import threading

import pytest
from pyspark.sql import functions as F

from lectern.operators import jobs, machines, nearness
from lectern.sinks import intents, versions
from lectern.streaming import outbox


def rows(spark, *items):
    return spark.createDataFrame(list(items), "id int, v string")


def found(spark, path, number=None):
    return sorted(tuple(r) for r in versions.read(spark, path, number).collect())


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert versions.upsert(rows(spark, (1, "a"), (2, "b"), (3, "c")), path, "id", 4) == 1
    assert versions.upsert(rows(spark, (2, "B"), (4, "d"), (4, "d")), path, "id") == 2
    assert versions.delete(rows(spark, (1, "x")), path, "id") == 3
    assert versions.append(rows(spark, (9, "z")), path) == 4
    assert versions.upsert(rows(spark, (1, "x")).limit(0), path, "id") == 4
    assert versions.replace(versions.read(spark, path).withColumn("v", F.upper("v")), path, "id", 2) == 5
    assert found(spark, path, 1) == [(1, "a"), (2, "b"), (3, "c")] and found(spark, path, 2) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    assert found(spark, path, 3) == [(2, "B"), (3, "c"), (4, "d")] and found(spark, path) == [(2, "B"), (3, "C"), (4, "D"), (9, "Z")]
    assert versions.vacuum(spark, path, 2) and found(spark, path, 4)[-1] == (9, "z") and found(spark, path)[-1] == (9, "Z")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, f"{tmp_path}/none")


def test_two_writers_lose_nothing(spark, tmp_path):
    path, wrong = f"{tmp_path}/t", []
    versions.upsert(rows(spark, (0, "start")), path, "id", 2)

    def work(who):
        try:
            for i in range(4):
                versions.upsert(rows(spark, (100 * who + i, f"{who}"), (0, f"{who}")), path, "id")
                versions.append(rows(spark, (1000 * who + i, "more")), path)
        except Exception as e:
            wrong.append(e)

    threads = [threading.Thread(target=work, args=(who,)) for who in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = found(spark, path)
    assert not wrong and versions.latest(spark, path) == 17
    assert sorted(i for i, _ in got) == sorted([0, *(100 * w + i for w in (1, 2) for i in range(4)), *(1000 * w + i for w in (1, 2) for i in range(4))])


@pytest.mark.parametrize("at", ["written", "link_if_absent"])
def test_a_stop_leaves_the_last_version(spark, tmp_path, at, monkeypatch):
    path = f"{tmp_path}/t"
    versions.replace(rows(spark, (1, "a")), path)

    def stop(*_):
        raise KeyboardInterrupt

    for change in (lambda: versions.replace(rows(spark, (2, "b")), path), lambda: versions.append(rows(spark, (3, "c")), path), lambda: versions.append_history(rows(spark, (3, "c")), path, "id", "v")):
        with monkeypatch.context() as m:
            m.setattr(versions, at, stop)
            with pytest.raises(KeyboardInterrupt):
                change()
        assert found(spark, path) == [(1, "a")]
    versions.append(rows(spark, (3, "c")), path)
    assert found(spark, path) == [(1, "a"), (3, "c")]


def test_histories(spark, tmp_path):
    path = f"{tmp_path}/h"
    with pytest.raises(versions.Conflict):
        versions.append_history(rows(spark, (1, "a"), (1, "b")), path, "id", "v")
    with pytest.raises(versions.Conflict):
        versions.append_history(rows(spark, (1, "a"), (1, None)), path, "id", "v")
    assert versions.append_history(rows(spark, (1, "a"), (1, "a"), (2, None)), path, "id", "v") == 2
    assert versions.append_history(rows(spark, (1, "a"), (2, None), (3, "c")), path, "id", "v") == 1
    assert versions.append_history(rows(spark, (1, "a")), path, "id", "v") == 0
    with pytest.raises(versions.Conflict):
        versions.append_history(rows(spark, (4, "d"), (3, "other")), path, "id", "v")
    assert found(spark, path) == [(1, "a"), (2, None), (3, "c")]


class Sheet:
    """A target that counts how often a cell was changed, and stops before or after it has changed them."""

    def __init__(self, spark):
        self.spark, self.cells, self.times, self.stop = spark, {}, {}, None

    def apply(self, changes):
        if self.stop == "before":
            raise KeyboardInterrupt
        got = changes.collect()
        for r in got:
            self.cells[r["row"], r["col"]] = r["value"]
            self.times[r["row"], r["col"]] = self.times.get((r["row"], r["col"]), 0) + 1
        if self.stop == "after":
            raise KeyboardInterrupt
        return self.spark.createDataFrame([(r["row"], r["col"], True) for r in got if r["value"] != "lost"], "row string, col string, ok boolean")

    def look(self, keys):
        return self.spark.createDataFrame([(r["row"], r["col"], self.cells.get((r["row"], r["col"]))) for r in keys.collect()], "row string, col string, value string")


@pytest.mark.parametrize("stop", [None, "intended", "started", "before", "after", "applied"])
def test_cells_are_changed_once(spark, tmp_path, stop, monkeypatch):
    sheet, log = Sheet(spark), f"{tmp_path}/log"
    changes = spark.createDataFrame([("1", "H", "x"), ("2", "J", "y")], "row string, col string, value string")
    if stop in ("before", "after"):
        sheet.stop = stop
    with monkeypatch.context() as m:
        plain = intents.note

        def note(df, at, state):
            plain(df, at, state)
            if state == stop:
                raise KeyboardInterrupt

        m.setattr(intents, "note", note)
        try:
            intents.deliver(changes, 7, log, sheet.apply, sheet.look)
        except KeyboardInterrupt:
            assert stop
    sheet.stop = None
    for _ in range(2):
        out = intents.deliver(changes, 7, log, sheet.apply, sheet.look).collect()
        assert sorted((r["row"], r["col"], r["value"], r["state"]) for r in out) == [("1", "H", "x", "applied"), ("2", "J", "y", "applied")]
    assert sheet.times == {("1", "H"): 1, ("2", "J"): 1}
    with pytest.raises(ValueError, match="must not"):
        intents.deliver(spark.createDataFrame([("1", "Z", "x")], changes.schema), 8, log, sheet.apply)


def test_messages_without_a_receipt_are_uncertain(spark, tmp_path):
    sheet, log = Sheet(spark), f"{tmp_path}/log"
    sent = spark.createDataFrame([("m1", "message", "lost"), ("m2", "message", "hello")], "row string, col string, value string")
    run = lambda: {r["row"]: r["state"] for r in intents.deliver(sent, 1, log, sheet.apply, columns=["message"]).collect()}
    assert run() == run() == {"m1": "uncertain", "m2": "applied"} and set(sheet.times.values()) == {1}
    intents.resolve(spark, log, 1, "m1", "message", "intended")
    assert run() == {"m1": "uncertain", "m2": "applied"} and sheet.times["m1", "message"] == 2
    intents.resolve(spark, log, 1, "m1", "message", "applied")
    assert run()["m1"] == "applied"
    with pytest.raises(ValueError, match="uncertain"):
        intents.resolve(spark, log, 1, "m2", "message", "failed")
    sheet.stop = "after"
    with pytest.raises(KeyboardInterrupt):
        intents.deliver(sent, 2, log, sheet.apply, columns=["message"])
    sheet.stop = None
    assert {r["state"] for r in intents.deliver(sent, 2, log, sheet.apply, columns=["message"]).collect()} == {"uncertain"}


def plain(reports, moves, first):
    out = {}
    for key, _, report in sorted(reports, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0, r[2] or "")):
        state, n = out.get(key, (first, 0))
        new = moves.get(state, {}).get(report, state)
        out[key] = new, n + (new != state)
    return out


def test_machines_of_hot_keys(spark):
    rng = random.Random(4)
    known = [None, "odd", *{r for own in jobs.MOVES.values() for r in own}]
    reports = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None]), rng.choice([None, *range(300)]), rng.choice(known)) for _ in range(1500)]
    reports = list({(k, s): (k, s, r) for k, s, r in reports}.values())
    df = spark.createDataFrame(reports, "job string, seq int, report string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["job"]: (r["state"], r["steps"]) for r in jobs.replay(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(reports, jobs.MOVES, jobs.FIRST)
    assert machines.replayed(df.limit(0), "job", "seq", "report", jobs.MOVES, jobs.FIRST).count() == 0


def test_stream_in_event_order(spark, tmp_path):
    rng = random.Random(8)
    reports = [(f"k{k}", i, rng.choice(["send", "ok", "fail", "retry", "lost", "cancel", "resolve_retry"])) for k in range(5) for i in range(20)]
    want = {k: s for k, (s, _) in plain(reports, outbox.MOVES, outbox.FIRST).items()}
    mixed = [(k, i, r, 1_700_000_000 + 10 * i) for k, i, r in reports]
    rng.shuffle(mixed)
    end = [("end", 0, "none", 1_700_100_000), ("end", 1, "none", 1_700_200_000)]
    schema = "key string, seq long, report string, t long"
    for i, part in enumerate([mixed[:35], mixed[35:70], mixed[70:], end[:1], end[1:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    for k, v in outbox.STORE.items():
        spark.conf.set(k, v)
    states = {}

    def keep(batch, _):
        states.update({r["key"]: r["state"] for r in batch.collect()})

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in").withColumn("at", F.timestamp_seconds("t"))
    query = outbox.delivery_states(source, "1 hour").writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination(240)
    finally:
        query.stop()
        for k in outbox.STORE:
            spark.conf.unset(k)
    assert {k: s for k, s in states.items() if k != "end"} == want


def test_boxes_meet_in_cells(spark):
    rng = random.Random(2)
    boxes = []
    for i in range(400):
        x, y, w, h = rng.uniform(-50, 300), rng.uniform(-50, 300), rng.choice([0.3, 2, 8, 30, 200]), rng.choice([0.3, 4, 16, 90])
        boxes.append((rng.choice("pq"), i, x, y, x + w, y + h))
    boxes += [("p", 900, 0.0, 0.0, 8.0, 8.0), ("p", 901, 8.0, 0.0, 16.0, 8.0), ("p", 902, 4.0, 4.0, 4.0, 9.0), ("p", 903, None, 0.0, 1.0, 1.0), ("r", 904, 0.0, 0.0, 1e9, 1e-9)]
    df = spark.createDataFrame(boxes, "page string, id int, x0 double, y0 double, x1 double, y1 double")
    got = {(r["page"], r["a_key"], r["b_key"]): r["ratio"] for r in nearness.overlapping(df, df, "page", "id").filter("a_key < b_key").collect()}
    want = {}
    for p, i, *a in boxes:
        for q, j, *b in boxes:
            if p == q and i < j and None not in a + b:
                w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
                least = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
                if w > 0 and h > 0 and least > 0:
                    want[p, i, j] = w * h / least
    assert got == pytest.approx(want) and len(want) > 500
    assert nearness.overlapping(df.limit(0), df, "page", "id").count() == 0


def test_hashes_meet_by_parts(spark):
    rng = random.Random(3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    bases = [rng.getrandbits(64) for _ in range(40)]
    hashes = [rng.choice(bases) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(260)] + bases[:5] * 2
    data = [(i, signed(h), rng.randint(0, 9)) for i, h in enumerate(hashes)] + [(1000, None, 1), (1001, None, 0)]
    df = spark.createDataFrame(data, "id int, h long, priority int")
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    got = {(r["a_key"], r["b_key"]): r["distance"] for r in nearness.near_hashes(df, df, [], "id", "h").filter("a_key < b_key").collect()}
    some = data[:-2]
    assert got == {(i, j): near(a, b) for i, a, _ in some for j, b, _ in some if i < j and near(a, b) <= 5}
    kept = []
    for i, h, _ in sorted(some, key=lambda r: (-r[2], r[0])):
        if not any(near(h, k) <= 5 for _, k in kept):
            kept.append((i, h))
    found_ = {r["id"] for r in nearness.first_kept(df, "id", [-F.col("priority")], "h").filter("kept").collect()}
    assert found_ == {i for i, _ in kept} | {1000, 1001}
    assert nearness.first_kept(df.limit(0), "id", [F.col("priority")], "h").count() == 0
