"""Rules, trees, answers, settings and sinks of reviews on rows made by hand."""

from __future__ import annotations

import csv
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern import settings
from lectern.operators import jobs, model, online, overview, records, trees, visual
from lectern.sinks import tables
from lectern.sources import bundles, paged, sheet


def test_records(spark):
    rows = [(1, records.HEADER), (2, ["1", " T ", '{"text":"x","link":"https://h/wiki/abc_1"}', "w", "@a", "人工 ＋ai", "", "已驳回", "2", "45000.5", "2024-01-02T03:04:05", "", "", "o"]), (3, ["9"]), (4, []), (5, ["1", "t", "https://h/wiki/n1/", "w", "a", "ai", "", "AI审稿中", "", "", "", "", "", "o"]), (6, ["1", "t", "", "", "", "", "", "", "1.5"]), (7, ["1", '[{"text":"a"},{"name":"b"}]', "", "", "", "", "", "", "-1"]), (8, ["1", "t", "", "", "", "", "", "", "1e12"]), (9, ["1", "t", "", "", "", "", "", "", "x"])]
    out = {r["row_no"]: r for r in records.records_of(spark.createDataFrame(rows, "row_no int, cells array<string>")).withColumn("eligible", records.eligible()).collect()}
    assert sorted(out) == [2, 5, 6, 7, 8, 9] and out[8]["error"] == out[9]["error"] == "illegal_round" and out[8]["round"] is None
    r = out[2]
    assert (r["title"], r["method"], r["status"], r["round"], r["node"], r["updated"], r["reviewed"]) == ("T", "人工+AI", "已拒稿", 2, "abc_1", "2023/03/15 12:00:00", "2024/01/02 03:04:05")
    assert out[5]["eligible"] and out[5]["node"] == "n1" and out[5]["round"] == 0 and out[5]["link"] == "https://h/wiki/n1"
    assert out[6]["error"] == out[7]["error"] == "illegal_round" and out[7]["title"] == "ab" and not out[6]["eligible"]
    with pytest.raises(ValueError, match="header"):
        records.records_of(spark.createDataFrame([(1, ["x"])], "row_no int, cells array<string>"))


def test_jobs(spark):
    stories = {"a": ["start", "reviewed", "write", "written", "commit", "start"], "b": ["start", "fail", "start", "stale", "commit"], "c": ["commit", "nothing"], "d": ["cancel", "start"], "e": ["start", "reviewed", "written", "stale"]}
    rows = [(k, i, r) for k, v in stories.items() for i, r in enumerate(v)]
    got = {r["job"]: (r["state"], r["steps"]) for r in jobs.replay(spark.createDataFrame(rows, "job string, seq int, report string").repartition(3)).collect()}
    want = {}
    for k, v in stories.items():
        state, n = jobs.FIRST, 0
        for r in v:
            n, state = n + (jobs.after(state, r) != state), jobs.after(state, r)
        want[k] = (state, n)
    assert got == want and want["a"] == ("committed", 5) and want["b"] == ("obsolete", 4)
    some = spark.createDataFrame([("a", "n", "queued", "x"), ("b", "m", "committed", "x"), ("c", "n", "reviewed", None)], "id string, node string, status string, why string")
    done = {r["id"]: (r["status"], r["obsolete_reason"]) for r in jobs.obsolete(some, F.col("why")).collect()}
    assert done == {"a": ("obsolete", "x"), "b": ("committed", None), "c": ("reviewed", None)}
    assert [r["node"] for r in jobs.pending(some).collect()] == ["n"]
    control = spark.createDataFrame([("n", 1, True, "old"), ("m", 2, True, "same")], "node string, cycle int, handoff boolean, reset_marker string")
    asked = spark.createDataFrame([("n", "new", True), ("m", "same", True), ("k", "first", True), ("z", "x", False)], "node string, marker string, reset boolean")
    assert {tuple(r) for r in jobs.reset_cycles(asked, control).collect()} == {("n", 2, False, "new"), ("m", 2, True, "same"), ("k", 1, False, "first")}
    pages = spark.createDataFrame([("d", i, p) for i, p in enumerate([3, 1, 3, 9, 2, 4, 5, 6, 7, 8])], "doc string, pos int, page int")
    assert jobs.key_pages(pages, "doc", "pos", "page", F.lit(1)).first()["pages"] == [1, 3, 9, 2, 4, 5, 6, 7]
    why = jobs.stale_reason(review_cycle_changed=F.lit(True), document_version_changed=F.lit(True))
    assert spark.range(1).select(why).first()[0] == "document_version_changed"
    calls = spark.createDataFrame([("r", 1, "final", "m1"), ("r", 2, "final_repair", "m2"), ("r", 3, "other", "m3")], "run string, seq int, phase string, model string")
    assert jobs.latest_model(calls, "run", "final").collect()[0]["model"] == "m2"


def test_overviews(spark):
    rows = spark.createDataFrame([("飞控固件 的标定 250 V", "飞控固件标定", ["飞控", "GPS"], "sum"), ("", "x", [], ""), ("无关", "飞控", [], "无关"), ("建议修改 飞控", "飞控" * 200, [], "")], "content string, source string, items array<string>, summary string")
    none = F.array().cast("array<string>")
    e, w = overview.retrieval_messages(F.col("content"), F.col("source"), F.col("items"), none, F.length("source"))
    got = [(list(r[0]), list(r[1])) for r in rows.select(e, w).collect()]
    assert got == [([], ["ungrounded_technical_entity:GPS"]), (["retrieval_overview_content_empty"], []), (["retrieval_overview_not_grounded_in_source"], []), (["retrieval_overview_contains_review_language"], ["retrieval_overview_short_for_source"])]
    seen = F.array(F.struct(F.lit("标定").alias("document_id"), F.lit("无关").alias("title")))
    m, s = overview.article_messages(F.col("content"), F.col("source"), F.col("summary"), F.col("items"), none, seen, F.length("source"))
    got = [(list(r[0]), r[1]) for r in rows.select(m, s).collect()]
    assert got[0] == (["ungrounded_technical_entity:GPS"], "invalid") and got[2][0] == ["article_overview_equals_review_summary", "candidate_title_contamination:无关"] and got[3] == ([], "valid")


def block(name, kind=2, text="", **more):
    return {"block_id": name, "block_type": kind, "text": {"elements": [{"text_run": {"content": text}}] if text else []}} | more


def test_trees(spark):
    good = [block("d", 1, children=["h", "l", "t"]), block("h", 5, "Head"), block("l", 12, "item", children=["k"]), block("k", 2, "kid"), block("t", 31, table={"property": {"column_size": 2}, "cells": ["c1", "c2"]}), block("c1", 32, parent_id="t", children=["x"]), block("c2", 32, parent_id="t"), block("x", 2, "a|b")]
    broken = {
        "blocks_unavailable": [],
        "block_child_missing": [block("d", 1, children=["no"])],
        "blocks_root_missing": [block("a", children=["b"]), block("b", children=["a"])],
        "blocks_duplicate_or_cycle": [block("d", 1, children=["a", "a"]), block("a", text="x")],
        "unreachable_document_blocks": [block("d", 1), block("a", text="x", parent_id="gone")],
        "table_cells_incomplete": [block("d", 1, children=["t"]), block("t", 31, table={"column_size": 2}, children=["c"]), block("c", 32)],
        "unsupported_empty_block_quote": [block("d", 1, children=["q"]), block("q", 15)],
        "blocks_depth_exceeded": [block(f"n{i}", 2, "x", children=[f"n{i + 1}"] if i < 70 else []) for i in range(71)],
    }
    docs = spark.createDataFrame([(k, json.dumps(v)) for k, v in broken.items()] + [("d", json.dumps(good)), ("n", None)], "doc string, blocks string")
    rows = trees.flattened(docs, "doc", "blocks").collect()
    assert {r["doc"]: r["error"] for r in rows if r["error"]} == {k: k for k in broken} | {"n": "blocks_unavailable"}
    flat = sorted((r for r in rows if r["doc"] == "d"), key=lambda r: r["pos"])
    assert [(r["type"], r["level"], r["text"]) for r in flat] == [("heading", 3, "Head"), ("list", None, "item"), ("paragraph", None, "kid"), ("table", None, "| a\\|b |  |\n| --- | --- |")]


def parts(spark, **docs):
    rows = trees.flattened(spark.createDataFrame([(k, v if v is None or isinstance(v, str) else json.dumps(v), 1) for k, v in docs.items()], "doc string, blocks string, pos int"), "doc", "blocks").collect()
    return {k: [(r["type"], r["level"], r["text"]) if r["error"] is None else r["error"] for r in sorted((r for r in rows if r["doc"] == k), key=lambda r: r["pos"])] for k in docs}


def test_tree_shapes(spark):
    table = {"block_id": "t", "block_type": 31, "table": {"cells": ["a", "b"], "column_size": 1}}
    inner = {"block_id": "i", "block_type": 31, "parent_id": "a", "table": {"property": {"column_size": "1"}}}
    got = parts(
        spark,
        nested=[block("d", 1, children=["t"]), table, block("b", 32, "b", parent_id="t"), block("a", 32, "own", parent_id="t"), inner, block("c", 32, "x\ny", parent_id="i")],
        sheet=[{"block_id": "s", "type": "sheet", "sheet": {"token": "a_b", "rows": [["h", "k|"], [1]]}}, {"block_id": "f", "type": "file", "file": {"name": "a.zip"}}, {"block_id": "g", "type": "media"}, block("p", 27), block("q", 27, "seen")],
        empty=[block("d", 1, children=["t"]), {"block_id": "t", "block_type": 31, "table": {"column_size": 2}, "children": ["a", "b"]}, block("a", 32), block("b", 32)],
        lists=[block("d", 1, children=["h", "l"]), block("h", 11, "deep"), block("l", 13, "one", children=["m"]), block("m", 15, "said")],
    )
    assert got["nested"] == [("table", None, "| own<br>\\| x<br>y \\|<br>\\| --- \\| |\n| --- |\n| b |")]
    assert got["sheet"] == [("table", None, "| h | k\\| |\n| --- | --- |\n| 1 |  |"), ("paragraph", None, "[附件元数据：a.zip；内容未打开]"), ("paragraph", None, "[附件元数据：未命名附件；内容未打开]"), ("image", None, "原始图片见 source.pdf"), ("image", None, "seen")]
    assert got["empty"] == [("table", None, "|  |  |\n| --- | --- |")]
    assert got["lists"] == [("heading", 6, "deep"), ("list", None, "one"), ("quote", None, "said")]


def test_trees_of_any_json(spark):
    root = block("d", 1, children=["a"])
    got = parts(
        spark,
        nulls=[{"block_id": "d", "block_type": 1, "children": None, "table": None, "text": None}, {"block_id": "a", "parent_id": "d", "children": [], "text": {"elements": None}, "x": [{"text_run": {"content": "t"}}, None, 3]}],
        width=[root, {"block_id": "a", "block_type": 31, "table": {"column_size": "wide"}, "children": ["c"]}, block("c", 32)],
        strings=["a", "b"], number="7", broken="{", nothing=None, few="[]", object='{"block_id": "d"}',
        loop=[root, block("a", text="x", children=["b"]), block("b", text="y", children=["a"])],
        apart=[root, block("a", text="x"), block("b", text="y", children=["c"]), block("c", text="z", children=["b"])],
        below=[root, block("a", text="x"), block("b", text="y", parent_id="lost"), block("c", text="z", parent_id="b")],
        again=[root, block("a", text="x"), block("a", text="y")],
        odd=[root, {"block_id": "a", "block_type": {"x": 1}, "children": "b", "text": {"text_run": {"content": 5}}}],
        cell=[root, {"block_id": "a", "block_type": 31, "table": {"cells": ["no"], "column_size": 1}}],
        sheet=[root, {"block_id": "a", "block_type": 30, "sheet": {"token": "x"}}], bitable=[root, {"block_id": "a", "block_type": 18, "bitable": {"token": "x_y"}}],
        deep=[block("d", 1, children=["n0"]), *[block(f"n{i}", text="x", children=[f"n{i + 1}"] if i < 200 else []) for i in range(201)]],
        edge=[block("n0", 1, children=["n1"]), *[block(f"n{i}", text="x", children=[f"n{i + 1}"] if i < 64 else []) for i in range(1, 65)]],
    )
    assert got["nulls"] == [("paragraph", None, "t")] and got["odd"][0][2] == "5"
    want = {"width": "table_structure_missing", "strings": "block_malformed", "number": "blocks_unavailable", "broken": "blocks_unavailable", "nothing": "blocks_unavailable", "few": "blocks_unavailable", "loop": "blocks_duplicate_or_cycle", "apart": "unreachable_document_blocks", "below": "unreachable_document_blocks", "again": "unreachable_document_blocks", "cell": "table_cell_missing", "sheet": "embedded_sheet_token_invalid", "bitable": "embedded_bitable_unavailable", "deep": "blocks_depth_exceeded"}
    assert {k: got[k] for k in want} == {k: [v] for k, v in want.items()}
    assert len(got["edge"]) == 64
    assert trees.flattened(spark.createDataFrame([], "doc string, blocks string"), "doc", "blocks").count() == 0


def test_texts_below_a_value(spark):
    old = '{"block_type": "text", "text": {"elements": [{"text_run": {"content": "a"}}, {"equation": {"content": "e"}}]}, "table": {"x": {"text_run": {"content": "no"}}}, "children": [{"text_run": {"content": "kid"}}]}'
    rows = spark.createDataFrame([(1, old), (2, "{}"), (3, None)], "i int, j string").select("i", F.try_parse_json("j").alias("v"))
    assert [tuple(r) for r in trees.plain_texts(rows, "v").collect()] == [(1, "kida")]
    assert [tuple(r) for r in trees.texts(rows, "v").collect()] == [(1, "noae")]


def test_answers(spark):
    canned = spark.createDataFrame([("a", "R", None, None, "O", None, None, ["b0"]), ("b", None, "RAW", None, None, "ORAW", None, None), ("c", None, None, "timeout", None, None, "odd", None)], "case string, review string, raw string, raise string, overview string, overview_raw string, overview_raise string, visual_batches array<string>")
    asked = spark.createDataFrame([(c, i, p, [i]) for c in "abcd" for i, p in enumerate(["retrieval_overview", "visual_batch", "visual_batch", "final"])], "case string, seq int, phase string, pages array<int>")
    got = {(r["case"], r["seq"]): (r["content"], r["error"], r["retryable"]) for r in model.answers(asked, canned).collect()}
    assert got["a", 0][0] == "O" and got["a", 1][0] == "b0" and json.loads(got["a", 2][0])["pages_reviewed"] == [2] and got["a", 3] == ("R", None, False)
    assert got["b", 0][0] == "ORAW" and got["b", 3][0] == "RAW"
    assert got["c", 0] == (None, "model_call_error", False) and got["c", 3] == (None, "model_timeout", True) and got["d", 3] == (None, "model_call_error", False)
    asked = spark.createDataFrame([("a", 0, "final", "飞x")], "case string, seq int, phase string, prompt string")
    pages = spark.createDataFrame([("a", 0, 5), ("a", 0, 7)], "case string, seq int, byte_size long")
    assert tuple(model.request_summary(asked, pages).first()) == ("a", 0, "final", 2, 2, 12)
    trace = spark.createDataFrame([("r", 1, "x", "completed"), ("r", 2, "y", "failed"), ("s", 1, "x", "failed"), ("s", 2, "x", "completed")], "run string, seq int, node string, status string")
    assert [tuple(r) for r in model.resume_from(trace).collect()] == [("r", "y")]
    assert model.strict_schema({"type": "object", "properties": {"a": {"type": "object", "properties": {"b": {}}}}})["properties"]["a"] == {"type": "object", "properties": {"b": {}}, "additionalProperties": False, "required": ["b"]}


def test_pictures(spark):
    rng = np.random.default_rng(1)
    flat, noise = np.full((40, 60, 3), 200, np.uint8), rng.integers(0, 256, (40, 60, 3)).astype(np.uint8)
    ramp = np.repeat(np.linspace(255, 0, 60).astype(np.uint8)[None, :, None], 40, 0).repeat(3, 2)
    rows = spark.createDataFrame([(i, a.tobytes(), 60, 40) for i, a in enumerate([flat, noise, ramp])], "i int, p binary, w int, h int")
    got = [tuple(r) for r in rows.orderBy("i").select(visual.difference_hash("p", "w", "h"), visual.near_solid("p", "w", "h")).collect()]
    assert got[0] == (0, True) and got[2] == (-1, False) and not got[1][1]
    near = spark.createDataFrame([("see the 电路图",), ("a screenshot GUI",), ("x",)], "t string")
    assert [tuple(r) for r in near.select(visual.picture_priority(F.col("t")), visual.picture_required(F.col("t"), F.lit(0.1)), visual.diagram_priority(F.col("t"))).collect()] == [(90, True, 100), (70, True, 85), (40, False, 85)]
    lines = spark.createDataFrame([("第 3 页",), ("12",), (" Head er ",), ("text",), ("\x01",)], "t string")
    assert [r[0] for r in lines.select(visual.body_line(F.col("t"), F.array(F.lit("header")))).collect()] == [False, False, False, True, False]
    rows = spark.createDataFrame([("d", i, b, w, a) for i, (b, w, a) in enumerate([(4, True, 1.0), (4, True, 1.0), (1, False, 2.0)])], "doc string, id long, bytes long, whole boolean, aspect double")
    assert visual.within_budget(rows, "doc", "id", "bytes", [F.col("id")], 9, 99, "whole", 1).first()["selected"] == [0, 2]
    assert visual.unlike(rows.withColumn("h", F.lit(0).cast("long")), "doc", "id", "h", [F.col("id")], aspect="aspect").first()["kept"] == [0, 2]
    blocks, extra = spark.createDataFrame([("d", "a| b")], "doc string, markdown string"), spark.createDataFrame([("d", 1, "A |B"), ("d", 2, "c")], "doc string, page int, table string")
    assert [r["page"] for r in visual.missing_tables(extra, blocks, "doc").collect()] == [2]


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"similarity_top_k": 7, "max_pdf_pages": 9, "enable_admin_notify": False}))
    s = settings.load(path, {"SIMILARITY_TOP_N": "8", "MAX_PDF_BYTES": "5", "API_KEY": "secret", "ENABLE_ADMIN_NOTIFY": "Yes"})
    assert (s.similarity_top_k, s.similarity_top_n, s.max_pdf_pages, s.max_pdf_bytes, s.enable_admin_notify, s.similarity_threshold) == (8, 8, 9, 5, True, 0.35)
    assert s.redacted()["api_key_present"] and "secret" not in str(s.redacted()) + repr(s)
    for bad in ({"SIMILARITY_TOP_K": "0"}, {"REASONING_EFFORT": "odd"}, {"RETRIEVAL_OVERVIEW_MIN_CHARS": "2000"}):
        with pytest.raises(ValueError):
            settings.load(None, bad)


def test_sinks(spark, tmp_path):
    a, b = (spark.createDataFrame([(i, v) for i in range(20)], "id int, v string") for v in "xy")
    path = f"{tmp_path}/once"
    assert tables.write_once(a, path) and not tables.write_once(a.repartition(3), path)
    with pytest.raises(tables.Conflict):
        tables.write_once(b, path)
    out, errors = f"{tmp_path}/snap", f"{tmp_path}/errors"
    assert {r["name"]: r["rows"] for r in tables.publish({"a": a, "b": b}, out, errors).collect()} == {"a": 20, "b": 20} and tables.verify(spark, out) == []
    a.write.mode("overwrite").parquet(f"{out}/b")
    assert tables.verify(spark, out) == ["b"]

    def refuse(folder):
        raise ValueError("not whole")

    with pytest.raises(ValueError, match="not whole"):
        tables.publish({"a": a}, f"{tmp_path}/other", errors, refuse)
    assert not tables.exists(spark, f"{tmp_path}/other") and tables.exists(spark, errors)
    for seq, code in ((1, "x"), (2, "y")):
        tables.record_errors(spark.createDataFrame([("scan", "n", code, seq)], "action string, node string, code string, seq int"), f"{tmp_path}/err")
    assert [(r["node"], r["code"]) for r in tables.current_errors(spark, f"{tmp_path}/err").collect()] == [("n", "y")]


def test_bundles(spark, tmp_path):
    def put(case, **files):
        (tmp_path / case).mkdir()
        for name, value in files.items():
            (tmp_path / case / f"{name}.json").write_text(value if isinstance(value, str) else json.dumps(value))

    put("one", source_document={"case_id": "one", "document_id": "d1", "review_round": 0, "previous_issues": [{"problem": "p"}, {"issue_id": "k", "level": "minor"}]}, document_blocks={"blocks": [{"type": "text"}]}, mock_llm_result={"behavior": "return", "response": {"result": "pass"}, "visual_batches": [{"x": 1}]}, mock_overview_result={"behavior": "raise", "error_type": "timeout"}, similarity_candidates={"candidates": [{"title": "t"}]})
    put("two", source_document={"case_id": "two", "document_id": "d2"}, document_blocks=[{"type": "text"}], fake_model_response={"review": {"article_overview": {"content": "c"}}}, attachment_metadata=[{"name": "f"}])
    put("three", source_document={"case_id": "three", "document_id": "d3"}, document_blocks="{broken", mock_llm_result={"behavior": "raw"})
    put("four", source_document={"case_id": "four", "document_id": "d4"})
    out = {r["case"]: r for r in bundles.bundles(spark, str(tmp_path)).collect()}
    one = out["one"]
    assert json.loads(one["review"]) == {"result": "pass"} and one["overview_raise"] == "timeout" and one["overview"] is None and json.loads(one["candidates"]) == [{"title": "t"}] and one["error"] is None
    previous = json.loads(one["previous_review"])
    assert [(i["issue_id"], i["level"]) for i in previous["issues"]] == [("previous-1", "major"), ("k", "minor")] and previous["review_round"] == 1
    assert json.loads(out["two"]["overview"]) == {"content": "c"} and json.loads(out["two"]["attachments"]) == [{"name": "f"}] and json.loads(out["two"]["blocks"]) == [{"type": "text"}]
    assert out["three"]["error"] == out["four"]["error"] == "document_blocks.json" and out["three"]["raw"] == ""


def test_sync_keys(spark):
    from lectern.operators import sync

    row = "row_id long, node string, obj string, link string, title string, author string, wiki string, status string, published string"
    rows = spark.createDataFrame([(1, "n1", "o1", "l1", "A", "x", "w", "s", ""), (2, "n2", "o1", "", "A  b", "@x", "w", "s", ""), (3, "n3", "", "", "c", "y", "w", "s", ""), (4, "", "", "l9", None, None, "v", "已拒稿", ""), (5, "n5", "", "", "q", "q", "v", "s", ""), (6, "n6", "", "", "q", "q", "u", "s", "")], row)
    doc = "doc string, node string, obj string, link string, title string, author string, wiki string"
    docs = spark.createDataFrame([("by node", "n1", "zz", "", "", "", ""), ("by obj", "nx", "o1", "", "", "", ""), ("by link", "", "ox", "l9", "c", "y", "w"), ("by title", None, None, None, " a　B", "x", "w"), ("none", "", "new", "", "?", "", ""), ("no obj", "", "", "", "!", "", ""), ("move", "n3", "o", "", "", "", "elsewhere")], doc)
    got = {r["doc"]: (r["level"], r["row_id"], r["found"], r["ambiguous"]) for r in sync.matches(docs, rows).collect()}
    assert got == {"by node": (1, 1, 1, False), "by obj": (2, 1, 2, True), "by link": (3, 4, 1, False), "by title": (4, 2, 1, False), "move": (1, 3, 1, False)}
    scans = spark.createDataFrame([("v", True), ("v", True), ("u", True), ("u", False), ("w", True)], "wiki string, ok boolean")
    plan = {(r["action"], r["doc"], r["row_id"]) for r in sync.merge_plan(docs, rows, sync.scanned_wikis(scans)).collect()}
    assert plan == {("move", "by node", 1), ("ambiguous", "by obj", None), ("move", "by link", 4), ("update", "by title", 2), ("insert", "none", None), ("move", "move", 3), ("removed", None, 2), ("removed", None, 5)}
    assert sync.merge_plan(docs.limit(0), rows.limit(0), scans.limit(0)).count() == 0


def test_bytes_that_are_no_text(spark, tmp_path):
    for case, blocks in (("good", b"[]"), ("bad", b"\xff\xfe[]"), ("none", None)):
        (tmp_path / case).mkdir()
        (tmp_path / case / "source_document.json").write_bytes(b'{"case_id": "x", "title": "t"}' if case != "none" else b"\xff")
        if blocks is not None:
            (tmp_path / case / "document_blocks.json").write_bytes(blocks)
    got = {r["case"]: (r["title"], r["blocks"], r["error"]) for r in bundles.bundles(spark, str(tmp_path)).collect()}
    assert got == {"good": ("t", "[]", None), "bad": ("t", None, "document_blocks.json"), "none": (None, None, "source_document.json")}


def test_digests(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = {'{"b": [1, 2.0, {"z": null, "a": "飞\\n"}], "a": true}': '{"a": true, "b": [1, 2.0, {"a": "飞\\n", "z": null}]}', '"\\u98de"': '"飞"', "[]": "[]", "{x": None}
    rows = spark.createDataFrame(list(texts), "string").select("value", records.text_digest(F.col("value")).alias("d")).collect()
    assert {r["value"]: r["d"] for r in rows} == {k: None if v is None else sha(v) for k, v in texts.items()}
    mixed = spark.range(1).select(F.struct(F.lit("y").alias("b"), F.create_map(F.lit("k"), F.lit(1), F.lit("c"), F.lit(2)).alias("a"), F.lit(None).cast("string").alias("0")).alias("s"))
    assert mixed.select(records.digest(F.col("s"))).first()[0] == sha('{"0": null, "a": {"c": 2, "k": 1}, "b": "y"}')


def test_pages(spark, tmp_path):
    put = lambda name, items, following: (tmp_path / f"{name}.json").write_text(json.dumps({"items": items, "next": following}))
    record = lambda i: {"fields": {"a": f"v{i}", "n": i} if i % 2 else {"b": "é"}}
    put("first", [record(0), record(1)], "x")
    put("x", [], "y")
    put("y", [record(2)], "z")
    rows = paged.read_pages(spark, str(tmp_path))
    assert [(r["page"], r["pos"]) for r in rows.orderBy("page", "pos").collect()] == [(0, 0), (0, 1), (2, 0)]
    sheet_rows = sorted(tuple(r) for r in paged.as_rows(rows, ["a", "b", "n"]).collect())
    assert sheet_rows == [(1, ["a", "b", "n"]), (2, ["", "é", ""]), (3, ["v1", "", "1"]), (4, ["", "é", ""])]

    def run():
        query = paged.stream_pages(spark, f"file://{tmp_path}").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        query.awaitTermination(120)
        query.stop()
        return sorted((r["page"], r["pos"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [(0, 0), (0, 1), (2, 0)]
    put("z", [record(3), record(4)], None)
    assert run() == run() == [(0, 0), (0, 1), (2, 0), (3, 0), (3, 1)]
    put("z", [record(3)], "x")
    with pytest.raises(Exception, match="RepeatedCursor"):
        paged.read_pages(spark, str(tmp_path)).count()
    assert paged.read_pages(spark, str(tmp_path), "none").count() == 0


def test_ranges_seek(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sheet, "ROWS", 7)
    want = [[f"{i}", f"line\n{i}" if i % 3 else f'say "{i}"', "飞"] for i in range(30)] + [["", "", ""]] * 3
    with open(tmp_path / "s.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows(want)
    found = sheet.ranges(f"{tmp_path}/s.csv")
    assert [r.first for r in found] == [0, 7, 14, 21, 28] and found[-1].end == (tmp_path / "s.csv").stat().st_size
    got = {r["row_no"]: r["cells"] for r in sheet.read_sheet(spark, f"{tmp_path}/s.csv", 4).collect()}
    assert got == {i + 1: [*row, ""] for i, row in enumerate(want[:30])}
    (tmp_path / "none.csv").write_text("")
    assert sheet.read_sheet(spark, f"{tmp_path}/none.csv").count() == 0


def test_published_articles(spark):
    schema = "document_id string, content string, source_content_hash string, source_updated_at string"
    entries = spark.createDataFrame([("a", "A", "h", "1", True, True), ("b", "B", "h", "1", True, False), ("c", "C", "h", "1", False, True)], f"{schema}, eligible boolean, publication_confirmed boolean")
    new = spark.createDataFrame([("a", "A2", "h", "2"), ("a", "A3", "h", "3"), ("d", "D", "h", "1"), ("e", " \u3000", "h", "1"), ("f", "F", "", "1"), ("g", "G", None, "1")], schema)
    ids = lambda df: sorted((r["document_id"], r["content"]) for r in df.collect())
    assert ids(online.visible(entries)) == [("a", "A")] and ids(online.visible(entries, F.lit("a"))) == []
    after = online.published(entries, new)
    assert ids(after) == [("a", "A3"), ("b", "B"), ("c", "C"), ("d", "D")] and ids(online.visible(after)) == [("a", "A3"), ("d", "D")]
    assert ids(online.published(entries, new, overwrite=False)) == [("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")]
    valid = spark.createDataFrame([("a", "3"), ("d", "9"), ("c", "1"), ("b", "1")], "document_id string, version string")
    assert ids(online.visible(online.invalidated(after, valid))) == [("a", "A3"), ("c", "C")]
    put = lambda key, own: (key, json.dumps({"article": {"document_id": own, "content": "old", "source_content_hash": "h", "source_updated_at": "0"}, "eligible": True}))
    legacy = lambda *rows: spark.createDataFrame(list(rows), "key string, payload string")
    made, archive = online.migrated(legacy(put("a", "a"), put("z", "z")), entries, schema)
    assert ids(made) == [("a", "A"), ("b", "B"), ("c", "C"), ("z", "old")] and archive.count() == 2 and ids(online.visible(made)) == [("a", "A")]
    with pytest.raises(ValueError, match="another document"):
        online.migrated(legacy(put("a", "a"), put("y", "z")), entries, schema)
