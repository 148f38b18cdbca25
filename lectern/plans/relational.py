"""Sheets, index, journal, outbox and verdict rows as relational plans.

The test tables stand in for the review's own: orders are submissions (o_custkey the author), lineitem rows are issues or
parts of deliveries, customers are the directory, events are the journal (event_type the kind, user_id the key, event_id
the order), parts are nodes. Each text runs unchanged on Spark and as the other engine's SQL.
"""

from __future__ import annotations

#: Submissions with the fields of a sheet row.
SHEET = """sheet AS (SELECT o_orderkey AS row_id, o_custkey AS author, o_orderkey % 7 AS round_no,
  CASE o_orderkey % 4 WHEN 0 THEN 'AI' WHEN 1 THEN '人工+AI' WHEN 2 THEN '人工' ELSE '' END AS method,
  CASE o_orderkey % 9 WHEN 0 THEN '已投稿' WHEN 1 THEN '待分配人工审稿' WHEN 2 THEN '人工审稿中' WHEN 3 THEN 'AI审稿中' WHEN 4 THEN '需修改'
    WHEN 5 THEN '已修改待复审' WHEN 6 THEN 'AI通过待确认' WHEN 7 THEN '已移出待审核' ELSE '已拒稿' END AS status,
  CASE WHEN o_orderkey % 11 = 0 THEN '2024/01/01' ELSE '' END AS published, CASE WHEN o_orderkey % 3 = 0 THEN 'r' ELSE '' END AS reviewer,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'n' || cast(o_orderkey AS string) END AS node, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'o' || cast(o_custkey AS string) END AS obj,
  o_orderdate AS updated, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 < 3 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate + INTERVAL 1 DAY END AS reviewed FROM {orders})"""

#: Issues with a level and a category, some of them unknown.
ISSUES = """issues AS (SELECT l_orderkey AS doc, l_linenumber AS pos, l_partkey AS part_id,
  CASE WHEN l_quantity < 4 THEN 'blocking' WHEN l_quantity < 15 THEN 'major' ELSE 'minor' END AS raw_level,
  CASE l_suppkey % 6 WHEN 0 THEN 'format' WHEN 1 THEN 'content_placeholder' WHEN 2 THEN 'fabricated_content' WHEN 3 THEN 'safety' WHEN 4 THEN 'novel_kind' ELSE 'structure' END AS raw_category,
  CASE l_partkey % 3 WHEN 0 THEN '标题 1' ELSE '正文' END AS position, CASE l_partkey % 5 WHEN 0 THEN '【表格】缺失' ELSE '内容' END AS problem FROM {lineitem})"""

#: Rules on single issues: unknown categories, heading format, table placeholders.
RULED = """known AS (SELECT *, CASE WHEN raw_category IN ('format', 'structure', 'correctness', 'reproducibility', 'safety', 'placement', 'similarity', 'visibility', 'learning_trace',
    'content_sufficiency', 'content_placeholder', 'visual_content_missing', 'sensitive_content_review', 'ai_generation_artifact', 'ai_generated_without_personal_trace',
    'ai_revision_padding', 'fabricated_content', 'other') THEN raw_category ELSE 'other' END AS c FROM issues),
ruled AS (SELECT doc, pos, part_id, CASE WHEN c = 'format' AND contains(position, '标题') OR c = 'content_placeholder' AND contains(problem, '【表格】') THEN 'minor' ELSE raw_level END AS level,
  CASE WHEN c = 'content_placeholder' AND contains(problem, '【表格】') THEN 'format' ELSE c END AS category FROM known)"""

COUNTS = """counts AS (SELECT doc, count(*) FILTER (WHERE level = 'blocking') AS blocking_count, count(*) FILTER (WHERE level = 'major') AS major_count, count(*) FILTER (WHERE level = 'minor') AS minor_count,
  coalesce(bool_or(level = 'blocking' AND category IN ('ai_generation_artifact', 'ai_generated_without_personal_trace', 'ai_revision_padding', 'fabricated_content')), false) AS direct_reject FROM ruled GROUP BY doc)"""

#: What the model asked for and what it saw, by submission.
ASKED = """asked AS (SELECT o_orderkey AS doc, CASE o_orderkey % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'need_revision' WHEN 2 THEN 'recommend_human_review' WHEN 3 THEN 'incomplete_review' ELSE 'reject' END AS requested,
  o_orderkey % 10 <> 0 AS visual_complete, o_orderkey % 23 = 0 AS truncated, CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS missing_sources, o_orderkey % 3 = 0 AS rereview,
  CASE o_orderkey % 6 WHEN 0 THEN 'no_similar' WHEN 1 THEN 'related_but_keep' WHEN 2 THEN 'merge_recommended' WHEN 3 THEN 'duplicate_reject_recommended' WHEN 4 THEN 'same_area_different_direction' ELSE 'not_applicable' END AS raw_similarity,
  o_custkey % 4 AS raw_candidates, o_custkey % 4 AS effective_candidates, o_orderkey % 7 AS round_no FROM {orders})"""

VERDICTS = f"""WITH {ISSUES}, {RULED}, {COUNTS}, {ASKED},
sim AS (SELECT *, CASE WHEN rereview THEN 'not_applicable' WHEN effective_candidates = 0 THEN 'no_similar' ELSE raw_similarity END AS similarity,
  CASE WHEN rereview OR effective_candidates = 0 THEN 0 ELSE raw_candidates END AS candidate_count, NOT visual_complete OR truncated OR missing_sources > 0 AS incomplete FROM asked),
decided AS (SELECT s.*, coalesce(blocking_count, 0) AS blocking_count, coalesce(major_count, 0) AS major_0, coalesce(minor_count, 0) AS minor_count, coalesce(direct_reject, false) AS direct_reject,
  CASE similarity WHEN 'merge_recommended' THEN 'merge_required' WHEN 'duplicate_reject_recommended' THEN 'reject_independent_submission' ELSE 'keep_independent' END AS decision FROM sim s LEFT JOIN counts USING (doc)),
first_outcome AS (SELECT *, CASE WHEN incomplete AND requested IN ('pass', 'reject') THEN 'incomplete_review' WHEN direct_reject THEN 'reject' WHEN blocking_count + major_0 > 0 THEN 'need_revision'
  WHEN requested IN ('recommend_human_review', 'incomplete_review') THEN requested ELSE 'pass' END AS o FROM decided),
verdicts AS (SELECT *, CASE WHEN o = 'pass' AND decision <> 'keep_independent' THEN 'need_revision' ELSE o END AS outcome,
  major_0 + CASE WHEN o = 'pass' AND decision <> 'keep_independent' THEN 1 ELSE 0 END AS major_count FROM first_outcome)"""

NEXT = """CASE decision WHEN 'merge_required' THEN 'merge_with_existing' WHEN 'reject_independent_submission' THEN 'reject_independent_submission'
  ELSE CASE outcome WHEN 'pass' THEN 'admin_confirm' WHEN 'need_revision' THEN 'author_revise' WHEN 'recommend_human_review' THEN 'human_review' WHEN 'incomplete_review' THEN 'human_recheck' ELSE 'reject' END END"""

#: The journal: each event puts a value under (kind, key).
JOURNAL = "journal AS (SELECT event_id AS seq, event_type AS kind, user_id AS rkey, value AS payload FROM {events})"

#: Review runs of documents: events are records of a history, the sequence its order.
HISTORY = "history AS (SELECT event_id AS seq, user_id AS doc, event_id % 4 AS round_no, event_type AS result, value AS score FROM {events})"

#: Parts of messages in their order, with the state of each.
OUTBOX = """outbox AS (SELECT l_orderkey AS event_key, CASE WHEN l_linenumber % 2 = 0 THEN 'admin' ELSE 'author' END AS role, l_linenumber AS part_no, l_partkey AS id,
  CASE l_suppkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'sending' ELSE 'sent' END AS state FROM {lineitem})"""

QUERIES: dict[str, str] = {
    # Verdicts.
    "visual_source": """SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 THEN 'page_images' WHEN o_orderkey % 11 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 THEN 'unavailable' WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'unavailable'
        WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN CASE WHEN o_totalprice > 300000 THEN 'unavailable' ELSE 'pdf' END WHEN o_custkey % 13 = 0 THEN 'unavailable' ELSE 'generated_pdf' END AS source,
      CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 THEN '' WHEN o_orderkey % 11 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 THEN 'required_missing' WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'declared_missing'
        WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN CASE WHEN o_totalprice > 300000 THEN 'too_large' ELSE '' END WHEN o_custkey % 13 = 0 THEN 'no_content' ELSE '' END AS reason FROM {orders}""",
    "input_limits": """SELECT o_orderkey AS doc, o_custkey > 800 AS over_pages, o_totalprice > 350000 AS over_bytes, length(o_orderpriority) * o_custkey > 9000 AS over_chars, CASE WHEN o_totalprice > 350000 THEN 'pdf_too_large' WHEN o_custkey > 800 THEN 'too_many_pages' WHEN length(o_orderpriority) * o_custkey > 9000 THEN 'text_limit' END AS limitation FROM {orders}""",
    "ruled_issues": f"""{VERDICTS} SELECT doc, 'issue-' || cast(pos AS string) || '-' || cast(part_id AS string) AS issue_id, level, category FROM ruled
      UNION ALL SELECT doc, 'similarity-decision', 'major', 'similarity' FROM verdicts WHERE o = 'pass' AND decision <> 'keep_independent'""",
    "visual_assessment": f"""{VERDICTS}, v AS (SELECT doc, visual_complete, doc % 4 AS pages_reviewed, CASE WHEN doc % 3 = 0 THEN array('blurred') WHEN doc % 3 = 1 THEN array('blurred', 'cut off') ELSE array() END AS own, CASE WHEN truncated THEN array('cut off', 'text_limit') ELSE array('pages_missing') END AS found FROM verdicts)
      SELECT doc, CASE WHEN visual_complete THEN 'full' WHEN pages_reviewed > 0 THEN 'partial' ELSE 'unavailable' END AS coverage, array_join(CASE WHEN visual_complete THEN own ELSE array_distinct(concat(own, found)) END, '|') AS limitations FROM v""",
    "issue_counts": f"WITH {ISSUES}, {RULED}, {COUNTS} SELECT doc, blocking_count, major_count, minor_count FROM counts",
    "blocking_major_issues": f"WITH {ISSUES}, {RULED} SELECT doc, pos, part_id, level, category FROM ruled WHERE level IN ('blocking', 'major')",
    "verdict_normalise": f"{VERDICTS} SELECT doc, outcome, decision, similarity, candidate_count, blocking_count, major_count, minor_count, {NEXT} AS next_action, CASE WHEN outcome = 'pass' THEN 'kept' ELSE '' END AS pass_reason FROM verdicts",
    "next_action": f"{VERDICTS} SELECT {NEXT} AS next_action, outcome, decision, count(*) AS n FROM verdicts GROUP BY 1, 2, 3",
    "outcome_status_map": f"{VERDICTS} SELECT doc, CASE outcome WHEN 'pass' THEN 'AI通过待确认' WHEN 'need_revision' THEN '需修改' WHEN 'reject' THEN '已拒稿' ELSE '待分配人工审稿' END AS table_status FROM verdicts",
    "handoff_target": f"{VERDICTS} SELECT doc, CASE WHEN outcome IN ('recommend_human_review', 'incomplete_review') OR outcome = 'need_revision' AND round_no + 1 >= 3 THEN '待分配人工审稿' WHEN outcome = 'pass' THEN 'AI通过待确认' WHEN outcome = 'reject' THEN '已拒稿' ELSE '需修改' END AS target, round_no + 1 AS next_round FROM verdicts",
    "verdict_violations": f"""WITH {ISSUES}, {RULED}, {COUNTS}, {ASKED},
      c AS (SELECT asked.*, coalesce(blocking_count, 0) AS b, coalesce(major_count, 0) AS m, coalesce(minor_count, 0) AS mi, coalesce(direct_reject, false) AS dr, doc % 2 AS claimed_b, doc % 3 AS claimed_m, doc % 4 AS claimed_mi,
        CASE doc % 3 WHEN 0 THEN 'merge_required' WHEN 1 THEN 'keep_independent' ELSE 'reject_independent_submission' END AS decision FROM asked LEFT JOIN counts USING (doc))
      SELECT doc, claimed_b <> b OR claimed_m <> m OR claimed_mi <> mi AS counts_differ, requested = 'need_revision' AND b + m = 0 AS revision_without_cause, requested = 'pass' AND b + m > 0 AS pass_with_cause, requested = 'reject' AND NOT dr AS reject_without_cause,
        requested IN ('pass', 'reject') AND (NOT visual_complete OR truncated OR missing_sources > 0) AS coverage_forbids,
        decision <> CASE raw_similarity WHEN 'merge_recommended' THEN 'merge_required' WHEN 'duplicate_reject_recommended' THEN 'reject_independent_submission' ELSE 'keep_independent' END AS status_decision_differ, decision <> 'keep_independent' AND raw_candidates = 0 AS merge_without_candidate FROM c""",
    "resolution_coverage": f"""WITH {ISSUES}, {RULED}, wanted AS (SELECT doc, part_id FROM ruled WHERE level IN ('blocking', 'major') GROUP BY doc, part_id),
      given AS (SELECT l_orderkey AS doc, l_partkey AS part_id, count(*) AS n FROM {{lineitem}} WHERE l_quantity < 16 GROUP BY 1, 2)
      SELECT doc, count(*) FILTER (WHERE g.part_id IS NULL) AS missing, count(*) FILTER (WHERE w.part_id IS NULL) AS extra, count(*) FILTER (WHERE n > 1) AS repeated,
        bool_and(g.part_id IS NOT NULL AND w.part_id IS NOT NULL AND n = 1) AS covered FROM wanted w FULL OUTER JOIN given g USING (doc, part_id) GROUP BY doc""",
    "repair_retry_coalesce": """WITH answers AS (SELECT user_id AS case_id, event_id % 2 AS attempt, max(event_id) AS seq, max_by(value, event_id) AS v FROM {events} GROUP BY 1, 2),
      a AS (SELECT case_id, max(CASE WHEN attempt = 0 THEN v END) AS first_v, max(CASE WHEN attempt = 1 THEN v END) AS repair_v FROM answers GROUP BY case_id)
      SELECT case_id, coalesce(CASE WHEN first_v >= 40 THEN first_v END, CASE WHEN repair_v >= 40 THEN repair_v END) AS accepted, CASE WHEN first_v >= 40 THEN 'first' WHEN repair_v >= 40 THEN 'repair' ELSE 'schema_error' END AS taken FROM a""",
    "error_classification": """SELECT event_id, CASE WHEN event_type = 'error' AND value >= 90 THEN 'auth_error' WHEN event_type = 'error' AND value >= 60 THEN 'rate_limited' WHEN event_type = 'error' THEN 'model_call_error' ELSE 'none' END AS code,
      event_type = 'error' AND value < 90 AS retryable, CASE WHEN event_type = 'error' AND value < 90 THEN least(power(2.0, event_id % 5), 8.0) END AS wait_s FROM {events}""",
    "backoff_schedule": "SELECT event_id % 6 AS attempt, least(power(2.0, event_id % 6), 8.0) AS wait_s, count(*) AS n FROM {events} GROUP BY 1, 2",
    # Sheet and directory.
    "eligible_queue": f"WITH {SHEET} SELECT row_id, method, status, node, obj FROM sheet WHERE method IN ('AI', '人工+AI') AND status IN ('AI审稿中', '已修改待复审') AND published = '' AND status <> '已公示' AND node <> '' AND obj <> ''",
    "expected_status_case": f"""WITH {SHEET}, s AS (SELECT *, coalesce(updated > reviewed, false) AS changed, row_id % 19 = 0 AS handoff, row_id % 31 = 0 AS pending FROM sheet)
      SELECT row_id, CASE WHEN published <> '' THEN '已公示' WHEN handoff AND method = 'AI' THEN '待分配人工审稿' WHEN pending OR status = '已移出待审核' THEN status
        WHEN status = '已拒稿' THEN CASE WHEN changed AND method IN ('AI', '人工+AI') THEN 'AI审稿中' ELSE status END
        WHEN status = 'AI通过待确认' THEN CASE WHEN changed AND method = 'AI' THEN '已修改待复审' ELSE status END
        WHEN method = '' THEN '已投稿'
        WHEN method IN ('人工', '人工+AI') THEN CASE WHEN status IN ('需修改', '已修改待复审') THEN status WHEN reviewer <> '' THEN '人工审稿中' ELSE '待分配人工审稿' END
        WHEN reviewed IS NULL THEN 'AI审稿中' WHEN changed THEN CASE WHEN status = '需修改' THEN '已修改待复审' ELSE status END ELSE '需修改' END AS expected FROM s""",
    "sheet_trailing_trim": """WITH r AS (SELECT l_orderkey AS sheet, l_linenumber AS row_no, CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END AS cell FROM {lineitem}),
      last_row AS (SELECT sheet, max(row_no) AS last_no FROM r WHERE cell <> '' GROUP BY sheet) SELECT r.sheet, r.row_no, r.cell FROM r JOIN last_row l ON r.sheet = l.sheet AND r.row_no <= l.last_no""",
    "sort_needed": """WITH s AS (SELECT o_custkey AS grp, o_orderkey AS pos, coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), '9999') AS k FROM {orders}),
      p AS (SELECT grp, k, lag(k) OVER (PARTITION BY grp ORDER BY pos) AS before_k FROM s) SELECT grp, coalesce(bool_or(k < before_k), false) AS sort_needed FROM p GROUP BY grp""",
    "cascaded_key_match": """WITH d AS (SELECT c_custkey AS doc, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'n' || cast(c_custkey AS string) END AS node, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'o' || cast(c_custkey % 300 AS string) END AS obj, c_mktsegment AS link, 'T ' || cast(c_custkey % 40 AS string) AS title, '@a' || cast(c_nationkey % 5 AS string) AS author, cast(c_nationkey % 3 AS string) AS wiki FROM {customer}),
      r AS (SELECT s_suppkey AS rec, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'n' || cast(s_suppkey * 3 AS string) END AS node, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'o' || cast(s_suppkey + 5 AS string) END AS obj, s_name AS link, 't' || cast(s_suppkey % 40 AS string) AS title, 'a' || cast(s_nationkey % 5 AS string) AS author, cast(s_nationkey % 3 AS string) AS wiki FROM {supplier}),
      m AS (SELECT doc, rec, 1 AS level FROM d JOIN r ON d.node = r.node WHERE d.node <> '' UNION ALL SELECT doc, rec, 2 FROM d JOIN r ON d.obj = r.obj WHERE d.obj <> '' UNION ALL SELECT doc, rec, 3 FROM d JOIN r ON d.link = r.link WHERE d.link <> ''
        UNION ALL SELECT doc, rec, 4 FROM d JOIN r ON lower(replace(d.title, ' ', '')) = lower(replace(r.title, ' ', '')) AND trim(LEADING '@' FROM d.author) = trim(LEADING '@' FROM r.author) AND d.wiki = r.wiki),
      f AS (SELECT doc, min(level) AS level FROM m GROUP BY doc)
      SELECT d.doc, f.level, min(m.rec) AS rec, count(m.rec) AS found, count(m.rec) > 1 AS ambiguous FROM d LEFT JOIN f ON d.doc = f.doc LEFT JOIN m ON m.doc = f.doc AND m.level = f.level GROUP BY d.doc, f.level""",
    "enabled_parent_semi_join": """SELECT o_orderkey AS job, o_custkey AS parent FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY'))""",
    "missing_from_scan_anti_join": f"""WITH {SHEET} SELECT row_id, status FROM sheet s WHERE published = '' AND status NOT IN ('已拒稿', '已移出待审核')
      AND NOT EXISTS (SELECT 1 FROM {{lineitem}} l WHERE l.l_orderkey = s.row_id AND l.l_linestatus = 'O')""",
    "fully_scanned_groups": """SELECT n_regionkey AS wiki, bool_and(c_acctbal > -900) AS scanned, count(*) AS directories FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_regionkey""",
    "sync_merge_plan": f"""WITH {SHEET}, docs AS (SELECT c_custkey AS author, c_name AS title FROM {{customer}} WHERE c_custkey % 3 <> 0), recs AS (SELECT author, max(row_id) AS row_id, max_by(status, row_id) AS status FROM sheet GROUP BY author)
      SELECT coalesce(d.author, r.author) AS author, CASE WHEN r.author IS NULL THEN 'insert' WHEN d.author IS NULL THEN 'missing' WHEN r.status IN ('已拒稿', '已移出待审核') THEN 'keep' ELSE 'update' END AS action, r.row_id FROM docs d FULL OUTER JOIN recs r ON d.author = r.author""",
    "cell_diff": """WITH old_new AS (SELECT o_orderkey AS row_id, o_orderstatus AS status_old, CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS status_new, o_orderpriority AS prio_old, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS prio_new FROM {orders}),
      cells AS (SELECT row_id, 'H' AS col, status_old AS o, status_new AS n FROM old_new UNION ALL SELECT row_id, 'J', prio_old, prio_new FROM old_new)
      SELECT row_id, col, o AS old_value, n AS new_value FROM cells WHERE o IS DISTINCT FROM n""",
    "node_identity_guard": """SELECT o_orderkey AS job, CASE WHEN c_custkey IS NULL THEN 'node_missing' WHEN c_nationkey % 5 = 0 THEN 'moved' WHEN c_acctbal < 0 THEN 'version_changed' END AS violation FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey
      WHERE c_custkey IS NULL OR c_nationkey % 5 = 0 OR c_acctbal < 0""",
    "rekey_identity": """WITH alias AS (SELECT c_custkey AS old_node, min(c_custkey + 1000000) AS new_node FROM {customer} WHERE c_custkey % 7 = 0 GROUP BY 1) SELECT o_orderkey AS id, coalesce(new_node, o_custkey) AS node FROM {orders} LEFT JOIN alias ON o_custkey = old_node""",
    "json_map_union": "SELECT k AS node, count(*) AS n, bool_or(known) AS known FROM (SELECT o_custkey AS k, true AS known FROM {orders} UNION ALL SELECT user_id, false FROM {events}) t GROUP BY k",
    # Index.
    "index_rows_excluding_self": "SELECT doc_id, toxic FROM {labels} WHERE doc_id <> 20 AND quality = 1 ORDER BY doc_id",
    "index_scan_excluding_self": "SELECT a.doc_id AS query_id, v.n - CASE WHEN a.quality = 1 THEN 1 ELSE 0 END AS visible FROM {labels} a JOIN (SELECT toxic, count(*) AS n FROM {labels} WHERE quality = 1 GROUP BY toxic) v ON v.toxic = a.toxic WHERE v.n - CASE WHEN a.quality = 1 THEN 1 ELSE 0 END > 0",
    "index_info": "SELECT lang AS summary_source, count(*) AS n FROM {documents} GROUP BY lang ORDER BY lang",
    "index_upsert_latest": "SELECT doc, result, score, seq FROM (SELECT user_id AS doc, event_type AS result, value AS score, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM {events}) t WHERE rn = 1",
    "index_insert_first": "SELECT doc, result, seq FROM (SELECT user_id AS doc, event_type AS result, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM {events}) t WHERE rn = 1",
    "index_eligibility": "SELECT d.doc_id, l.quality = 1 AND coalesce(l.toxic, 0) = 0 AND length(d.text) > 0 AS eligible FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id",
    "incremental_index_plan": "SELECT o_orderkey AS doc, o_orderstatus AS version FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = o.o_orderstatus)",
    "schema_evolution_backfill": """SELECT c_custkey AS doc, c_name AS title, CAST(NULL AS string) AS summary_source, 'v1' AS generation, 'legacy' AS source FROM {customer} WHERE c_custkey % 2 = 0
      UNION ALL SELECT c_custkey, c_name, c_mktsegment, 'v3', coalesce(c_mktsegment, 'legacy') FROM {customer} WHERE c_custkey % 2 = 1""",
    "dual_schema_override_union": """WITH both_rows AS (SELECT s_suppkey AS id, s_name AS title, 1 AS generation FROM {supplier} UNION ALL SELECT c_custkey, c_name, 0 FROM {customer}),
      r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY generation DESC) AS rn FROM both_rows) SELECT id, title, generation FROM r WHERE rn = 1""",
    "publication_invalidate": """SELECT p_partkey AS obj, p_size AS version, l.v IS NOT NULL AND l.v = p_size AS eligible FROM {part} LEFT JOIN (SELECT l_partkey, max(CAST(l_quantity AS int)) AS v FROM {lineitem} GROUP BY l_partkey) l ON l.l_partkey = p_partkey""",
    "publication_refresh_metadata": "SELECT p_partkey AS obj, CASE WHEN p_size = s.n THEN upper(p_name) ELSE p_name END AS title FROM {part} LEFT JOIN (SELECT l_partkey, CAST(count(*) AS int) AS n FROM {lineitem} GROUP BY l_partkey) s ON l_partkey = p_partkey",
    "latest_committed_lookup": """WITH cache AS (SELECT s_suppkey AS id, s_acctbal AS v FROM {supplier}), jobs AS (SELECT l_suppkey AS id, l_orderkey AS seq, l_extendedprice AS v, l_linenumber AS ln FROM {lineitem} WHERE l_linestatus = 'F'),
      newest AS (SELECT id, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, ln DESC, v DESC) AS rn FROM jobs) t WHERE rn = 1)
      SELECT p_partkey AS doc, coalesce(c.v, n.v) AS overview, CASE WHEN c.v IS NOT NULL THEN 'cache' WHEN n.v IS NOT NULL THEN 'job' ELSE 'none' END AS taken FROM {part} LEFT JOIN cache c ON c.id = p_partkey AND p_partkey % 2 = 0 LEFT JOIN newest n ON n.id = p_partkey""",
    # Journal and history.
    "kv_put_last_wins": f"WITH {JOURNAL} SELECT kind, rkey, max_by(payload, seq) AS payload, min(seq) AS seq FROM journal GROUP BY kind, rkey",
    "kv_add_first_wins": f"WITH {JOURNAL} SELECT kind, rkey, min_by(payload, seq) AS payload, min(seq) AS seq, count(*) - 1 AS refused FROM journal GROUP BY kind, rkey",
    "kv_items_in_order": f"WITH {JOURNAL} SELECT kind, rkey, seq, row_number() OVER (PARTITION BY kind ORDER BY seq) AS place FROM (SELECT kind, rkey, min(seq) AS seq FROM journal GROUP BY kind, rkey) t",
    "latest_history": f"WITH {HISTORY} SELECT doc, max_by(result, seq) AS result, max_by(score, seq) AS score, max(seq) AS seq, count(*) AS records FROM history GROUP BY doc",
    "latest_history_for_round": f"WITH {HISTORY} SELECT doc, round_no, max_by(result, seq) AS result, max(seq) AS seq FROM history WHERE round_no >= 1 GROUP BY doc, round_no",
    "idempotent_append_plan": f"""WITH {HISTORY}, known AS (SELECT doc, round_no, max_by(result, seq) AS result FROM history WHERE seq % 2 = 0 GROUP BY doc, round_no), new_rows AS (SELECT doc, round_no, max_by(result, seq) AS result FROM history WHERE seq % 2 = 1 GROUP BY doc, round_no)
      SELECT n.doc, n.round_no, CASE WHEN k.doc IS NULL THEN 'insert' WHEN k.result = n.result THEN 'noop' ELSE 'conflict' END AS action FROM new_rows n LEFT JOIN known k ON n.doc = k.doc AND n.round_no = k.round_no""",
    "dedup_first_event": f"WITH {JOURNAL} SELECT kind, rkey, seq, payload FROM (SELECT *, row_number() OVER (PARTITION BY kind, rkey ORDER BY seq) AS rn FROM journal) t WHERE rn = 1",
    "review_cycles": """SELECT user_id AS doc, event_id AS seq, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS bigint) AS cycle_no FROM {events}""",
    "last_failed_node": "SELECT user_id AS run, max_by(event_type, event_id) FILTER (WHERE value > 80) AS node, max(event_id) FILTER (WHERE value > 80) AS seq FROM {events} GROUP BY user_id",
    "job_state_replay": f"WITH {JOURNAL} SELECT rkey AS job, max_by(kind, seq) AS state, count(*) AS steps, max(seq) AS seq FROM journal GROUP BY rkey",
    "control_default": "SELECT c_custkey AS node, coalesce(s.cycle_no, 0) AS cycle_no, coalesce(s.handoff, false) AS handoff FROM {customer} LEFT JOIN (SELECT user_id, max(event_id % 3) AS cycle_no, bool_or(value > 95) AS handoff FROM {events} GROUP BY user_id) s ON c_custkey = s.user_id",
    "stale_job_reason": """WITH j AS (SELECT o_orderkey AS job, o_custkey AS node, o_orderstatus AS version, o_orderkey % 4 = 0 AS committed, o_orderkey % 3 AS round_no, o_orderkey % 2 AS cycle_no FROM {orders}),
      r AS (SELECT l_orderkey AS job, count(*) AS n, max(l_linestatus) AS version, max(l_linenumber) % 3 AS round_no, bool_or(l_returnflag = 'N' AND l_linenumber = 1) AS published FROM {lineitem} GROUP BY l_orderkey)
      SELECT j.job, CASE WHEN r.job IS NULL OR r.n > 6 THEN 'row_missing_or_duplicate' WHEN c.c_custkey IS NULL OR c.c_nationkey % 9 = 0 THEN 'document_identity_changed_or_not_docx' WHEN c.c_acctbal < 0 THEN 'document_version_changed'
        WHEN c.c_mktsegment = 'FURNITURE' THEN 'document_not_in_enabled_pending_directory' WHEN r.version <> j.version OR r.published THEN 'sheet_version_or_method_changed' WHEN j.committed AND r.round_no <> j.round_no + 1 THEN 'sheet_result_changed'
        WHEN NOT j.committed AND r.round_no <> j.round_no THEN 'sheet_review_state_changed' WHEN c.c_custkey % 2 <> j.cycle_no THEN 'review_cycle_changed' END AS reason
      FROM j LEFT JOIN r ON j.job = r.job LEFT JOIN {customer} c ON c.c_custkey = j.node""",
    # Outbox.
    "all_parts_sent": f"WITH {OUTBOX} SELECT event_key, bool_and(state = 'sent') AS notified, count(*) AS parts FROM outbox GROUP BY event_key",
    "delivery_gate": f"""WITH {OUTBOX} SELECT event_key, part_no, id, CASE WHEN state IN ('sent', 'uncertain') THEN 'never' WHEN state = 'sending' THEN 'mark_uncertain' WHEN o_orderkey IS NULL THEN 'cancel' WHEN o_orderstatus = 'P' THEN 'wait' ELSE 'send' END AS action
      FROM outbox LEFT JOIN {{orders}} ON event_key = o_orderkey""",
    "ordered_delivery_gate": f"""WITH {OUTBOX}, n AS (SELECT *, row_number() OVER (PARTITION BY event_key, role ORDER BY part_no, id, state) AS k FROM outbox)
      SELECT event_key, role, part_no, id, state, k, coalesce(max(CASE WHEN state IN ('uncertain', 'sending') THEN 1 ELSE 0 END) OVER (PARTITION BY event_key, role ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS gated FROM n""",
    "part_numbering": f"WITH {OUTBOX} SELECT event_key, role, id, part_no, row_number() OVER (PARTITION BY event_key, role ORDER BY part_no, id) AS part, count(*) OVER (PARTITION BY event_key, role) AS parts FROM outbox",
    "fixed_batches": f"WITH {OUTBOX} SELECT event_key, id, part_no, CAST(floor((row_number() OVER (PARTITION BY event_key ORDER BY part_no, id) - 1) / 8) AS bigint) AS batch FROM outbox",
    "guard_then_limit": f"WITH {OUTBOX} SELECT event_key, id FROM (SELECT event_key, id, row_number() OVER (PARTITION BY event_key ORDER BY part_no, id) AS rn FROM outbox WHERE state = 'pending') t WHERE rn <= 2",
    "migration_classify": """WITH r AS (SELECT c_custkey AS node, c_mktsegment AS status FROM {customer}), h AS (SELECT user_id AS node, count(*) AS n FROM {events} WHERE event_type <> 'error' GROUP BY user_id), f AS (SELECT user_id AS node, count(*) AS n FROM {events} WHERE event_type = 'error' GROUP BY user_id)
      SELECT coalesce(r.node, h.node, f.node) AS node, CASE WHEN r.node IS NULL THEN 'unknown' WHEN f.n > h.n THEN 'failed' WHEN h.n IS NOT NULL THEN 'migrated' ELSE 'untouched' END AS class FROM r FULL OUTER JOIN h ON r.node = h.node LEFT JOIN f ON f.node = coalesce(r.node, h.node)""",
    "manifest_integrity": """WITH m AS (SELECT l_orderkey AS job, l_linenumber AS file_no, sum(l_quantity) AS want FROM {lineitem} GROUP BY 1, 2), f AS (SELECT l_orderkey AS job, l_linenumber AS file_no, sum(CASE WHEN l_partkey % 50 = 0 THEN l_quantity + 1 ELSE l_quantity END) AS have FROM {lineitem} WHERE l_suppkey % 20 <> 0 GROUP BY 1, 2)
      SELECT m.job, m.file_no, CASE WHEN f.job IS NULL THEN 'missing' ELSE 'changed' END AS violation FROM m LEFT JOIN f ON m.job = f.job AND m.file_no = f.file_no WHERE f.job IS NULL OR f.have <> m.want""",
    # Visual evidence.
    "page_text_source": """SELECT page_id, CASE WHEN n >= 20 THEN 'native' WHEN image_share >= 40 THEN 'scanned' ELSE 'empty' END AS text_source FROM (SELECT l_orderkey * 10 + l_linenumber AS page_id, l_quantity AS n, l_discount * 1000 AS image_share FROM {lineitem}) t""",
    "page_rollup": "SELECT l_orderkey AS doc, count(*) AS pages, count(*) FILTER (WHERE l_quantity >= 20) AS native_pages, count(*) FILTER (WHERE l_quantity < 20 AND l_discount >= 0.05) AS scanned_pages, coalesce(bool_or(l_quantity < 20 AND l_discount < 0.05), false) AS has_empty FROM {lineitem} GROUP BY l_orderkey",
    "repeated_margin_lines": """WITH lines AS (SELECT l_orderkey AS doc, l_linenumber AS page, l_returnflag AS txt, l_quantity * 16 AS y0, l_quantity * 16 + 10 AS y1 FROM {lineitem}), top AS (SELECT doc, page, greatest(842.0, max(y1)) AS h FROM lines GROUP BY doc, page), n AS (SELECT doc, count(*) AS pages FROM top GROUP BY doc),
      c AS (SELECT doc, txt, count(DISTINCT page) AS hits FROM lines JOIN top USING (doc, page) WHERE y0 <= h * 0.08 OR y1 >= h * 0.92 GROUP BY doc, txt) SELECT c.doc, c.txt, c.hits FROM c JOIN n ON c.doc = n.doc WHERE c.hits >= greatest(2, ceil(n.pages / 2.0))""",
    "bbox_overlap_join": """WITH b AS (SELECT l_orderkey AS page, l_linenumber AS id, l_partkey % 100 AS x0, l_suppkey % 100 AS y0, l_partkey % 100 + l_quantity AS x1, l_suppkey % 100 + l_quantity AS y1 FROM {lineitem}),
      o AS (SELECT a.page, a.id AS a_id, c.id AS b_id, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS inter, least((a.x1 - a.x0) * (a.y1 - a.y0), (c.x1 - c.x0) * (c.y1 - c.y0)) AS small FROM b a JOIN b c ON a.page = c.page AND a.id < c.id)
      SELECT page, a_id, b_id, round(inter / small, 6) AS ratio, count(*) AS n FROM o WHERE inter > 0 GROUP BY 1, 2, 3, 4""",
    "dedup_exact_first": "SELECT l_orderkey AS doc, l_linenumber AS id, l_partkey AS sha, first_value(l_linenumber) OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) AS kept FROM {lineitem}",
    "hamming_near_dup": """WITH h AS (SELECT l_orderkey AS doc, l_linenumber AS id, l_partkey * 7919 + l_suppkey AS h FROM {lineitem}) SELECT a.doc, a.id AS a_id, b.id AS b_id, bit_count((a.h | b.h) - (a.h & b.h)) AS distance, count(*) AS n FROM h a JOIN h b ON a.doc = b.doc AND a.id < b.id WHERE bit_count((a.h | b.h) - (a.h & b.h)) <= 5 GROUP BY 1, 2, 3, 4""",
    "simple_table_filter": """WITH t AS (SELECT l_orderkey AS tbl, l_linenumber AS r, count(*) AS cols, count(*) FILTER (WHERE l_returnflag <> 'R') AS filled FROM {lineitem} GROUP BY 1, 2)
      SELECT tbl, count(*) AS n_rows, max(cols) AS n_cols FROM t GROUP BY tbl HAVING count(*) >= 2 AND count(*) <= 100 AND max(cols) <= 20 AND min(cols) = max(cols) AND sum(filled) >= 0.8 * sum(cols)""",
    "running_byte_cap": """SELECT doc, id, bytes, total, total > 100 AS over_cap FROM (SELECT l_orderkey AS doc, l_linenumber AS id, l_quantity AS bytes, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS total FROM {lineitem}) t""",
    "input_coverage": """SELECT o_orderkey AS doc, o_orderkey % 10 <> 0 AS visual_complete, o_totalprice > 400000 AS truncated, CASE WHEN o_totalprice > 400000 THEN 'text_limit' WHEN o_orderkey % 10 = 0 THEN 'pages_missing' WHEN o_orderkey % 29 = 0 THEN 'attachment_unopened' END AS incomplete_reason FROM {orders}""",
    "group_bbox_union": "SELECT l_orderkey AS page, min(l_partkey % 100) AS x0, min(l_suppkey % 100) AS y0, max(l_partkey % 100 + l_quantity) AS x1, max(l_suppkey % 100 + l_quantity) AS y1, count(*) >= 4 AS is_diagram FROM {lineitem} GROUP BY l_orderkey",
    # Trees.
    "block_tree_flatten": """WITH RECURSIVE t AS (SELECT p_partkey AS id, CAST(floor(p_partkey / 4) AS bigint) AS parent FROM {part}), r AS (SELECT id, 1 AS depth, lpad(cast(id AS string), 8, '0') AS path FROM t WHERE parent = 0 UNION ALL SELECT t.id, r.depth + 1, r.path || '/' || lpad(cast(t.id AS string), 8, '0') FROM t JOIN r ON t.parent = r.id AND t.id <> r.id WHERE r.depth < 64)
      SELECT id, depth, path, row_number() OVER (PARTITION BY substring(path, 1, 8) ORDER BY path) AS pos FROM r""",
    "block_tree_unreachable": """WITH RECURSIVE t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN p_partkey + 5 ELSE CAST(floor(p_partkey / 3) AS bigint) END AS parent FROM {part}), r AS (SELECT id, 1 AS depth FROM t WHERE parent = 0 UNION ALL SELECT t.id, r.depth + 1 FROM t JOIN r ON t.parent = r.id WHERE r.depth < 64)
      SELECT id, parent FROM t WHERE id NOT IN (SELECT id FROM r)""",
}

#: Verdicts worked out another way: the first of a list of conditions, decisions by the names of similarities.
OTHER = f"""WITH {ISSUES}, x AS (SELECT *, CASE WHEN raw_category = 'format' AND position LIKE '%标题%' OR raw_category = 'content_placeholder' AND problem LIKE '%【表格】%' THEN 'minor' ELSE raw_level END AS level FROM issues),
k AS (SELECT doc, count(CASE level WHEN 'blocking' THEN 1 END) AS b, count(CASE level WHEN 'major' THEN 1 END) AS m, count(CASE level WHEN 'minor' THEN 1 END) AS mi, count(CASE WHEN level = 'blocking' AND raw_category = 'fabricated_content' THEN 1 END) > 0 AS dr FROM x GROUP BY doc),
a AS (SELECT o_orderkey AS doc, o_orderkey % 5 AS r, o_orderkey % 10 = 0 OR o_orderkey % 23 = 0 OR o_orderkey % 29 = 0 AS inc, o_orderkey % 3 = 0 AS re, o_custkey % 4 AS n, ['no_similar', 'related_but_keep', 'merge_recommended', 'duplicate_reject_recommended', 'same_area_different_direction', 'not_applicable'][o_orderkey % 6 + 1] AS s FROM {{orders}}),
d AS (SELECT a.doc, r, inc, CASE WHEN re THEN 0 ELSE n END AS candidate_count, CASE WHEN re THEN 'not_applicable' WHEN n = 0 THEN 'no_similar' ELSE s END AS similarity, coalesce(b, 0) AS b, coalesce(m, 0) AS m, coalesce(mi, 0) AS mi, coalesce(dr, false) AS dr FROM a LEFT JOIN k ON k.doc = a.doc),
o AS (SELECT *, CASE left(similarity, 3) WHEN 'mer' THEN 'merge_required' WHEN 'dup' THEN 'reject_independent_submission' ELSE 'keep_independent' END AS decision,
  list_filter([CASE WHEN inc AND r IN (0, 4) THEN 'incomplete_review' END, CASE WHEN dr THEN 'reject' END, CASE WHEN b + m > 0 THEN 'need_revision' END, CASE r WHEN 2 THEN 'recommend_human_review' WHEN 3 THEN 'incomplete_review' END, 'pass'], lambda y: y IS NOT NULL)[1] AS o FROM d),
v AS (SELECT *, o = 'pass' AND decision <> 'keep_independent' AS more, CASE WHEN o = 'pass' AND decision <> 'keep_independent' THEN 'need_revision' ELSE o END AS outcome FROM o),
w AS (SELECT *, coalesce(CASE decision WHEN 'merge_required' THEN 'merge_with_existing' WHEN 'reject_independent_submission' THEN decision END, MAP {{'pass': 'admin_confirm', 'need_revision': 'author_revise', 'recommend_human_review': 'human_review', 'incomplete_review': 'human_recheck', 'reject': 'reject'}}[outcome]) AS next_action FROM v)"""

#: Other formulations of queries, for the other engine alone.
ORACLES: dict[str, str] = {
    "verdict_normalise": f"{OTHER} SELECT doc, outcome, decision, similarity, candidate_count, b AS blocking_count, m + more::INT AS major_count, mi AS minor_count, next_action, if(outcome = 'pass', 'kept', '') AS pass_reason FROM w",
    "next_action": f"{OTHER} SELECT next_action, outcome, decision, count(*) AS n FROM w GROUP BY ALL",
    "outcome_status_map": f"{OTHER} SELECT doc, CASE WHEN outcome LIKE 'p%' THEN 'AI通过待确认' WHEN outcome LIKE 'need%' THEN '需修改' WHEN outcome = 'reject' THEN '已拒稿' ELSE '待分配人工审稿' END AS table_status FROM w",
    "issue_counts": f"{OTHER} SELECT doc, b AS blocking_count, m AS major_count, mi AS minor_count FROM k",
    "blocking_major_issues": f"WITH {ISSUES} SELECT doc, pos, part_id, raw_level AS level, replace(raw_category, 'novel_kind', 'other') AS category FROM issues WHERE raw_level <> 'minor' AND NOT (raw_category = 'format' AND starts_with(position, '标题')) AND NOT (raw_category = 'content_placeholder' AND part_id % 5 = 0)",
    "eligible_queue": "SELECT o_orderkey AS row_id, if(o_orderkey % 4 = 0, 'AI', '人工+AI') AS method, if(o_orderkey % 9 = 3, 'AI审稿中', '已修改待复审') AS status, 'n' || o_orderkey AS node, 'o' || o_custkey AS obj FROM {orders} WHERE o_orderkey % 4 < 2 AND o_orderkey % 9 IN (3, 5) AND o_orderkey % 11 > 0 AND o_orderkey % 13 > 0 AND o_orderkey % 17 > 0",
    "sheet_trailing_trim": "WITH r AS (SELECT l_orderkey AS sheet, l_linenumber AS row_no, replace(l_returnflag, 'R', '') AS cell FROM {lineitem}) SELECT * FROM r WHERE EXISTS (SELECT 1 FROM r x WHERE x.sheet = r.sheet AND x.row_no >= r.row_no AND x.cell <> '')",
    "sort_needed": "WITH s AS (SELECT o_custkey AS grp, list(if(o_orderpriority = '4-NOT SPECIFIED', '9999', o_orderpriority) ORDER BY o_orderkey) AS l FROM {orders} GROUP BY o_custkey) SELECT grp, l <> list_sort(l) AS sort_needed FROM s",
    "fully_scanned_groups": "SELECT n_regionkey AS wiki, min(c_acctbal) > -900 AS scanned, count(*) AS directories FROM {customer}, {nation} WHERE n_nationkey = c_nationkey GROUP BY ALL",
    "enabled_parent_semi_join": "SELECT o_orderkey AS job, c_custkey AS parent FROM {orders} JOIN {customer} ON c_custkey = o_custkey WHERE c_acctbal > 0 AND left(c_mktsegment, 1) IN ('B', 'H', 'M')",
    "dual_schema_override_union": "SELECT coalesce(s_suppkey, c_custkey) AS id, coalesce(s_name, c_name) AS title, (s_suppkey IS NOT NULL)::INT AS generation FROM {supplier} FULL JOIN {customer} ON c_custkey = s_suppkey",
    "index_insert_first": "SELECT user_id AS doc, arg_min(event_type, event_id) AS result, min(event_id) AS seq FROM {events} GROUP BY user_id",
    "latest_history": "SELECT user_id AS doc, event_type AS result, value AS score, event_id AS seq, count(*) OVER (PARTITION BY user_id) AS records FROM {events} QUALIFY event_id = max(event_id) OVER (PARTITION BY user_id)",
    "dedup_first_event": "SELECT event_type AS kind, user_id AS rkey, min(event_id) AS seq, arg_min(value, event_id) AS payload FROM {events} GROUP BY ALL",
    "job_state_replay": "SELECT user_id AS job, event_type AS state, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS steps, event_id AS seq FROM {events} QUALIFY lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL",
    "kv_items_in_order": "SELECT event_type AS kind, user_id AS rkey, min(event_id) AS seq, rank() OVER (PARTITION BY event_type ORDER BY min(event_id)) AS place FROM {events} GROUP BY event_type, user_id",
    "all_parts_sent": f"WITH {OUTBOX} SELECT event_key, count(*) FILTER (WHERE state <> 'sent') = 0 AS notified, count(*) AS parts FROM outbox GROUP BY event_key",
    "incremental_index_plan": "SELECT o_orderkey AS doc, o_orderstatus AS version FROM {orders} EXCEPT SELECT l_orderkey, l_linestatus FROM {lineitem}",
    "rekey_identity": "SELECT o_orderkey AS id, if(EXISTS (SELECT 1 FROM {customer} WHERE c_custkey = o_custkey AND c_custkey % 7 = 0), o_custkey + 1000000, o_custkey) AS node FROM {orders}",
    "index_eligibility": "SELECT doc_id, doc_id IN (SELECT doc_id FROM {labels} WHERE quality = 1 AND (toxic IS NULL OR toxic = 0)) AND text <> '' AS eligible FROM {documents} WHERE doc_id IN (SELECT doc_id FROM {labels})",
    "publication_invalidate": "SELECT p_partkey AS obj, p_size AS version, coalesce(p_size = (SELECT max(l_quantity::INT) FROM {lineitem} WHERE l_partkey = p_partkey), false) AS eligible FROM {part}",
    "simple_table_filter": "WITH t AS (SELECT l_orderkey AS tbl, list(l_returnflag) AS cells FROM {lineitem} GROUP BY l_orderkey, l_linenumber), g AS (SELECT tbl, list(cells) AS rows_ FROM t GROUP BY tbl) SELECT tbl, len(rows_) AS n_rows, len(rows_[1]) AS n_cols FROM g WHERE len(rows_) BETWEEN 2 AND 100 AND len(rows_[1]) <= 20 AND len(list_distinct(list_transform(rows_, lambda r: len(r)))) = 1 AND len(list_filter(flatten(rows_), lambda c: c <> 'R')) >= 0.8 * len(flatten(rows_))",
    "page_rollup": "SELECT l_orderkey AS doc, count(*) AS pages, count(CASE WHEN l_quantity >= 20 THEN 1 END) AS native_pages, count(CASE WHEN l_quantity < 20 AND l_discount >= 0.05 THEN 1 END) AS scanned_pages, count(*) > count(CASE WHEN l_quantity >= 20 OR l_discount >= 0.05 THEN 1 END) AS has_empty FROM {lineitem} GROUP BY l_orderkey",
    "backoff_schedule": "SELECT event_id % 6 AS attempt, (CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END)::DOUBLE AS wait_s, count(*) AS n FROM {events} GROUP BY ALL",
    "input_coverage": "SELECT o_orderkey AS doc, NOT o_orderkey % 10 = 0 AS visual_complete, NOT o_totalprice <= 400000 AS truncated, list_filter([if(o_totalprice > 400000, 'text_limit', NULL), if(o_orderkey % 10 = 0, 'pages_missing', NULL), if(o_orderkey % 29 = 0, 'attachment_unopened', NULL)], lambda x: x IS NOT NULL)[1] AS incomplete_reason FROM {orders}",
    "delivery_gate": f"WITH {OUTBOX} SELECT event_key, part_no, id, list_filter([if(state = 'sent' OR state = 'uncertain', 'never', NULL), if(state = 'sending', 'mark_uncertain', NULL), if(event_key NOT IN (SELECT o_orderkey FROM {{orders}}), 'cancel', NULL), if(event_key IN (SELECT o_orderkey FROM {{orders}} WHERE o_orderstatus = 'P'), 'wait', NULL), 'send'], lambda x: x IS NOT NULL)[1] AS action FROM outbox",
    "migration_classify": "WITH n AS (SELECT user_id AS node, count(*) FILTER (WHERE event_type <> 'error') AS h, count(*) FILTER (WHERE event_type = 'error') AS f FROM {events} GROUP BY user_id) SELECT coalesce(c_custkey, node) AS node, CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN coalesce(h, 0) > 0 AND f > h THEN 'failed' WHEN coalesce(h, 0) > 0 THEN 'migrated' ELSE 'untouched' END AS class FROM {customer} FULL JOIN (SELECT * FROM n WHERE h > 0) n ON node = c_custkey",
    "visual_source": """WITH f AS (SELECT o_orderkey AS doc, o_orderkey % 5 = 0 AS pages, o_orderkey % 3 = 0 AS declared, o_orderkey % 7 = 0 AS usual, o_orderkey % 11 = 0 AS required, NOT (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0) AS there, o_totalprice > 300000 AS large, o_custkey % 13 <> 0 AS has_text FROM {orders}),
      p AS (SELECT *, declared OR usual AS pdf FROM f), t AS (SELECT doc, list_filter([CASE WHEN pages AND NOT pdf THEN 'page_images:' END, CASE WHEN required AND NOT pdf THEN 'unavailable:required_missing' END, CASE WHEN pdf AND NOT there THEN 'unavailable:declared_missing' END, CASE WHEN pdf AND large THEN 'unavailable:too_large' END,
        CASE WHEN pdf THEN 'pdf:' END, CASE WHEN NOT has_text THEN 'unavailable:no_content' END, 'generated_pdf:'], lambda x: x IS NOT NULL)[1] AS first FROM p) SELECT doc, split_part(first, ':', 1) AS source, split_part(first, ':', 2) AS reason FROM t""",
    "input_limits": """WITH l AS (SELECT o_orderkey AS doc, greatest(o_custkey - 800, 0) > 0 AS p, NOT o_totalprice <= 350000 AS b, strlen(repeat(o_orderpriority, 1)) * o_custkey / 9000 > 1 AS c FROM {orders})
      SELECT doc, p AS over_pages, b AS over_bytes, c AS over_chars, coalesce(CASE WHEN b THEN 'pdf_too_large' END, CASE WHEN p THEN 'too_many_pages' END, CASE WHEN c THEN 'text_limit' END) AS limitation FROM l""",
    "ruled_issues": f"""WITH {ISSUES}, {RULED}, {COUNTS}, {ASKED} SELECT doc, 'issue-' || pos || '-' || part_id AS issue_id, level, category FROM ruled
      UNION ALL SELECT a.doc, 'similarity-decision', 'major', 'similarity' FROM asked a WHERE NOT rereview AND effective_candidates > 0 AND raw_similarity IN ('merge_recommended', 'duplicate_reject_recommended')
        AND NOT ((NOT visual_complete OR truncated OR missing_sources > 0) AND requested IN ('pass', 'reject')) AND requested NOT IN ('recommend_human_review', 'incomplete_review')
        AND NOT EXISTS (SELECT 1 FROM ruled r WHERE r.doc = a.doc AND r.level IN ('blocking', 'major'))""",
    "visual_assessment": """SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 10 <> 0 THEN 'full' WHEN o_orderkey % 4 > 0 THEN 'partial' ELSE 'unavailable' END AS coverage,
      CASE o_orderkey % 3 WHEN 0 THEN 'blurred' WHEN 1 THEN 'blurred|cut off' ELSE '' END || CASE WHEN o_orderkey % 10 <> 0 THEN '' WHEN o_orderkey % 23 <> 0 THEN CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE '|' END || 'pages_missing'
        WHEN o_orderkey % 3 = 0 THEN '|cut off|text_limit' WHEN o_orderkey % 3 = 1 THEN '|text_limit' ELSE 'cut off|text_limit' END AS limitations FROM {orders}""",
    "index_rows_excluding_self": "SELECT doc_id, toxic FROM {labels} WHERE quality IN (1) EXCEPT SELECT doc_id, toxic FROM {labels} WHERE doc_id = 20",
    "index_scan_excluding_self": "SELECT a.doc_id AS query_id, count(b.doc_id) AS visible FROM {labels} a JOIN {labels} b ON a.toxic = b.toxic AND b.quality = 1 AND a.doc_id <> b.doc_id GROUP BY a.doc_id",
    "handoff_target": f"""{VERDICTS} SELECT doc, CASE outcome WHEN 'pass' THEN 'AI通过待确认' WHEN 'reject' THEN '已拒稿' WHEN 'need_revision' THEN CASE WHEN round_no IN (0, 1) THEN '需修改' ELSE '待分配人工审稿' END ELSE '待分配人工审稿' END AS target, round_no + 1 AS next_round FROM verdicts""",
    "ordered_delivery_gate": f"""WITH {OUTBOX}, n AS (SELECT *, row_number() OVER (PARTITION BY event_key, role ORDER BY part_no, id, state) AS k FROM outbox),
      f AS (SELECT event_key, role, min(k) AS first_stop FROM n WHERE state IN ('uncertain', 'sending') GROUP BY ALL) SELECT n.event_key, n.role, part_no, id, state, k, k > coalesce(first_stop, k) AS gated FROM n LEFT JOIN f ON f.event_key = n.event_key AND f.role = n.role""",
    "sync_merge_plan": f"""WITH {SHEET}, docs AS (SELECT c_custkey AS author FROM {{customer}} WHERE c_custkey % 3 <> 0), recs AS (SELECT author, row_id, status FROM sheet QUALIFY row_number() OVER (PARTITION BY author ORDER BY row_id DESC) = 1),
      a AS (SELECT author FROM docs UNION SELECT author FROM recs) SELECT a.author, CASE WHEN a.author NOT IN (SELECT author FROM recs) THEN 'insert' WHEN a.author NOT IN (SELECT author FROM docs) THEN 'missing' WHEN status IN ('已拒稿', '已移出待审核') THEN 'keep' ELSE 'update' END AS action, row_id FROM a LEFT JOIN recs USING (author)""",
    "resolution_coverage": f"""WITH {ISSUES}, {RULED}, w AS (SELECT DISTINCT doc, part_id FROM ruled WHERE level IN ('blocking', 'major')), g AS (SELECT l_orderkey AS doc, l_partkey AS part_id FROM {{lineitem}} WHERE l_quantity < 16),
      d AS (SELECT doc FROM w UNION SELECT doc FROM g), x AS (SELECT doc, (SELECT count(*) FROM (SELECT part_id FROM w WHERE w.doc = d.doc EXCEPT SELECT part_id FROM g WHERE g.doc = d.doc)) AS missing, (SELECT count(*) FROM (SELECT part_id FROM g WHERE g.doc = d.doc EXCEPT SELECT part_id FROM w WHERE w.doc = d.doc)) AS extra,
        (SELECT count(*) FROM (SELECT part_id FROM g WHERE g.doc = d.doc GROUP BY part_id HAVING count(*) > 1)) AS repeated FROM d) SELECT *, missing + extra + repeated = 0 AS covered FROM x""",
    "last_failed_node": "SELECT DISTINCT user_id AS run, first_value(CASE WHEN value > 80 THEN event_type END) OVER w AS node, max(CASE WHEN value > 80 THEN event_id END) OVER (PARTITION BY user_id) AS seq FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY value > 80 DESC, event_id DESC)",
    "cell_diff": "SELECT o_orderkey AS row_id, 'H' AS col, o_orderstatus AS old_value, 'F' AS new_value FROM {orders} WHERE o_orderkey % 3 = 0 AND o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'J', o_orderpriority, NULL FROM {orders} WHERE o_orderkey % 4 = 0 AND o_orderpriority IS NOT NULL",
    "missing_from_scan_anti_join": f"WITH {SHEET} SELECT row_id, status FROM sheet WHERE published = '' AND status NOT IN ('已拒稿', '已移出待审核') AND row_id NOT IN (SELECT l_orderkey FROM {{lineitem}} WHERE l_linestatus = 'O')",
    "review_cycles": "SELECT a.user_id AS doc, a.event_id AS seq, (SELECT count(*) FROM {events} b WHERE b.user_id = a.user_id AND b.event_id <= a.event_id AND b.event_type = 'error') AS cycle_no FROM {events} a",
}
