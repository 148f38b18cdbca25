"""What an online review tells people, and which published articles a search may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headings, labels and sentences of messages.
RULES = "blocking / major 必须修改；minor 通常不单独阻塞通过。复审不会因 minor 无限要求修改。"
NO_ISSUES, NO_RESOLUTIONS = "无 blocking / major 问题。", "上一轮没有 blocking / major 待复查项。"
LABELS = {"keep_independent": "可独立保留", "merge_required": "建议合并", "reject_independent_submission": "不建议独立提交"}
AT_LIMIT = "已达到自动审稿轮次上限，停止自动复审，由管理员安排人工审稿。"
BY_HUMANS = "需要管理员安排人工审稿。当前材料或审稿覆盖的限制请结合上述意见核实。"
TO_CONFIRM = "AI通过仍需管理员确认，不会自动公示。"


def listed(rows: DataFrame, doc: str, line: Column, sep: str, name: str) -> DataFrame:
    """doc and the lines of its rows in the order of pos, joined."""
    parts = F.array_sort(F.collect_list(F.struct(F.col("pos"), line.alias("line"))))
    return rows.groupBy(doc).agg(F.array_join(F.transform(parts, lambda x: x["line"]), sep).alias(name))


def messages(reviews: DataFrame, issues: DataFrame, resolutions: DataFrame, candidates: DataFrame) -> DataFrame:
    """doc, author and admin: the message to each, in numbered sections.

    reviews: doc, title, link, round, status, summary, outcome, decision, similarity, handoff, author, wiki. Issues (doc,
    pos, level, category, position, problem, suggestion) count if they block or are major; candidates (doc, pos, title,
    wiki, link, evidence) in a first round, resolutions (doc, pos, issue_id, status, evidence) in later ones. Nulls are
    empty.
    """
    t = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cat = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    serious = issues.filter(F.col("level").isin("blocking", "major"))
    found = listed(serious, "doc", cat("[", t("level"), " / ", t("category"), "] ", t("position"), "\n问题：", t("problem"), "\n修改建议：", t("suggestion")), "\n\n", "_issues")
    solved = listed(resolutions, "doc", cat(t("issue_id"), "：", t("status"), "\n", t("evidence")), "\n", "_solved")
    alike = listed(candidates, "doc", cat("\n", t("title"), "（", t("wiki"), "）\n", t("link"), "\n", t("evidence")), "", "_alike")
    rows = reviews
    for part in (found, solved, alike):
        rows = rows.join(part, "doc", "left")
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("decision")), F.lit(""))
    compared = cat("处理结论：", label, "\n", t("similarity"), t("_alike"))
    again = F.coalesce("_solved", F.lit(NO_RESOLUTIONS))
    after = F.when(F.col("handoff"), AT_LIMIT).when(F.col("outcome").isin("recommend_human_review", "incomplete_review"), BY_HUMANS).when(F.col("outcome") == "pass", TO_CONFIRM)
    section = lambda title, body: F.when(body.isNotNull(), cat(title, "\n", body))
    first = F.col("round") == 0
    sections = F.array_compact(F.array(section("审稿结论", cat("当前状态：", t("status"), "\n", t("summary"))), section("问题等级说明", F.lit(RULES)), section("必须修改的问题", F.coalesce("_issues", F.lit(NO_ISSUES))), F.when(first, section("相似文档检查", compared)).otherwise(section("复审解决情况", again)), section("后续处理", after)))
    body = F.array_join(F.transform(sections, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n\n")
    heading = cat("《", t("title"), "》AI审稿意见（第", (F.col("round") + 1).cast("string"), "轮）\n", t("link"))
    return rows.select("doc", cat(heading, "\n\n", body).alias("author"), cat(heading, "\n投稿人：", t("author"), "\n知识库：", t("wiki"), "\n", body).alias("admin"))


def publishable(rows: DataFrame) -> Column:
    """Whether an article may be published: it has the hash of its source and a content that is not blank."""
    blank = lambda c: F.coalesce(F.regexp_replace(F.col(c), r"(?U)\s+", ""), F.lit("")) == ""
    return ~blank("source_content_hash") & ~blank("content")


def published(entries: DataFrame, new: DataFrame, overwrite: bool = True) -> DataFrame:
    """entries (document_id, content, source_content_hash, source_updated_at, eligible, publication_confirmed) after new ones.

    New articles are eligible and confirmed, if they are publishable; others change nothing. They replace those of their
    document_id, or, without overwrite, stay behind them. Of new ones with one document_id the one of the last
    source_updated_at counts.
    """
    some = new.filter(publishable(new)).withColumns({"eligible": F.lit(True), "publication_confirmed": F.lit(True)}).select(entries.columns)
    one = some.groupBy("document_id").agg(F.max_by(F.struct(*entries.columns), F.struct("source_updated_at", "content")).alias("e")).select("e.*")
    if overwrite:
        return entries.join(one, "document_id", "left_anti").unionByName(one)
    return entries.unionByName(one.join(entries, "document_id", "left_anti"))


def invalidated(entries: DataFrame, valid: DataFrame) -> DataFrame:
    """entries that are eligible only if they are confirmed and of the version that valid (document_id, version) names."""
    both = entries.join(valid.select("document_id", F.col("version").alias("_version")), "document_id", "left")
    own = F.coalesce("publication_confirmed", F.lit(False)) & F.coalesce(F.col("_version") == F.col("source_updated_at"), F.lit(False))
    return both.withColumn("eligible", own).drop("_version").select(entries.columns)


def visible(entries: DataFrame, document_id: Column | None = None) -> DataFrame:
    """Articles that a search may see: eligible, confirmed, and not the one that asks."""
    some = entries.filter(F.col("eligible") & F.col("publication_confirmed"))
    return some if document_id is None else some.filter(F.col("document_id") != document_id)


def migrated(legacy: DataFrame, entries: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """entries with those of legacy (key, payload: JSON of article, eligible, publication_confirmed), which come first, and the archive.

    An article of another document_id than its key stops it all, before anything is written.
    """
    parsed = legacy.select("key", "payload", F.from_json("payload", f"article struct<{schema}>, eligible boolean, publication_confirmed boolean").alias("p"))
    wrong = parsed.filter(~F.col("key").eqNullSafe(F.col("p.article.document_id"))).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['key']} holds the article of another document")
    flags = [F.coalesce(F.col(f"p.{c}"), F.lit(False)).alias(c) for c in ("eligible", "publication_confirmed")]
    new = parsed.select("p.article.*", *flags).select(entries.columns)
    return entries.unionByName(new.join(entries, "document_id", "left_anti")), parsed.select("key", "payload")
