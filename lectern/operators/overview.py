"""Rules on overviews of articles: what is wrong with one, and what is odd about it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# Pairs of characters that tell nothing of what a text is about, and words of reviews.
COMMON = ["本文", "文章", "介绍", "记录", "说明", "内容", "当前", "进行", "通过", "使用", "包括", "主要", "相关", "方法", "结果"]
REVIEW_MARKERS = ["建议修改", "可以通过", "审稿通过", "本轮审稿", "上一轮审稿", "审稿结论", "存在问题", "符合知识库"]
PROCESS_MARKERS = ["本轮审稿", "上一轮审稿", "审稿通过", "本次审稿结论", "已解决上一轮", "符合知识库公示标准"]
GROUNDED = 0.02


def messages(*found: Column) -> Column:
    """Those that are not null, each once, in their order; arrays count as their elements."""
    return F.array_distinct(F.array_compact(F.concat(*found)))


def said(hit: Column, message: str) -> Column:
    return F.array(F.when(hit, F.lit(message)))


def ungrounded(items: Column, source: Column, kind: str) -> Column:
    """A message for each item whose normal form the source has not."""
    return F.transform(F.filter(items, lambda x: ~F.contains(source, T.normal(x))), lambda x: F.concat(F.lit(f"ungrounded_{kind}:"), x))


def grounded(content: Column, source: Column) -> Column:
    """Whether enough pairs of characters of one normal form are in another; a single character has to be there itself."""
    share = F.coalesce(T.grounding(content, source, COMMON), F.lit(0.0))
    return F.when(F.length(content) < 2, F.contains(source, content)).otherwise(share >= GROUNDED)


def retrieval_messages(content: Column, source: Column, entities: Column, parameters: Column, source_chars: Column, markers: list[str] | None = None, least: int = 100, most: int = 1500) -> tuple[Column, Column]:
    """Errors and warnings of an overview to search by. content is cleaned text, source a normal form."""
    key = T.normal(content)
    errors = messages(
        said(key == "", "retrieval_overview_content_empty"),
        said(F.length(content) > most, "retrieval_overview_exceeds_max_chars"),
        said(T.contains_any(content, markers or REVIEW_MARKERS), "retrieval_overview_contains_review_language"),
        said((key != "") & (source != "") & ~T.let(key, lambda k: grounded(k, source)), "retrieval_overview_not_grounded_in_source"),
    )
    short = (F.length(content) < least) & (source_chars >= 3 * least)
    warnings = messages(said(short, "retrieval_overview_short_for_source"), ungrounded(entities, source, "technical_entity"), ungrounded(parameters, source, "key_parameter"))
    return errors, warnings


def article_messages(content: Column, source: Column, summary: Column, entities: Column, parameters: Column, candidates: Column, source_chars: Column, most: int = 1200) -> tuple[Column, Column]:
    """Messages and status (invalid, warning or valid) of an overview that a review wrote; null content is unavailable.

    candidates: structs document_id and title, which the overview must not have unless the source has them.
    """
    key = T.normal(content)

    def taken(field: str) -> Column:
        bad = F.filter(F.transform(candidates, lambda c: F.trim(c[field])), lambda x: (T.normal(x) != "") & F.contains(key, T.normal(x)) & ~F.contains(source, T.normal(x)))
        return F.transform(bad, lambda x: F.concat(F.lit(f"candidate_{field}_contamination:"), x))

    invalid = messages(
        said(key == "", "article_overview_content_empty"),
        said(F.length(content) > most, "article_overview_exceeds_max_chars"),
        said((key != "") & (key == T.normal(summary)), "article_overview_equals_review_summary"),
        said(T.contains_any(content, PROCESS_MARKERS), "article_overview_contains_review_process_language"),
        ungrounded(entities, source, "technical_entity"),
        ungrounded(parameters, source, "key_parameter"),
        taken("document_id"),
        taken("title"),
    )
    odd = messages(said((F.length(content) < 100) & (source_chars >= 500), "article_overview_short_for_source"))
    status = F.when(content.isNull(), "unavailable").when(F.size(invalid) > 0, "invalid").when(F.size(odd) > 0, "warning").otherwise("valid")
    return F.when(content.isNull(), F.array(F.lit("article_overview_unavailable"))).otherwise(messages(invalid, odd)), status


def sections(**named: Column) -> Column:
    """Sections in brackets, in their order."""
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"[{n}]\n"), c) for n, c in named.items()])
