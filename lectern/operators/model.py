"""Answers of a model to requests. A model is a table of canned answers by case here; another one would be another join."""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Codes of the errors that a canned answer may ask for, and which of these are tried again.
ERRORS = {"authentication": "model_authentication_error", "timeout": "model_timeout", "rate_limit": "model_rate_limit", "server": "model_server_error"}
OTHER_ERROR = "model_call_error"
RETRYABLE = ("model_timeout", "model_rate_limit", "model_server_error")
OVERVIEW = "retrieval_overview"


def answers(requests: DataFrame, canned: DataFrame) -> DataFrame:
    """requests with content, error and retryable.

    requests: case, seq, phase and pages (numbers of the pages sent). canned, one row a case: review, raw, raise, overview,
    overview_raw, overview_raise and visual_batches (an array), nulls where there is none. Visual batches are answered in
    their order, those beyond the given ones by the pages that were sent.
    """
    visual = F.col("phase") == "visual_batch"
    turn = F.row_number().over(Window.partitionBy("case", "phase").orderBy("seq")) - 1
    rows = requests.withColumn("_turn", turn).join(canned, "case", "left")
    overview = F.col("phase").startswith(OVERVIEW)
    asked = F.when(overview, F.col("overview_raise")).otherwise(F.col("raise"))
    seen = F.to_json(F.struct(F.lit("").alias("batch_summary"), F.coalesce("pages", F.array().cast("array<int>")).alias("pages_reviewed"), F.array().cast("array<string>").alias("evidence"), F.array().cast("array<string>").alias("limitations")))
    content = F.when(overview, F.coalesce("overview_raw", "overview")).when(visual, F.coalesce(F.get("visual_batches", F.col("_turn")), seen)).otherwise(F.coalesce("raw", "review"))
    code = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ERRORS.items() for x in kv]), asked), F.lit(OTHER_ERROR))
    error = F.when(asked.isNotNull(), code).when(content.isNull(), F.lit(OTHER_ERROR))
    out = rows.select(*requests.columns, F.when(error.isNull(), content).alias("content"), error.alias("error"))
    return out.withColumn("retryable", F.coalesce(F.col("error").isin(*RETRYABLE), F.lit(False)))


def request_summary(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """case, seq, phase, prompt_chars, image_count and image_bytes of requests (case, seq, phase, prompt) and their pages."""
    sums = pages.groupBy("case", "seq").agg(F.count("*").alias("image_count"), F.sum("byte_size").alias("image_bytes"))
    out = requests.join(sums, ["case", "seq"], "left")
    return out.select("case", "seq", "phase", F.length("prompt").alias("prompt_chars"), F.coalesce("image_count", F.lit(0)).alias("image_count"), F.coalesce("image_bytes", F.lit(0)).alias("image_bytes"))


def mode(review_round: Column) -> Column:
    """initial for round 0, else rereview."""
    return F.when(review_round > 0, "rereview").otherwise("initial")


def resume_from(trace: DataFrame) -> DataFrame:
    """run and node of the last failure of runs (run, seq, node, status) that have not got beyond it since."""
    last = trace.groupBy("run").agg(F.max_by("node", "seq").alias("node"), F.max_by("status", "seq").alias("status"))
    return last.filter("status = 'failed'").select("run", "node")


def strict_schema(schema: dict) -> dict:
    """A copy of a JSON schema whose objects ask for all their properties and allow no others."""
    out = copy.deepcopy(schema)
    todo = [out]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            if node.get("type") == "object" and isinstance(node.get("properties"), dict):
                node |= {"additionalProperties": False, "required": list(node["properties"])}
            todo += node.values()
        elif isinstance(node, list):
            todo += node
    return out
