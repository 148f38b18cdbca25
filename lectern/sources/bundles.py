"""Submissions from folders of JSON files, one folder a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = "case_id string, document_id string, node_token string, title string, wiki_name string, author_id string, author string, link string, review_method string, status string, review_round int, updated_at string, last_ai_review_at string"


def cases(spark: SparkSession, root: str) -> DataFrame:
    """Names of the folders that hold a submission, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "source_document.json").load(root)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("case")).orderBy("case")


ISSUE = "struct<issue_id:string,level:string,category:string,position:string,problem:string,suggestion:string,evidence_ids:array<string>>"
#: The other files of a case: their columns, and how they are read where they hold an array by itself or within a field.
FILES = {
    "document_blocks.json": ("blocks", ("blocks",)),
    "attachment_metadata.json": ("attachments", ("attachments",)),
    "similarity_candidates.json": ("candidates", ("similar_documents", "candidates")),
    "previous_review.json": ("previous_review", ()),
    "fixture_options.json": ("options", ()),
    "mock_llm_result.json": ("mock", ()),
    "fake_model_response.json": ("fake", ()),
    "mock_overview_result.json": ("mock_overview", ()),
    "expected_result.json": ("expected", ()),
}


def files_of_cases(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """case and, by name, a struct of text and whether it is good JSON, of the files of these names; one scan of the folder.

    Bytes that are no UTF-8 have no text and are not good, and hold nothing else up.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(names) + "}").load(root)
    at = F.split("path", "/")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = files.select(F.element_at(at, -2).alias("case"), F.element_at(at, -1).alias("name"), F.struct(text.alias("text"), F.try_parse_json(text).isNotNull().alias("good")).alias("file"))
    return rows.groupBy("case").agg(*[F.max_by("file", F.when(F.col("name") == n, F.lit(1))).alias(n.removesuffix(".json")) for n in names])


def within(text: Column, fields: tuple[str, ...]) -> Column:
    """JSON text itself, or what is in the first of these fields that an object has."""
    own = F.coalesce(*[F.get_json_object(text, f"$.{f}") for f in fields], F.lit("[]")) if fields else text
    return F.when(text.isNull(), None).when(F.trim(text).startswith("["), text).otherwise(own)


def adapted(mock: Column) -> Column:
    """review, raw and raise of a canned answer, which may be wrapped in a behavior or be these fields themselves."""
    at = lambda f: F.get_json_object(mock, f"$.{f}")
    how, bare = at("behavior"), at("behavior").isNull()
    review = F.when(bare, at("review")).when(how == "return", at("response"))
    raw = F.when(bare, at("raw")).when(how == "raw", F.coalesce(at("raw_output"), F.lit("")))
    error = F.when(bare, at("raise")).when(how.isin("raise", "error"), F.coalesce(at("error_type"), at("error"), F.lit("api")))
    return F.struct(review.alias("review"), raw.alias("raw"), error.alias("raise"), F.from_json(at("visual_batches"), "array<string>").alias("visual_batches"))


def previous_review(source: DataFrame) -> Column:
    """The issues that older submissions carry themselves, as a review of theirs: ids and defaults are filled in."""
    issues = F.transform(
        F.col("previous_issues"),
        lambda x, i: F.struct(
            F.coalesce(F.nullif(x["issue_id"], F.lit("")), F.concat(F.lit("previous-"), (i + 1).cast("string"))).alias("issue_id"),
            F.coalesce(x["level"], F.lit("major")).alias("level"),
            F.coalesce(x["category"], F.lit("other")).alias("category"),
            *[F.coalesce(x[f], F.lit("")).alias(f) for f in ("position", "problem", "suggestion")],
            F.coalesce(x["evidence_ids"], F.array().cast("array<string>")).alias("evidence_ids"),
        ),
    )
    review = F.struct("document_id", F.greatest(F.coalesce("review_round", F.lit(0)), F.lit(1)).alias("review_round"), F.lit("need_revision").alias("result"), issues.alias("issues"))
    return F.when(F.size(F.coalesce("previous_issues", F.array().cast(f"array<{ISSUE}>"))) > 0, F.to_json(review))


def bundles(spark: SparkSession, root: str) -> DataFrame:
    """A row a case: its submission, and its other files as JSON text where it has them.

    blocks, attachments and candidates are arrays, whatever they are wrapped in. review, raw, raise and visual_batches are
    the canned answer, overview, overview_raw and overview_raise that to the overview. error names a file that is missing
    though it must be there, or is no JSON.
    """
    names = ["source_document.json", *FILES]
    out = files_of_cases(spark, root, names).filter(F.col("source_document").isNotNull())
    file = lambda name: F.col(name.removesuffix(".json"))
    source = F.from_json(F.when(file(names[0])["good"], file(names[0])["text"]), f"{SOURCE}, previous_issues array<{ISSUE}>")
    error = F.when(~file(names[0])["good"], names[0])
    columns = []
    for name, (column, inside) in FILES.items():
        columns.append(within(file(name)["text"], inside).alias(column))
        bad = file(name).isNull() if name == "document_blocks.json" else F.lit(False)
        error = F.coalesce(error, F.when(bad | ~F.coalesce(file(name)["good"], F.lit(True)), name))
    out = out.select("case", source.alias("_source"), *columns, error.alias("error")).select("case", "_source.*", *[c for c, _ in FILES.values()], "error")
    answer, overview = adapted(F.coalesce("mock", "fake")), adapted(F.col("mock_overview"))
    older = F.get_json_object(answer["review"], "$.article_overview")
    out = out.withColumn("previous_review", F.coalesce("previous_review", previous_review(out)))
    out = out.withColumns({"review": answer["review"], "raw": answer["raw"], "raise": answer["raise"], "visual_batches": answer["visual_batches"]})
    return out.withColumns({"overview": F.when(F.col("mock_overview").isNotNull(), overview["review"]).otherwise(older), "overview_raw": overview["raw"], "overview_raise": overview["raise"]}).drop("mock", "fake", "mock_overview")


def manifest_violations(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Entries path and sha256 of a manifest whose file is missing or has other contents, or leaves the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    have = files.select(F.regexp_replace(F.col("path"), f"^.*{root.rstrip('/')}/", "").alias("path"), F.sha2("content", 256).alias("have"))
    bad = manifest.join(have, "path", "left").withColumn("violation", F.when(F.col("path").rlike(r"(^|/)\.\.(/|$)|^/"), "escapes").when(F.col("have").isNull(), "missing").when(F.col("have") != F.col("sha256"), "changed"))
    return bad.filter("violation is not null").select("path", "violation")
