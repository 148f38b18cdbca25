"""A corpus pipeline over `documents`: languages, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the
docs of the next. Stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import byte_bpe, language_id, mixing, near_duplicates, personal_data
from lectern.llm.near_duplicates import pick
from lectern.llm.shared import checkpoint

#: Posterior from which a language counts as identified.
LEAST_SCORE = 0.5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, learnt from those that are not held out; lang is what was found.

    Null and empty texts and those without a letter go, long ones are read whole; repeated rows share their fate. Without
    any labelled text, or without rows, nothing is left.
    """
    model = language_id.fit(docs.filter(~language_id.held_out("doc_id")))
    found = language_id.predict(docs, model, names=("_lang", "_score")).filter((F.col("_lang") != language_id.UNKNOWN) & (F.col("_score") >= LEAST_SCORE))
    return found.withColumn("lang", F.col("_lang")).select(docs.columns)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, as near_duplicates.deduplicate says for texts, keys and tables of any kind."""
    return near_duplicates.deduplicate(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind and n_chars counted anew.

    A null text stays null, an empty one empty; long ones are read whole, and repeated rows stay.
    """
    return personal_data.redact(docs, length="n_chars" if "n_chars" in docs.columns else None)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by the calibrated probabilities of the mix.

    Null texts have no tokens and the probability of their cell; repeated rows of a key share their fate, and rows with a
    null key stay. Texts may have any length. No rows in, no rows out.
    """
    some = mixing.mix(docs)
    gone = checkpoint(some.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id")).distinct())
    return pick(docs, gone, keep=False, key="doc_id")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens of each text, with decoded_ok: whether decoding gives the text back.

    A null text counts as empty and has no ids; texts may have any length. A row a row, no rows in, no rows out.
    """
    kept = ("doc_id", "lang", "source")
    coded = byte_bpe.encode(docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), keep=(*kept, "_sha"))
    return coded.select(*kept, "ids", F.size("ids").cast("long").alias("n_tokens"), (F.sha2(byte_bpe.decode(F.col("ids")), 256) == F.col("_sha")).alias("decoded_ok"))


STAGES = [("language_id", languages), ("near_dedup", duplicates), ("pii", privacy), ("mixing", mixture), ("bpe", tokens)]

#: SQL expresses neither the model of languages nor BagMinHash.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from all documents; each stage's result is a table, so that no stage is run twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return docs
