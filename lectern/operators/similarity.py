"""Similar articles: exact TF-IDF over character n-grams, set similarities, weights and ranks.

Scores of queries against all come from `grams`, in blocks, while the vocabulary can be broadcast; beyond that, and for new
articles, whose corpus is their own, from `article_index`.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import chars, let, normal, windows
from . import article_index as A
from . import grams as G

SIZES = (2, 3, 4)
# Shares of the seven parts of a score, the threshold and how many are selected.
WEIGHTS = {"text": 0.60, "title": 0.10, "topics": 0.10, "entities": 0.05, "parameters": 0.05, "methods": 0.05, "scenarios": 0.05}
THRESHOLD, TOP = 0.35, 5


def grams(text: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    """All substrings of a text of these lengths, in an array; a shorter text has none."""
    return let(chars(text), lambda c: F.concat(*[windows(c, n) for n in sizes]))


def term_counts(articles: DataFrame, key: str, text: str) -> DataFrame:
    """Rows key, gram, c of the normal form of a text. For a vocabulary too large for `grams`."""
    return articles.select(key, F.explode(let(normal(F.col(text)), lambda s: grams(s))).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("c"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("gram").agg(F.count("*").alias("df"))


def tfidf(counts: DataFrame, articles: int) -> DataFrame:
    """counts with w, the count times ln((1 + N) / (1 + df)) + 1; the total of a document cancels in the cosine."""
    return counts.join(document_frequency(counts), "gram").withColumn("w", F.col("c") * (F.log(F.lit(1.0 + articles) / (1.0 + F.col("df"))) + 1.0)).drop("df")


def cosines(weights: DataFrame, key: str, is_query: Column) -> DataFrame:
    """Rows query, key, text_score of all pairs of a query and another article that share a gram."""
    norm = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = weights.filter(is_query).select(F.col(key).alias("query"), "gram", F.col("w").alias("qw"))
    dot = asked.join(weights, "gram").filter(F.col("query") != F.col(key)).groupBy("query", key).agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    out = dot.join(norm, key).join(norm.select(F.col(key).alias("query"), F.col("norm").alias("qnorm")), "query")
    return out.select("query", key, (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("text_score"))


def article_cosines(articles: DataFrame, key: str, text: str, is_query: Column, least: float = 0.0, top: int | None = None, most: int = G.VOCABULARY) -> DataFrame:
    """query, key, text_score of pairs that share a gram; least and top are what the caller keeps, as `grams.cosines` says."""
    found = G.cosines(articles, key, text, is_query, least, top, most)
    return A.cosines(A.build(articles, key, text, most), articles.filter(is_query), text, least, top, own=False) if found is None else found


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


@F.pandas_udf(DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching blocks of two normal forms, as difflib counts them; not symmetric."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def rounded(score: Column) -> Column:
    """Between 0 and 1, to six places; halves go to the even digit."""
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6)


def final_score(parts: dict[str, Column]) -> Column:
    """The weighted sum of unrounded parts, between 0 and 1, to six places."""
    return rounded(sum((F.lit(w) * parts[k] for k, w in WEIGHTS.items()), F.lit(0.0)))


def ranked(scored: DataFrame, query: str, key: str, score: str, top: int = TOP, threshold: float = THRESHOLD) -> DataFrame:
    """scored with rank (ties to the smaller key), over_threshold and selected: over it and among the top of those."""
    order = Window.partitionBy(query).orderBy(F.desc(score), key)
    out = scored.withColumn("rank", F.row_number().over(order)).withColumn("over_threshold", F.col(score) >= threshold)
    return out.withColumn("selected", F.col("over_threshold") & (F.col("rank") <= top))


LISTS = ["topics", "technical_entities", "key_parameters", "methods", "application_scenarios", "validation_methods"]


def score_parts(text: Column) -> dict[str, Column]:
    """The seven parts of the score of a row of a query, whose columns begin with q_, and an article."""
    terms = lambda c: F.array_distinct(F.filter(F.transform(c, normal), lambda x: x != ""))
    of = lambda *names: jaccard(terms(F.concat(*[F.col(f"q_{x}") for x in names])), terms(F.concat(*[F.col(x) for x in names])))
    return {
        "text": text,
        "title": title_ratio(normal(F.col("q_title")), normal(F.col("title"))),
        "topics": of("topics"),
        "entities": of("technical_entities"),
        "parameters": of("key_parameters"),
        "methods": of("methods"),
        "scenarios": of("application_scenarios", "validation_methods"),
    }


def score_articles(query: DataFrame, index: DataFrame) -> DataFrame:
    """Scores of one or more query articles with every article of an index, each over the corpus of the query and these.

    Both have document_id, title, content and arrays topics, technical_entities, key_parameters, methods,
    application_scenarios and validation_methods. The corpus of a query is itself and all rows of the index but its own;
    an article without content has no candidates. As every pair gets its row, this is for audits of a few queries:
    new_articles finds those that reach the threshold among any number.
    """
    q = query.filter(F.length("content") > 0).select(F.col("document_id").alias("query"), *[F.col(c).alias(f"q_{c}") for c in ["title", *LISTS]])
    text = A.cosines(A.build(index, "document_id", "content"), query.filter(F.length("content") > 0), "content")
    rows = q.join(index, F.col("query") != F.col("document_id")).join(text, ["query", "document_id"], "left")
    parts = score_parts(F.coalesce("text_score", F.lit(0.0)))
    named = rows.select("query", "document_id", *[v.alias(f"_{k}") for k, v in parts.items()])
    return named.select("query", "document_id", *[rounded(F.col(f"_{k}")).alias(k) for k in parts], final_score({k: F.col(f"_{k}") for k in parts}).alias("final"))


def new_articles(query: DataFrame, articles: DataFrame, index: A.Index | None = None, threshold: float = THRESHOLD, top: int = TOP) -> DataFrame:
    """query, document_id, final and rank of the best articles for new or changed ones; columns as score_articles has them.

    index is that of articles, kept from before; each query has the corpus that score_articles gives it.
    """
    asked = query.filter(F.length("content") > 0)
    index = A.build(articles, "document_id", "content") if index is None else index
    found = A.best_articles(index, articles, asked, "content", LISTS, "title", lambda _: final_score(score_parts(F.col("text_score"))), WEIGHTS, threshold)
    return ranked(found, "query", "document_id", "final", top, threshold).filter("selected").select("query", "document_id", "final", "rank")
