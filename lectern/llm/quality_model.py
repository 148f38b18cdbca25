"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence has two sources. Words are hashed to buckets, and one aggregation over labelled documents
counts in how many good and bad ones each bucket occurs; the mean log odds of a text's words is one measure, which leaves
out what the text's own label has added. Others are counts of marks, lines and repetitions. A logistic model of these,
fitted by Newton steps whose sums are aggregated over the cluster, gives the evidence. Both learn from MOST labelled
documents, so that texts need no shuffle to meet their labels; all labels count in the rates of sites. Odds are looked up
and sums made in Arrow batches: no plan names a table or a hundred sums, which the driver would hold and compile.

Sites and paths of sites have rates of good documents: a label counts as itself, other documents by their evidence. Path
rates are shrunk to their site's, site rates to that of all, each by as much as the spread between sites, or between the
paths of sites, tells (moments of the beta distribution). A document's posterior odds are its evidence times the odds of
its path over those of all, where the rates are those of the other documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import attach_groups, bound_batches, checkpoint, lean, let, read, words

STEPS = 8
RIDGE = 1.0
#: The concentration of a beta prior where groups do not differ at all: as good as their common mean alone.
FIRM = 1e12
#: Labelled documents that words and the logistic model are learnt from, by a hash of their keys; about, and no more.
MOST = 200_000
#: Buckets of hashed words, and what each is counted more in good and bad documents.
BUCKETS, SMOOTHING = 1 << 15, 1.0
THRESHOLD = 0.5
#: Measures of a text: eleven of its marks and lines, two of its words.
SIZE = 13


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def word_counts(rows: DataFrame) -> tuple[np.ndarray, float, float]:
    """By bucket the weights of good and bad documents of rows (text, y) that have it, and all of them.

    What reaches the driver is one row a bucket at most.
    """
    each = rows.select("y", F.explode(F.array_distinct(F.transform(words(F.col("text")), bucket))).alias("b"))
    found = each.groupBy("b").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad")).toArrow()
    out = np.zeros((BUCKETS, 2))
    out[found["b"].to_numpy()] = np.stack([found["good"].to_numpy(), found["bad"].to_numpy()], axis=1)
    s = rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    return out, s[0] or 0.0, s[1] or 0.0


def marks(text: Column) -> tuple[Column, Column]:
    """An array of measures of a text's marks and lines, each about 0 to 1 but the last, the first constant; the buckets
    of its different words, one a word."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))

    def marks_of(w: Column, n_kinds: Column) -> Column:
        k = F.greatest(F.size(w), F.lit(1))
        kinds = n_kinds / k
        chars = F.length(F.array_join(w, "")) / k
        part = lambda pattern, most: F.least(F.lit(1.0), F.regexp_count(t, F.lit(pattern)) / k * most)
        return F.array(F.lit(1.0), kinds, kinds * kinds, F.least(F.lit(1.0), chars / 12), part("[#*$%&<>]", 1.0), part("[|]", 2.0), part("!!", 1.0), F.least(F.lit(1.0), F.regexp_count(t, F.lit(r"\p{Lu}{2}")) / n * 4), part("[0-9]{2}", 2.0), part(r"[.](?:\s|$)", 4.0), F.log1p(k) / 10)

    both = let(words(text), lambda w: let(F.array_distinct(w), lambda kinds: F.struct(marks_of(w, F.size(kinds)).cast("array<double>").alias("marks"), F.transform(kinds, bucket).alias("b"))))
    return both["marks"], both["b"]


def word_evidence(row: np.ndarray, b: np.ndarray, y: np.ndarray, known: tuple[np.ndarray, float, float]) -> np.ndarray:
    """Mean log odds of the words of each text, 0 of one without words: word i is of text row[i], in bucket b[i]. y: labels of
    texts, nan for none, which the counts that known has are freed of."""
    (table, good, bad), own = known, y[row]
    g, x = table[b, 0], table[b, 1]
    has = ~np.isnan(own)
    one, other = np.where(has, own, 0.0), np.where(has, 1 - own, 0.0)
    odds = lambda n, all_: np.log(np.maximum(n + SMOOTHING, SMOOTHING) / np.maximum(all_ + 2 * SMOOTHING, SMOOTHING))
    value = odds(g - one, good - one) - odds(x - other, bad - other)
    return np.bincount(row, value, len(y)) / np.maximum(np.bincount(row, minlength=len(y)), 1)


def measured(texts: DataFrame, known: tuple[np.ndarray, float, float]) -> DataFrame:
    """id, host, part, own and x, an array of SIZE measures of a text; own: its label or null.

    What words tell is looked up in a broadcast by Arrow batches, so that no plan holds a table of it.
    """
    bound_batches(texts.sparkSession)
    shown, kinds = marks(F.col("text"))
    keep = ["id", "host", "part", "own"]
    rows = texts.select(*keep, shown.alias("marks"), kinds.alias("b"))
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, lists = batch.num_rows, batch.column(5)
            x = np.zeros((n, SIZE))
            x[:, : SIZE - 2] = batch.column(4).flatten().to_numpy().reshape(n, SIZE - 2)
            if known[1] and known[2]:
                y = pc.fill_null(batch.column(3), np.nan).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
                x[:, SIZE - 2] = word_evidence(row, lists.flatten().to_numpy(), y, known)
                x[:, SIZE - 1] = np.clip(x[:, SIZE - 2] * 4, -1.0, 1.0)
            out = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * SIZE, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], out], names=[*keep, "x"])

    return rows.mapInArrow(lean(work), rows.select(*keep, F.array(F.lit(0.0)).alias("x")).schema)


def sums(w: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (x, y) the slope and the bend of the log likelihood at weights w, as one row a number and task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            x, y = batch.column(0).flatten().to_numpy().reshape(-1, len(w)), batch.column(1).to_numpy()
            p = 1 / (1 + np.exp(-(x @ w)))
            own = np.concatenate([x.T @ (y - p), (x.T @ (x * (p * (1 - p))[:, None])).ravel()])
            out = own if out is None else out + own
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=["i", "v"])

    return work


def fit(rows: DataFrame, size: int) -> list[float]:
    """Weights of the measures x for labels y, over all rows: size * (size + 1) sums reach the driver at each step."""
    w = np.zeros(size)
    for _ in range(STEPS):
        found = rows.select("x", "y").mapInArrow(sums(w), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        if not found.num_rows:
            break
        s = found["v"].to_numpy()[np.argsort(found["i"].to_numpy())]
        step = np.linalg.solve(RIDGE * np.eye(size) + s[size:].reshape(size, size), s[:size] - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def firmness(n: float, around: float, spread: float, groups: int) -> float:
    """Concentration of the beta prior: n rows, the variance of their group rates around the prior mean times n, the sum
    over rows of p * (1 - p) at the prior mean, and the number of groups."""
    if n <= 0 or spread <= 0:
        return FIRM
    between = around / n - spread / n * groups / n
    return FIRM if between <= 0 else min(FIRM, max(1e-6, spread / n / between - 1))


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", host: str = "source", path: Column | None = None, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """One row a document: key, evidence, host_rate, path_rate, quality (the posterior) and kept (quality of THRESHOLD).

    labels has the key and 0 or 1, or null; of several for a key the mean counts. path tells parts of a host apart
    (default: its language). A null text is measured as empty, a text of any length whole. Documents with a null host
    count in no site and are at the rate of all; a null path is a part of its own. Without any label evidence is a half
    everywhere. host_rate and path_rate count the document itself; quality does not. Repeated rows each get a row; no
    rows in, no rows out. Other columns of docs are neither read nor returned.
    """
    part = F.coalesce((F.col("lang") if path is None else path).cast("string"), F.lit(""))
    given = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    given = checkpoint(given)
    n = given.count()
    some = given if n <= MOST else given.filter(F.pmod(F.xxhash64("id"), F.lit(10**6)) < int(0.98 * 10**6 * MOST / n))
    texts = docs.select(F.col(key).alias("id"), F.col(host).cast("string").alias("host"), part.alias("part"), F.col(text).alias("text"))
    texts = texts.join(F.broadcast(some.withColumnRenamed("y", "own")), "id", "left")
    known = word_counts(texts.filter("own is not null").withColumnRenamed("own", "y"))
    rows = checkpoint(measured(texts, known))
    weights = fit(rows.filter("own is not null").withColumnRenamed("own", "y"), SIZE)
    z = sum((F.get("x", F.lit(i)) * F.lit(v) for i, v in enumerate(weights)), F.lit(0.0))
    rows = rows.select("id", "host", F.concat_ws("\u0001", "host", "part").alias("path"), (1 / (1 + F.exp(-z))).alias("evidence")).join(given, "id", "left")
    rows = rows.withColumn("path", F.when(F.col("host").isNotNull(), F.col("path")))
    paths = checkpoint(rows.filter("host is not null").groupBy("path").agg(F.first("host").alias("host"), F.count("*").alias("n"), F.sum(F.coalesce("y", "evidence")).alias("good")))
    hosts = checkpoint(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")))
    s = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good"), F.sum(F.col("host_good") * F.col("host_good") / F.col("host_n")).alias("q"), F.count("*").alias("h")).first()
    n = s["n"] or 0
    mean = min(1 - 1e-6, max(1e-6, s["good"] / n)) if n else 0.5
    firm = firmness(n, (s["q"] or 0) - mean * mean * n, mean * (1 - mean) * n, s["h"])
    host_rate = lambda own, one: (F.col("host_good") - own + F.lit(mean * firm)) / (F.col("host_n") - one + F.lit(firm))
    paths = checkpoint(attach_groups(paths, hosts, "host", "host_n"))
    rate, own = host_rate(F.lit(0.0), F.lit(0)), F.col("good") / F.col("n")
    s = paths.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (own - rate) * (own - rate)).alias("a"), F.sum(F.col("n") * rate * (1 - rate)).alias("v"), F.count("*").alias("k")).first()
    path_firm = firmness(s["n"] or 0, s["a"] or 0, s["v"] or 0, s["k"])
    path_rate = lambda own, one: (F.col("good") - own + F.lit(path_firm) * host_rate(own, one)) / (F.col("n") - one + F.lit(path_firm))
    out = attach_groups(rows, checkpoint(paths.drop("host")), "path", "n")
    self = F.coalesce("y", "evidence")
    others = F.coalesce(path_rate(self, F.lit(1)), F.lit(mean))
    lift = logit(others) - F.lit(math.log(mean / (1 - mean)))
    quality = 1 / (1 + F.exp(-(logit(F.col("evidence")) + lift)))
    out = out.select(F.col("id").alias(key), "evidence", F.coalesce(host_rate(F.lit(0.0), F.lit(0)), F.lit(mean)).alias("host_rate"), F.coalesce(path_rate(F.lit(0.0), F.lit(0)), F.lit(mean)).alias("path_rate"), quality.alias("quality"))
    return out.withColumn("kept", F.col("quality") >= THRESHOLD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), read(spark, sf_dir, "labels", "doc_id", "quality"))
