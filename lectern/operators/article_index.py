"""An index of articles for new and changed ones: what a query changes is corrected, nothing of the index is made again.

Each query has a corpus of its own: itself, and all articles of the index but its own old row. So the number of articles
N and the document frequency df of a gram differ by query, and with them the weight ln((1 + N) / (1 + df)) + 1 of every
gram. The index keeps the grams of each article as numbers, their frequencies, and three sums of an article over its
grams, of c², c² l and c² l², where c is a count and l = ln(1 + df). For any N the squared length of an article is a
quadratic of ln(1 + N) + 1 in these sums; grams that the query or its old row has are the only ones whose df differs, and
they are met anyway when products are summed. A block of queries is one scan of the index, without a shuffle of it, and
no pair exists before a gram is shared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal
from ..steps import step
from . import grams as G

#: Grams with at least one in so many of all articles meet the rows of articles by broadcast, others in a shuffle.
COMMON = 100
#: A query's grams on the driver: number, weight in products, what a squared count adds to a squared length, squared idf.
QUERY = "query {kind}, codes array<long>, dots array<double>, more array<double>, squares array<double>, a double, norm double"


class Index(NamedTuple):
    """vectors: key, n, codes, counts, s0, s1, s2 of all articles, also of those without grams; df: code, df; n: how many.

    codes and counts are the bytes of n numbers, of 8 and, by `grams.packed`, fewer bytes each.
    """

    vectors: DataFrame
    df: DataFrame
    n: int
    key: str


def vectors_of(articles: DataFrame, key: str, text: str, more: Callable = lambda grams: [], schema: str = "") -> DataFrame:
    """key, n, codes (in order) and counts of each article, and what more makes of them; no grams for a null or short text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(first, G.TEXTS) for b in batches for first in range(0, b.num_rows, G.TEXTS)):
            found = [G.coded(t.as_py()) for t in b.column(1)]
            rows = [(key, b.column(0)), ("n", pa.array([len(c) for c, _ in found], pa.int64())), ("codes", pa.array([c.tobytes() for c, _ in found], pa.binary())), ("counts", pa.array([G.packed(n) for _, n in found], pa.binary())), *more(found)]
            yield pa.RecordBatch.from_arrays([x for _, x in rows], names=[name for name, _ in rows])

    kind = articles.schema[key].dataType.simpleString()
    return G.texts(articles, key, text).mapInArrow(work, f"`{key}` {kind}, n long, codes binary, counts binary{schema}")


def vector(n: int, codes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(codes, np.int64), G.unpacked(counts, n).astype(np.float64) if n else np.zeros(0)


def exploded(rows: DataFrame, name: str) -> DataFrame:
    """name, code and c, a row a gram."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(first, G.TEXTS) for b in batches for first in range(0, b.num_rows, G.TEXTS)):
            found = [vector(*x) for x in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            of = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), [len(c) for c, _ in found])))
            yield pa.RecordBatch.from_arrays([of, *[pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1)]], names=[name, "code", "c"])

    return rows.select(name, "n", "codes", "counts").mapInArrow(work, f"`{name}` {rows.schema[name].dataType.simpleString()}, code long, c double")


def summed_vectors(articles: DataFrame, key: str, text: str, df: DataFrame) -> DataFrame:
    """vectors_of with s0, s1 and s2, by a broadcast of the logarithms of all frequencies."""
    found = df.toArrow()
    code, n = (found.column(c).to_numpy() for c in ("code", "df"))
    order = np.argsort(code)
    shared = articles.sparkSession.sparkContext.broadcast((code[order], np.log(1.0 + n[order])))

    def sums(grams: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[str, pa.Array]]:
        codes, logs = shared.value
        out = np.zeros((len(grams), 3))
        for i, (code, c) in enumerate(grams):
            log, square = logs[np.searchsorted(codes, code)], c.astype(np.float64) ** 2
            out[i] = square.sum(), square @ log, square @ (log * log)
        return [(f"s{i}", pa.array(out[:, i])) for i in range(3)]

    return vectors_of(articles, key, text, sums, ", s0 double, s1 double, s2 double")


def build(articles: DataFrame, key: str, text: str, most: int = G.VOCABULARY) -> Index:
    """The index of articles, whose keys should differ; a null key keeps its row. Up to most different grams their
    frequencies are broadcast for the sums, else they are joined."""
    n, df = articles.count(), step(G.frequencies(articles, text))
    if df.count() <= most:
        return Index(step(summed_vectors(articles, key, text, df)), df, n, key)
    rows = step(vectors_of(articles, key, text).withColumn("row", F.monotonically_increasing_id()))
    each = exploded(rows, "row")
    common = F.broadcast(df.filter(F.col("df") * COMMON >= n))
    rare = each.join(common.select("code"), "code", "left_anti").join(df.filter(F.col("df") * COMMON < n), "code")
    squares, logs = F.col("c") * F.col("c"), F.log(1.0 + F.col("df"))
    sums = each.join(common, "code").unionByName(rare).groupBy("row").agg(F.sum(squares).alias("s0"), F.sum(squares * logs).alias("s1"), F.sum(squares * logs * logs).alias("s2"))
    return Index(step(rows.join(sums, "row", "left").drop("row").fillna(0.0, ["s0", "s1", "s2"])), df, n, key)


def save(index: Index, path: str) -> None:
    index.vectors.write.parquet(f"{path}/vectors")
    index.df.write.parquet(f"{path}/df")
    index.vectors.sparkSession.createDataFrame([(index.n, index.key)], "n long, key string").coalesce(1).write.parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> Index:
    about = spark.read.parquet(f"{path}/about").first()
    return Index(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/df"), about["n"], about["key"])


def corrected(index: Index, new: DataFrame, before: DataFrame | None) -> DataFrame:
    """Queries as QUERY has them, by a broadcast of all frequencies, without a row a gram.

    new: query, n, codes, counts; before: the same of their old rows, or None where the corpus is the index as it is.
    """
    found = index.df.toArrow()
    code, n = (found.column(c).to_numpy() for c in ("code", "df"))
    order = np.argsort(code)
    shared, size, own = new.sparkSession.sparkContext.broadcast((code[order], n[order])), index.n, before is not None
    kind = new.schema["query"].dataType.simpleString()
    rows = new.join(before.groupBy("query").agg(F.collect_list("codes").alias("old")), "query", "left") if own else new.withColumn("old", F.lit(None).cast("array<binary>"))

    def of_query(n: int, codes: bytes, counts: bytes, old: list[bytes] | None) -> tuple:
        known, frequency = shared.value
        new, c = vector(n, codes, counts)
        gone = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in old or []] or [new[:0]]))
        grams = np.union1d(new, gone)
        count = np.zeros(len(grams))
        count[np.searchsorted(grams, new)] = c
        at = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
        df = np.where(known[at] == grams, frequency[at], 0) if len(known) else np.zeros(len(grams))
        total = size + (1 - bool(old) if own else 0)
        idf = np.log((1.0 + total) / (1.0 + df + ((count > 0).astype(int) - np.isin(grams, gone) if own else 0))) + 1.0
        a = np.log(1.0 + total) + 1.0
        square = idf * idf
        return grams, count * square, square - (a - np.log(1.0 + df)) ** 2 if own else np.zeros(len(grams)), square, a, np.sqrt(count * count @ square)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(first, G.TEXTS) for b in batches for first in range(0, b.num_rows, G.TEXTS)):
            found = [of_query(*x) for x in zip(*(b.column(c).to_pylist() for c in ("n", "codes", "counts", "old")), strict=True)]
            end = pa.array(np.r_[0, np.cumsum([len(f[0]) for f in found])], pa.int32())
            lists = [pa.ListArray.from_arrays(end, pa.array(np.concatenate([f[i] for f in found]))) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("query"), *lists, *[pa.array([f[i] for f in found], pa.float64()) for i in (4, 5)]], names=["query", "codes", "dots", "more", "squares", "a", "norm"])

    return rows.select("query", "n", "codes", "counts", "old").mapInArrow(work, QUERY.format(kind=kind))


def asked(index: Index, queries: DataFrame, text: str, own: bool = True, most: int = G.VOCABULARY) -> DataFrame:
    """Queries that have grams as QUERY has them; queries: the index's key, each once, and text.

    own: a query's corpus is as above; without it, the corpus is the index as it is, of which queries are a part. Up to most
    different grams their frequencies are broadcast, else they are joined.
    """
    key = index.key
    new = step(vectors_of(queries, key, text).filter("n > 0")).withColumnRenamed(key, "query")
    of = new.select("query").withColumn("has_old", F.lit(0))
    before = index.vectors.join(F.broadcast(new.select(F.col("query").alias(key))), key).select(F.col(key).alias("query"), "n", "codes", "counts")
    if index.df.count() <= most:
        return corrected(index, new, before if own else None)
    rows = exploded(new, "query").withColumn("old", F.lit(0))
    if own:
        rows = rows.unionByName(exploded(before, "query").select("query", "code", F.lit(0.0).alias("c"), F.lit(1).alias("old")))
        of = new.select("query").join(before.select("query", F.lit(1).alias("has_old")), "query", "left").fillna(0, ["has_old"])
    grams = rows.groupBy("query", "code").agg(F.sum("c").alias("c"), F.max("old").alias("old")).join(index.df, "code", "left").join(of, "query")
    n = F.lit(index.n) + (1 - F.col("has_old") if own else 0)
    df = F.coalesce("df", F.lit(0)) + ((F.col("c") > 0).cast("int") - F.col("old") if own else 0)
    idf = F.log((1.0 + n) / (1.0 + df)) + 1.0
    a = F.log(1.0 + n) + 1.0
    plain = a - F.log(1.0 + F.coalesce("df", F.lit(0)))
    made = grams.select("query", "code", a.alias("a"), (F.col("c") * idf * idf).alias("dot"), (idf * idf - plain * plain if own else F.lit(0.0)).alias("more"), (idf * idf).alias("square"), (F.col("c") * idf).alias("w"))
    out = made.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("code", "dot", "more", "square"))).alias("g"), F.first("a").alias("a"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return out.select("query", F.col("g.code").alias("codes"), F.col("g.dot").alias("dots"), F.col("g.more").alias("more"), F.col("g.square").alias("squares"), "a", "norm")


class Block(G.Block):
    """Queries of one scan by their own grams, with what their lengths are made of."""

    def __init__(self, found: pa.Table):
        lists = found.column("codes").combine_chunks()
        flat = lambda c: found.column(c).combine_chunks().flatten().to_numpy()
        query = np.repeat(np.arange(found.num_rows, dtype=np.int32), lists.value_lengths().to_numpy())
        self.codes, at = np.unique(flat("codes"), return_inverse=True)
        super().__init__(len(self.codes), at, query, flat("dots"), found.column("query").to_pylist(), flat("more"), flat("squares") if "squares" in found.column_names else None)
        self.a, self.norm = found.column("a").to_numpy(), found.column("norm").to_numpy()

    def met(self, codes: list[np.ndarray], counts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and counts of the grams of articles that a query has."""
        out = []
        for code, c in zip(codes, counts, strict=True):
            at = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
            on = self.codes[at] == code if len(self.codes) else np.zeros(len(code), bool)
            out.append((at[on], c[on].astype(np.float64)))
        return out

    def cosine(self, s: tuple, j: np.ndarray | slice, dot: np.ndarray, more: np.ndarray | float = 0.0) -> np.ndarray:
        """0 where no gram is shared; s are three sums of articles, j their queries."""
        square = self.a[j] ** 2 * s[0] - 2 * self.a[j] * s[1] + s[2] + more
        with np.errstate(all="ignore"):
            return np.where((dot > 0) & (square > 0), dot / np.sqrt(square) / self.norm[j], 0.0)

    def exact_cosine(self, grams: list, s: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.cosine(tuple(s[i].T), j, *self.exact(grams, i, j))


def blocks_of(queries: DataFrame, postings: int) -> Iterator[Block]:
    """Blocks of queries of at most about so many grams; queries as asked makes them."""
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("codes").cast("long")), F.lit(0))).first()
    several = max(-(-size // postings), -(-n // G.QUERIES))
    for i in range(several):
        found = queries.filter(F.pmod(F.xxhash64("query"), F.lit(several)) == i).toArrow()
        if found.num_rows:
            yield Block(found)


def scanned(index: Index, block: Block, kind: type, emit: Callable, schema: str) -> DataFrame:
    """emit(block)(keys, grams, sums, scores) as batches, for TEXTS articles of the index at a time."""
    shared = index.vectors.sparkSession.sparkContext.broadcast(block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        own.prepare(kind)
        out = emit(own)
        for b in batches:
            for first in range(0, b.num_rows, G.TEXTS):
                part = b.slice(first, G.TEXTS)
                held = [vector(*x) for x in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
                grams = own.met(*zip(*held, strict=True))
                s = np.stack([part.column(i).to_numpy() for i in (4, 5, 6)], axis=1)
                score = own.cosine((s[:, :1], s[:, 1:2], s[:, 2:]), slice(None), *own.products(part.column(0).to_pylist(), grams))
                yield from out(part.column(0), grams, s, score)

    return index.vectors.select(index.key, "n", "codes", "counts", "s0", "s1", "s2").mapInArrow(work, schema)


def cosines(index: Index, queries: DataFrame, text: str, least: float = 0.0, top: int | None = None, own: bool = True, postings: int = G.POSTINGS) -> DataFrame:
    """query, the index's key and text_score of pairs that share a gram; least, top: as `grams.cosines` says; own: as asked."""
    key, kind = index.key, index.vectors.schema[index.key].dataType.simpleString()
    schema = f"query {kind}, `{key}` {kind}, text_score double"

    def emit(block: Block):
        best = G.Best(len(block.names), least, top, block.unsure()) if top else None

        def found(keys: pa.Array, grams: list, s: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
            i, j = best.pairs(score) if top else np.nonzero((score > 0) & (score >= least - G.SLACK))
            exact = block.exact_cosine(grams, s, i, j) if top else score[i, j]
            yield pa.RecordBatch.from_arrays([pa.array(block.names, keys.type).take(pa.array(j)), keys.take(pa.array(i)), pa.array(exact)], names=["query", key, "text_score"])

        return found

    out = index.vectors.sparkSession.createDataFrame([], schema)
    for i, block in enumerate(blocks_of(step(asked(index, queries, text, own)), postings)):
        found = scanned(index, block, np.float32 if top else np.float64, emit, schema)
        out = found if i == 0 else out.unionByName(found)
    return out


def tallies(index: Index, queries: DataFrame, text: str, least: float, own: bool = True, postings: int = G.POSTINGS) -> DataFrame:
    """query, scored (articles that share a gram) and over (scores of at least least, to six places), counted in tasks."""
    kind = index.vectors.schema[index.key].dataType.simpleString()
    schema = f"query {kind}, scored long, over long"

    def emit(block: Block):
        numbers = G.counted(block, least)

        def found(keys: pa.Array, grams: list, s: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
            columns = numbers(score, lambda i, j: block.exact_cosine(grams, s, i, j))
            yield pa.RecordBatch.from_arrays([pa.array(block.names, keys.type), *[pa.array(x, pa.int64()) for x in columns]], names=["query", "scored", "over"])

        return found

    parts = [scanned(index, block, np.float32, emit, schema) for block in blocks_of(step(asked(index, queries, text, own)), postings)]
    out = index.vectors.sparkSession.createDataFrame([], schema)
    for i, part in enumerate(parts):
        out = part if i == 0 else out.unionByName(part)
    return out.groupBy("query").agg(F.sum("scored").alias("scored"), F.sum("over").alias("over")).filter("scored > 0")


def pair_cosines(index: Index, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """query, the index's key and text_score of given pairs (query, key), 0 included; queries as asked makes them."""
    key, kind = index.key, index.vectors.schema[index.key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                codes, counts = vector(r["n"], r["codes"], r["counts"])
                _, at, of = np.intersect1d(codes, np.array(r["q_codes"], dtype=np.int64), assume_unique=True, return_indices=True)
                c = counts[at]
                square = r["a"] ** 2 * r["s0"] - 2 * r["a"] * r["s1"] + r["s2"] + c * c @ np.array(r["more"])[of]
                dot = c @ np.array(r["dots"])[of]
                out.append(dot / np.sqrt(square) / r["norm"] if dot > 0 and square > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column(key), pa.array(out, pa.float64())], names=["query", key, "text_score"])

    rows = pairs.select("query", key).join(queries.withColumnRenamed("codes", "q_codes"), "query").join(index.vectors, key)
    return rows.mapInArrow(work, f"query {kind}, `{key}` {kind}, text_score double")


def candidates(queries: DataFrame, articles: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """query and key of pairs that share a term of one of the lists, in its normal form, and are not of one key.

    Terms that very many articles have make as many pairs, as each may lift a score over the threshold.
    """
    of = lambda df, name: df.select(F.col(key).alias(name), F.explode(F.array(*[F.struct(F.lit(i).alias("of"), F.array_distinct(F.transform(t, normal)).alias("t")) for i, t in enumerate(terms)])).alias("e")).select(name, "e.of", F.explode("e.t").alias("term")).filter("term <> ''")
    met = of(queries, "query").join(of(articles, key), ["of", "term"]).filter(F.col("query") != F.col(key))
    return met.select("query", key).distinct()


def best_articles(index: Index, articles: DataFrame, queries: DataFrame, text: str, lists: list[str], title: str, score: Callable[[DataFrame], Column], shares: dict[str, float], threshold: float, postings: int = G.POSTINGS) -> DataFrame:
    """query, key, text_score and final of the articles whose final score with a query reaches the threshold.

    score makes the final score of a row of both (a query's columns begin with q_) and its text_score; shares are the
    greatest parts of it by text, title and lists. A pair that shares no term needs a text of its own to reach the
    threshold, which the scan looks for; pairs that share one are looked at one by one.
    """
    key = index.key
    alone = (threshold - shares["title"]) / shares["text"] - G.SLACK
    found = cosines(index, queries, text, alone, None, True, postings)
    shared = candidates(queries, articles, key, lists)
    own = pair_cosines(index, step(asked(index, queries, text)), shared)
    every = shared.join(own, ["query", key], "left").fillna(0.0, ["text_score"])
    every = every.unionByName(found.join(shared, ["query", key], "left_anti"))
    named = queries.select(F.col(key).alias("query"), *[F.col(c).alias(f"q_{c}") for c in (title, *lists)])
    rows = every.join(named, "query").join(articles.select(key, title, *lists), key)
    return rows.select("query", key, "text_score", score(rows).alias("final")).filter(F.col("final") >= threshold)

