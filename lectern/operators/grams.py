"""Character n-grams as numbers: counts, document frequencies and cosines in Arrow batches, without a row a gram.

A normal form has 21,028 different characters, of 15 bits each, so that up to four of them are one exact 60-bit number, and
the first is never 0, so that grams of different lengths differ. Texts are worked on one by one, whole; a null or empty
text has no grams. Only numbers with their document frequencies are shuffled, counted within a task before. Where pairs
are scored, the places and counts of grams are written once, and blocks of queries read these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..steps import step

#: Different grams up to which their weights are broadcast, 16 bytes each. Latin letters and digits have 1.73 million.
VOCABULARY = 4 << 20
#: Grams of all queries of a block, 12 bytes each.
POSTINGS = 8 << 20
#: Texts scored at once, queries of a block, and numbers counted in a task before they are sent on.
TEXTS, QUERIES, TALLY = 256, 4096, 1 << 20
#: Grams of at least a part in SHARE of a block's queries, HOT of them at most or half as many where every score is needed
#: in double precision, are a dense matrix of 128 MB at most.
HOT, SHARE = 8192, 20
#: Where pairs are looked for, what a gram may change of its own part of a squared length without a correction.
LENGTHS = 1e-3
#: What a score may lack to the least one or the last of the best and still be sent on, to be rounded and ranked there.
SLACK = 2e-6


def digits() -> np.ndarray:
    """The number of each character in a normal form by its code point below 65,536, 0 of those that have none.

    Outside ASCII only a dotted capital i and the Kelvin sign have Latin letters as lower case.
    """
    out = np.zeros(1 << 16, np.int64)
    out[48:58], out[97:123] = np.arange(1, 11), np.arange(11, 37)
    out[65:91], out[0x130], out[0x212A] = out[97:123], out[ord("i")], out[ord("k")]
    out[0x4E00:0xA000] = np.arange(37, 37 + 0x5200)
    return out


DIGITS = digits()


def coded(text: bytes | str | None) -> tuple[np.ndarray, np.ndarray]:
    """The grams of two to four characters of a text's normal form as numbers, in order, and how often each is there."""
    text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text or ""
    c = DIGITS[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0xFFFF)]
    c = c[c > 0]
    at, parts = c, []
    for n in (1, 2, 3):
        at = at[:-1] << 15 | c[n:]
        parts.append(at)
    return np.unique(np.concatenate(parts), return_counts=True)


def spelled(codes: np.ndarray) -> np.ndarray:
    """The grams that numbers stand for."""
    size = 2 + (codes >> 30 > 0) + (codes >> 45 > 0)
    digits = np.stack([np.where(i < size, codes >> np.maximum(15 * (size - 1 - i), 0) & 32767, 0) for i in range(4)], axis=1)
    points = np.select([digits == 0, digits <= 10, digits <= 36], [0, digits + 47, digits + 86], digits + 0x4E00 - 37)
    return np.ascontiguousarray(points.astype(np.uint32)).view("<U4").ravel()


def texts(articles: DataFrame, key: str, text: str) -> DataFrame:
    """key and the bytes of a text, which may be no UTF-8; `coded` makes its normal form, far faster than an expression."""
    return articles.select(F.col(key), F.col(text).cast("binary").alias("s"))


def by_text(measured: Callable[[bytes | None], tuple], kind: pa.DataType, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a key and a text become the key and the numbers of its text; the grams of one text are held at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measured(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([x[i] for x in found], kind) for i in range(len(names) - 1)]], names=names)

    return work


def measures(articles: DataFrame, key: str, text: str) -> DataFrame:
    """key, grams (different ones), total and most (of one gram) of each text that has grams; no shuffle."""

    def measured(text: bytes | None) -> tuple[int, int, int]:
        counts = coded(text)[1]
        return len(counts), int(counts.sum()), int(counts.max(initial=0))

    kind = articles.schema[key].dataType.simpleString()
    work = by_text(measured, pa.int64(), [key, "grams", "total", "most"])
    return texts(articles, key, text).mapInArrow(work, f"`{key}` {kind}, grams long, total long, most long").filter("grams > 0")


def frequencies(articles: DataFrame, text: str) -> DataFrame:
    """code and df, in how many texts a gram is: counted within tasks, then by number."""

    def tallied(parts: list[np.ndarray]) -> pa.RecordBatch:
        codes, df = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(df, pa.int64())], names=["code", "df"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            for t in b.column(0):
                parts.append(coded(t.as_py())[0])
                size += len(parts[-1])
                if size >= TALLY:
                    yield tallied(parts)
                    parts, size = [], 0
        if size:
            yield tallied(parts)

    rows = articles.select(F.col(text).cast("binary").alias("s")).mapInArrow(work, "code long, df long")
    return rows.groupBy("code").agg(F.sum("df").alias("df"))


def gram_frequencies(articles: DataFrame, text: str) -> DataFrame:
    """gram and df."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = pa.array(spelled(b.column(0).to_numpy()).tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([grams, b.column(1)], names=["gram", "df"])

    return frequencies(articles, text).mapInArrow(work, "gram string, df long")


def vocabulary(articles: DataFrame, text: str, most: int = VOCABULARY):
    """A broadcast of all numbers in order and their weights ln((1 + N) / (1 + df)) + 1; None if there are too many."""
    found = frequencies(articles, text).limit(most + 1).toArrow()
    if found.num_rows > most:
        return None
    codes, df = (found.column(c).to_numpy() for c in ("code", "df"))
    order = np.argsort(codes)
    return articles.sparkSession.sparkContext.broadcast((codes[order].astype(np.int64), np.log((1.0 + articles.count()) / (1.0 + df[order])) + 1.0))


def weighed(text: str | None, codes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the vocabulary and weights of a text's grams."""
    found, counts = coded(text)
    at = np.searchsorted(codes, found)
    return at, counts * idf[at]


def norms(articles: DataFrame, key: str, text: str, words) -> DataFrame:
    """key, norm and most, the length of the vector of weights and its largest part, of each text that has grams."""

    def measured(text: bytes | None) -> tuple[float, float]:
        w = weighed(text, *words.value)[1]
        return float(np.sqrt(w @ w)), float(w.max(initial=0))

    work = by_text(measured, pa.float64(), [key, "norm", "most"])
    kind = articles.schema[key].dataType.simpleString()
    return texts(articles, key, text).mapInArrow(work, f"`{key}` {kind}, norm double, most double").filter("norm > 0")


def taken(begin: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the postings of some grams, gram after gram, and how many each has."""
    n = begin[at + 1] - begin[at]
    return np.repeat(begin[at] - np.cumsum(n) + n, n) + np.arange(n.sum()), n


class Block:
    """The grams of queries of one scan: where the postings of each begin, their queries and weights in products.

    more, if given, is what a squared value of an article's gram adds to its squared length for that query, and square
    what it is there in all, 1 at least.
    """

    def __init__(self, grams: int, at: np.ndarray, query: np.ndarray, dot: np.ndarray, names: list, more: np.ndarray | None = None, square: np.ndarray | None = None):
        order = np.argsort(at, kind="stable")
        self.begin = np.searchsorted(at[order], np.arange(grams + 1))
        self.query, self.dot, self.names = query[order], dot[order], names
        self.more = more[order] if more is not None and more.any() else None
        self.part = None if self.more is None else np.abs(self.more) / (1.0 if square is None else square[order])

    def prepare(self, kind: type) -> None:
        """Dense matrices of hot grams and the grams of each query; made in a task, as they are larger than what they are from."""
        held = np.diff(self.begin)
        hot = np.argsort(-held, kind="stable")[: HOT * 4 // np.dtype(kind).itemsize]
        hot = hot[held[hot] * SHARE >= max(len(self.names), 1)]
        self.kind, self.column = kind, np.full(len(held), -1, np.int32)
        self.column[hot] = np.arange(len(hot))
        self.hot = [self.dense(hot, self.dot)]
        # Single precision corrects lengths by the grams that change them most only; `unsure` bounds what that makes of a score.
        self.length_error = np.zeros(len(self.names))
        if self.more is not None and kind is np.float64:
            self.hot.append(self.dense(hot, self.more))
        elif self.more is not None:
            much = self.part > LENGTHS
            np.maximum.at(self.length_error, self.query[~much], self.part[~much])
            self.much = np.r_[0, np.cumsum(much)][self.begin], self.query[much], self.more[much]
        order = np.argsort(self.query, kind="stable")
        self.start = np.searchsorted(self.query[order], np.arange(len(self.names) + 1))
        self.of_query = [np.repeat(np.arange(len(held), dtype=np.int32), held)[order], self.dot[order], *([] if self.more is None else [self.more[order]])]
        self.whole = np.zeros(len(held))
        self.place: dict = {}
        for i, name in enumerate(self.names):
            self.place.setdefault(name, []).append(i)

    def dense(self, hot: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.zeros((len(hot), len(self.names)), self.kind)
        for i, g in enumerate(hot):
            out[i, self.query[self.begin[g] : self.begin[g + 1]]] = weight[self.begin[g] : self.begin[g + 1]]
        return out

    def products(self, keys: list, grams: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Of articles, a row each, with all queries: sums of dot and, if there is one, of more; 0 for a query's own article."""
        shape = len(grams), len(self.names)
        out = [np.zeros(shape, self.kind if i == 0 else np.float64) for i in range(1 + (self.more is not None))]
        common = np.zeros((len(grams), len(self.hot[0])), self.kind)
        for i, (at, v) in enumerate(grams):
            if self.more is not None and self.kind is not np.float64:
                begin, query, more = self.much
                take, n = taken(begin, at)
                out[1][i] = np.bincount(query[take], more[take] * np.repeat(v * v, n), shape[1])
            of = self.column[at]
            common[i, of[of >= 0]] = v[of >= 0]
            at, v = at[of < 0], v[of < 0].astype(np.float64)
            take, n = taken(self.begin, at)
            query = self.query[take]
            out[0][i] = np.bincount(query, self.dot[take] * np.repeat(v, n), shape[1])
            if len(self.hot) > 1:
                out[1][i] = np.bincount(query, self.more[take] * np.repeat(v * v, n), shape[1])
        out[0] += common @ self.hot[0]
        if len(self.hot) > 1:
            out[1] += (common * common) @ self.hot[1]
        for i, name in enumerate(keys):
            out[0][i, self.place.get(name, [])] = 0
        return out

    def unsure(self) -> np.ndarray:
        """Greatest part by which a score of each query from `products` in single precision differs from the exact one.

        Its terms are not negative, so that K of them, rounded, are off by K + 4 roundings at most. A squared length lacks at
        most the greatest part of a term that more left out is.
        """
        most = np.minimum(self.length_error, 0.5)
        return np.where(self.length_error > 0.5, np.inf, (len(self.hot[0]) + 8) * 2.0**-24 + most)

    def exact(self, grams: list[tuple[np.ndarray, np.ndarray]], i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        """What `products` gives of pairs of article i and query j, in double precision; i in order."""
        out = [np.zeros(len(i)) for _ in range(1 + (self.more is not None))]
        before = -1
        for k, (row, query) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            if row != before:
                if before >= 0:
                    self.whole[grams[before][0]] = 0
                self.whole[grams[row][0]] = grams[row][1]
                before = row
            places, *values = (x[self.start[query] : self.start[query + 1]] for x in self.of_query)
            v = self.whole[places]
            for x, value in zip(out, values, strict=True):
                x[k], v = v @ value, v * v
        if before >= 0:
            self.whole[grams[before][0]] = 0
        return out


class Best:
    """The pairs of a task that may be among the top of their queries and reach least, batch after batch."""

    def __init__(self, queries: int, least: float, top: int, unsure: np.ndarray):
        self.best, self.least, self.unsure = np.zeros((top, queries)), least, unsure

    def reaching(self, score: np.ndarray) -> np.ndarray:
        wanted = (np.maximum(self.least, self.best[0] / (1 + self.unsure)) - SLACK) * np.maximum(1 - self.unsure, 0)
        return (score > 0) & (score >= (wanted * (1 - 2.0**-20)).astype(score.dtype))

    def pairs(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Articles (in order) and queries of scores, a row an article, that may be among the best so far."""
        keep = self.reaching(score)
        seen = np.flatnonzero(keep.any(axis=0))
        every = np.concatenate([self.best[:, seen], np.where(keep[:, seen], score[:, seen], 0)])
        self.best[:, seen] = np.partition(every, len(every) - len(self.best), axis=0)[-len(self.best) :]
        return np.nonzero(keep & self.reaching(score))


def packed(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the greatest needs; read and written at once, which Spark's lists are not."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def unpacked(held: bytes, n: int) -> np.ndarray:
    return np.frombuffer(held, f"u{len(held) // n}")


def placed(articles: DataFrame, key: str, text: str, is_query: Column, words) -> DataFrame:
    """key, asked, n, and by `packed` steps of places in the vocabulary and counts of the n grams of each text that has
    any; written once, so that no scan makes grams again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = words.value[0]
        for b in batches:
            found = [coded(t.as_py()) for t in b.column(2)]
            at = [packed(np.diff(np.searchsorted(codes, c), prepend=0)) for c, _ in found]
            rows = [pa.array([len(c) for c, _ in found], pa.int64()), pa.array(at, pa.binary()), pa.array([packed(n) for _, n in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *rows], names=[key, "asked", "n", "at", "counts"])

    kind = articles.schema[key].dataType.simpleString()
    rows = articles.select(F.col(key), is_query.alias("asked"), F.col(text).cast("binary").alias("s"))
    return step(rows.mapInArrow(work, f"`{key}` {kind}, asked boolean, n long, at binary, counts binary").filter("n > 0"))


def unit(rows: pa.RecordBatch | pa.Table, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and weights, as vectors of length 1, of rows of `placed`."""
    out = []
    for n, at, counts in zip(*(rows.column(c).to_pylist() for c in ("n", "at", "counts")), strict=True):
        at = np.cumsum(unpacked(at, n), dtype=np.int32)
        w = unpacked(counts, n) * idf[at]
        out.append((at, w / np.sqrt(w @ w)))
    return out


def blocks_of(rows: DataFrame, key: str, words, postings: int) -> Iterator:
    """Broadcasts of blocks of queries; rows as `placed` makes them."""
    asked = rows.filter("asked").drop("asked")
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    several = max(-(-size // postings), -(-n // QUERIES))
    for i in range(several):
        found = asked.filter(F.pmod(F.xxhash64(key), F.lit(several)) == i).toArrow()
        if found.num_rows:
            vectors = unit(found, words.value[1])
            at, w = (np.concatenate([v[k] for v in vectors]) for k in (0, 1))
            query = np.repeat(np.arange(found.num_rows, dtype=np.int32), [len(v[0]) for v in vectors])
            yield rows.sparkSession.sparkContext.broadcast(Block(len(words.value[0]), at, query, w, found.column(key).to_pylist()))


def scanner(words, block, kind: type, emit: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """emit(block, keys, grams, products) as batches, for TEXTS texts of `placed` at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, own = words.value[1], block.value
        own.prepare(kind)
        out = emit(own)
        for b in batches:
            for first in range(0, b.num_rows, TEXTS):
                part = b.slice(first, TEXTS)
                grams = unit(part, idf)
                yield from out(part.column(0), grams, own.products(part.column(0).to_pylist(), grams)[0])

    return work


def cosines(articles: DataFrame, key: str, text: str, is_query: Column, least: float = 0.0, top: int | None = None, most: int = VOCABULARY, postings: int = POSTINGS) -> DataFrame | None:
    """query, key, text_score of pairs of a query and another article that share a gram; None beyond the vocabulary.

    least and top leave out, before anything is shuffled, scores below least and those that a task has top better ones
    than; SLACK of both stays, so that rounded scores rank as if all were there. With top, pairs are looked for in single
    precision, with what that may be off by, and those found are scored in double precision. Queries go in blocks against all.
    """
    words = vocabulary(articles, text, most)
    if words is None:
        return None
    kind, out = articles.schema[key].dataType.simpleString(), None
    schema = f"query {kind}, `{key}` {kind}, text_score double"
    rows = placed(articles, key, text, is_query, words)

    def emit(block: Block):
        best = Best(len(block.names), least, top, block.unsure()) if top else None
        names = pa.array(block.names)

        def found(keys: pa.Array, grams: list, score: np.ndarray) -> Iterator[pa.RecordBatch]:
            i, j = best.pairs(score) if top else np.nonzero((score > 0) & (score >= least - SLACK))
            exact = block.exact(grams, i, j)[0] if top else score[i, j]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(j)), keys.take(pa.array(i)), pa.array(exact)], names=["query", key, "text_score"])

        return found

    for block in blocks_of(rows, key, words, postings):
        found = rows.drop("asked").mapInArrow(scanner(words, block, np.float32 if top else np.float64, emit), schema)
        out = found if out is None else out.unionByName(found)
    return articles.sparkSession.createDataFrame([], schema) if out is None else out


def counted(block: Block, least: float) -> Callable:
    """Numbers of positive scores and of those of at least least, to six places, from scores in single precision by query;
    exact(i, j) scores the pairs for which these are not sure."""

    def numbers(score: np.ndarray, exact: Callable) -> list[np.ndarray]:
        line, unsure = least - 5e-7, block.unsure() + 2.0**-20
        near = (score > 0) & (score >= line * (1 - unsure)) & (score * (1 - unsure) <= line)
        i, j = np.nonzero(near)
        over = ((score >= line) & ~near).sum(axis=0)
        np.add.at(over, j, np.round(exact(i, j), 6) >= least)
        return [(score > 0).sum(axis=0), over]

    return numbers


def tallies(articles: DataFrame, key: str, text: str, is_query: Column, least: float, most: int = VOCABULARY, postings: int = POSTINGS) -> DataFrame | None:
    """query, scored (other articles that share a gram) and over (scores of at least least, to six places), counted in
    tasks; queries of one key together. None beyond the vocabulary."""
    words = vocabulary(articles, text, most)
    if words is None:
        return None
    kind, out = articles.schema[key].dataType.simpleString(), None
    schema = f"query {kind}, scored long, over long"
    rows = placed(articles, key, text, is_query, words)

    def emit(block: Block):
        numbers, names = counted(block, least), pa.array(block.names)

        def found(keys: pa.Array, grams: list, score: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = numbers(score, lambda i, j: block.exact(grams, i, j)[0])
            yield pa.RecordBatch.from_arrays([names, *[pa.array(x, pa.int64()) for x in found]], names=["query", "scored", "over"])

        return found

    for block in blocks_of(rows, key, words, postings):
        found = rows.drop("asked").mapInArrow(scanner(words, block, np.float32, emit), schema)
        out = found if out is None else out.unionByName(found)
    out = articles.sparkSession.createDataFrame([], schema) if out is None else out
    return out.groupBy("query").agg(F.sum("scored").alias("scored"), F.sum("over").alias("over")).filter("scored > 0")
