"""Language identification: multinomial naive Bayes over hashed character n-grams.

Two passes over the texts, neither with a shuffle of them. The first sums, a language and a bucket, the n-grams of one to
three letters; the second scores batches against the broadcast matrix of log-probabilities. More than GROUP languages are
scored in passes of so many, each with a matrix of its own, and the best of the passes so far goes along with a text: the
numbers are the same as with one matrix of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound_batches, checkpoint, discard, lean, read

BITS = 15
BUCKETS = 1 << BITS
#: Languages whose matrix is broadcast at a time, 128 KB each.
GROUP = 256
SMOOTHING = 0.5
#: Characters that are worked on at a time; a longer text goes on two characters before the end of the last piece.
PIECE = 1 << 18
#: Languages that a task counts at a time.
LANGUAGES = 64
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """By code point, its lower-case letter, or a space for what is no letter."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Places of texts and the texts or parts of them with what comes before and after, about PIECE characters together.

    An n-gram starts at each character of a part but the last two, which the next part begins with.
    """
    at, some, n = [], [], 0
    for i, text in enumerate(texts):
        for start in range(0, len(text) + 1 if text else 0, PIECE):
            end = start + PIECE + 1
            part = (" " if start == 0 else "") + text[max(0, start - 1) : end] + " " * max(0, min(2, end - len(text)))
            at.append(i)
            some.append(part)
            n += len(part)
            if n >= PIECE:
                yield at, some
                at, some, n = [], [], 0
    if some:
        yield at, some


def grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (three by n characters; BUCKETS: none), where each part starts, and whether it has a letter."""
    x = letters()[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    ends = np.cumsum([len(p) for p in parts])
    start = np.r_[0, ends[:-1]]
    y, z = np.r_[x[1:], 32].astype(np.uint32), np.r_[x[2:], 32, 32].astype(np.uint32)
    blank = x == 32
    g2 = x * np.uint32(0x9E3779B1) + y * np.uint32(0x85EBCA77)
    g3 = (g2 ^ (g2 >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + z * np.uint32(0xC2B2AE3D)
    out = np.empty((3, len(x)), dtype=np.int32)
    for row, g in zip(out, (x * np.uint32(0xB5297A4D), g2, g3), strict=True):
        g = (g ^ (g >> np.uint32(16))) * np.uint32(0x7FEB352D)
        row[:] = (g ^ (g >> np.uint32(15))) * np.uint32(0x846CA68B) >> np.uint32(32 - BITS)
    out[0][blank] = BUCKETS
    out[1:, blank & (y == 32)] = BUCKETS
    out[:, ends - 1] = out[:, ends - 2] = BUCKETS
    return out, start, np.logical_or.reduceat(~blank, start)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows lang, bucket, n of a task's texts; bucket -1 counts the texts. A language may come more than once."""
    total: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(np.where(some == BUCKETS, -1, some)), pa.array(n[some])], names=["lang", "bucket", "n"])
        total.clear()

    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for at, parts in pieces(texts):
            b, start, _ = grams(parts)
            size = np.diff(np.r_[start, b.shape[1]])
            names = [langs[i] for i in at]
            for lang in dict.fromkeys(names):
                mine = np.repeat(np.array([x == lang for x in names]), size)
                own = total.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
                for row in b:
                    own[:BUCKETS] += np.bincount(row[mine], minlength=BUCKETS + 1)[:BUCKETS]
                if len(total) > LANGUAGES:
                    yield from rows()
        for lang in langs:
            total.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))[BUCKETS] += 1
            if len(total) > LANGUAGES:
                yield from rows()
    yield from rows()


class Model:
    """Languages and, a bucket, their log-probabilities; the last row, of zeros, is for no n-gram."""

    def __init__(self, counts: dict[str, np.ndarray], docs: dict[str, int], total: int | None = None):
        self.langs = sorted(counts)
        self.prior = np.log(np.array([docs[x] for x in self.langs], dtype=np.float64) / max(1, sum(docs.values()) if total is None else total))
        n = np.array([counts[x] for x in self.langs], dtype=np.float64).reshape(len(self.langs), BUCKETS) + SMOOTHING
        logs = np.log(n / n.sum(axis=1, keepdims=True))
        self.logs = np.hstack([logs, np.zeros((len(self.langs), 1))]).astype(np.float32)

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities by text and language, and which texts have a letter."""
        total = np.tile(self.prior, (len(texts), 1))
        some = np.zeros(len(texts), dtype=bool)
        for at, parts in pieces(texts):
            b, start, has = grams(parts)
            for j, own in enumerate(self.logs):
                each = own[b[0]] + own[b[1]] + own[b[2]]
                np.add.at(total[:, j], at, np.add.reduceat(each, start, dtype=np.float64))
            np.logical_or.at(some, at, has)
        return total, some

    def better(self, texts: list[str | None], best: np.ndarray, langs: list[str | None], rest: np.ndarray) -> tuple[np.ndarray, list[str | None], np.ndarray, np.ndarray]:
        """Best log-probability, its language, the sum of all probabilities by the best, and which texts have a letter,
        after these languages and those before them; on a tie the earlier language stays."""
        total, some = self.totals(texts)
        if not self.langs:
            return best, langs, rest, some
        at = total.argmax(axis=1)
        new = np.maximum(best, total[np.arange(len(texts)), at])
        with np.errstate(invalid="ignore"):
            rest = np.where(np.isfinite(best), rest * np.exp(best - new), 0.0) + np.exp(total - new[:, None]).sum(axis=1)
        return new, [self.langs[i] if n > b else x for i, n, b, x in zip(at, new, best, langs, strict=True)], rest, some


def found(langs: list[str | None], rest: np.ndarray, some: np.ndarray) -> tuple[list[str], list[float]]:
    ok = [bool(s) and x is not None for s, x in zip(some, langs, strict=True)]
    return [x if o else UNKNOWN for o, x in zip(ok, langs, strict=True)], [1 / r if o else 0.0 for o, r in zip(ok, rest, strict=True)]


class Fitted(NamedTuple):
    """How many texts each language has, and counts of it by bucket: lang, bucket, n."""

    docs: dict[str, int]
    counts: DataFrame

    def models(self) -> Iterator[Model]:
        """A model of each GROUP languages, by name; one without languages where there are none."""
        names = sorted(self.docs)
        for i in range(0, max(1, len(names)), GROUP):
            some = names[i : i + GROUP]
            by = np.zeros((len(some), BUCKETS), dtype=np.int64)
            table = self.counts.filter((F.col("bucket") >= 0) & (F.col("lang") >= some[0]) & (F.col("lang") <= some[-1])).toArrow() if some else None
            if table is not None and table.num_rows:
                by[pc.index_in(table["lang"], pa.array(some, pa.string())).to_numpy(), table["bucket"].to_numpy()] = table["n"].to_numpy()
            yield Model(dict(zip(some, by, strict=True)), self.docs, sum(self.docs.values()))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Fitted:
    """Counts over all rows of docs that have a language. What reaches the driver are the numbers of texts by language and,
    at prediction, the counts of GROUP languages at a time."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null")
    counts = checkpoint(rows.mapInArrow(lean(count_grams), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    return Fitted({r["lang"]: r["n"] for r in counts.filter("bucket < 0").collect()}, counts)


def held_out(key: str) -> Column:
    """Whether crc32 of the key as text, modulo 3, is 1; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def predict(docs: DataFrame, fitted: Fitted, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred, `und` for a text that is null or has no letter, and score, the posterior (und: 0).

    Texts may be empty or very long and are read whole; rows may repeat. docs must not have columns of these two names,
    or _best, _lang and _rest; others can be given for the two. Of languages that are equally likely the first by name
    counts. Without any language all texts are `und`. No rows in, no rows out.
    """
    if clash := {*names, "_best", "_lang", "_rest"} & set(docs.columns):
        raise ValueError(f"docs has columns {sorted(clash)}; give other names")
    bound_batches(docs.sparkSession)
    own, place = docs.columns, docs.columns.index(text)
    passes = -(-max(1, len(fitted.docs)) // GROUP)

    def add(shared, first: bool, last: bool):
        columns = [*own, *(names if last else ("_best", "_lang", "_rest"))]

        def run(batches):
            for batch in batches:
                n = len(batch)
                best, langs, rest = (np.full(n, -np.inf), [None] * n, np.zeros(n)) if first else (batch.column("_best").to_numpy(), batch.column("_lang").to_pylist(), batch.column("_rest").to_numpy())
                best, langs, rest, some = shared.value.better(batch.column(place).to_pylist(), best, langs, rest)
                new = [pa.array(best), pa.array(langs, pa.string()), pa.array(rest)]
                if last:
                    langs, scores = found(langs, rest, some)
                    new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *new], names=columns)

        return run

    on_the_way = docs.withColumns({"_best": F.lit(0.0), "_lang": F.lit("").cast("string"), "_rest": F.lit(0.0)}).schema
    in_the_end = docs.withColumns({names[0]: F.lit("").cast("string"), names[1]: F.lit(0.0)}).schema
    out = docs
    for i, model in enumerate(fitted.models(), 1):
        shared = docs.sparkSession.sparkContext.broadcast(model)
        before, out = out, out.mapInArrow(lean(add(shared, i == 1, i == passes)), in_the_end if i == passes else on_the_way)
        if i < passes:
            out = checkpoint(out)
            shared.unpersist()
            if i > 1:
                discard(before)
    return out


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """One row a document: key, held_out, lang_pred and score, learnt from those that are not held out.

    Texts and languages may be null; other columns of docs, whatever their names, are neither read nor returned.
    """
    rows = docs.select(F.col(key), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = fit(rows.filter(~held_out(key)))
    return predict(rows.select(key, held_out(key).alias("held_out"), "text"), model).drop("text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
