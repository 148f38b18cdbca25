"""Near duplicates by BagMinHash.

A text is the multiset of its shingles of five words. Each shingle has a Poisson process over time and weight; the
weights are discretised at the powers of two, and a process is made of one a dyadic interval, as many as its count
needs, so that the process of a smaller count is part of that of a larger one. Each point falls on one of REGISTERS
registers, which keep their earliest point. Two texts agree in a register with the probability of their weighted
Jaccard similarity. Points are only made up to the time at which all registers of the text are filled.

Registers are joined to bands, equal bands put texts in a bucket, and the members of buckets are verified by the exact
overlap of their multisets. Not all pairs are made. First the members of a bucket are compared with its centre, and those
that are connected then need no comparison with each other. Buckets of more than SMALL texts which are not all connected
hold texts that share a passage but are not alike, or copies with many changes. Their members meet by prefixes: two texts
of the similarity, the shingles of each sorted by how few texts have them, have one of their first and rarest shingles in
common, which a passage of many texts is not. Many copies of one text have the same shingles there, linked or not, so they
meet by what they differ in from one of them instead, its rarest first. This is exact, so no bucket and no group is capped
and no link between texts of a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import attach_groups, checkpoint, discard, lean, read

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Members of a bucket whose pairs are all compared, where they are not connected.
SMALL = 16
#: Bands by which texts are first compared with the centres of their buckets.
STARS = 8
#: Similarity from which a text may be described by its differences from the centre of a bucket.
LOOSE = 0.5
#: Counters of the shingles of texts that meet by prefixes, a byte each where they are broadcast, and those of a block.
#: More than CROWDED shingles a counter are counted by a join instead.
COUNTERS, BLOCK, CROWDED = 1 << 22, 1 << 14, 8
#: Rows of one shingle that meet others in one task, on average.
MEET = 4096
#: Pairs of one text that a task compares at most.
SPLIT = 512
#: Bytes of text that a task works on at a time.
CHUNK = 1 << 20
#: Rows and bytes of an Arrow batch of texts.
BATCH, BATCH_BYTES = 1500, 4 << 20
#: Ids up to which a set is broadcast to pick rows of documents; larger sets meet them in a shuffle.
FEW_IDS = 1_000_000

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95
BACK = pow(BASE, -1, 1 << 64)
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits are as good as random."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * GOLDEN)
PLACE = mix(np.arange(301, 301 + WORDS, dtype=U) * GOLDEN) | U(1)


def powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """base to 0, 1, ... n - 1, modulo 2 ** 64."""
    if len(known.get(base, ())) < n:
        out = np.full(n, base, dtype=U)
        out[0] = 1
        known[base] = np.multiply.accumulate(out)
    return known[base][:n]


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of adjacent texts, which start at `at[:-1]`, and the place of each word's text."""
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64)
    word = ~BLANK[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = at[:-1][at[:-1] < len(data)]
    first[edge] = word[edge]
    edge = at[1:][at[1:] > 0] - 1
    last[edge] = word[edge]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    run = np.cumsum(BYTE[data] * powers(BASE, len(data)))
    total = run[b] - np.where(a > 0, run[a - 1], U(0))
    return mix(total * powers(BACK, len(data))[a]), np.searchsorted(at, a, side="right") - 1


def shingles(w: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of five words in a row and their text's place; a text of fewer words is one shingle."""
    n = np.bincount(of) if len(of) else np.zeros(0, int)
    total, same = np.zeros(len(w), dtype=U), np.ones(len(w), dtype=bool)
    for i in range(WORDS):
        near, its = np.r_[w[i:], np.zeros(min(i, len(w)), U)], np.r_[of[i:], np.full(min(i, len(of)), -1)]
        ok = its == of
        total += np.where(ok, near * PLACE[i], U(0))
        same &= ok
    start = np.r_[True, of[1:] != of[:-1]] if len(of) else np.zeros(0, bool)
    keep = same | start & (n[of] < WORDS if len(of) else False)
    size = np.minimum(n[of], WORDS).astype(U) if len(of) else np.zeros(0, U)
    return mix(total + size)[keep], of[keep]


def chunks(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last text and the words of them, about CHUNK bytes at a time; a longer text is cut between words."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1)
        j = min(j, n)
        if at[j] - at[i] <= 2 * CHUNK:
            yield i, j, *word_hashes(data[at[i] : at[j]], at[i : j + 1] - at[i])
        else:
            parts, a, end = [], at[i], at[i + 1]
            while a < end:
                b = min(a + CHUNK, end)
                while b < end and not BLANK[data[b]]:
                    b += 1
                parts.append(word_hashes(data[a:b], np.array([0, b - a]))[0])
                a = b
            w = np.concatenate(parts)
            yield i, i + 1, w, np.zeros(len(w), np.int64)
            j = i + 1
        i = j


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of text and where each starts; a null has none."""
    texts = texts.fill_null("") if texts.null_count else texts
    at = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def counted(s: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, their text and their count."""
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (of[1:] != of[:-1])] if len(s) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    return s[start], of[start], np.diff(np.r_[start, len(s)])


def signatures(s: np.ndarray, of: np.ndarray, n: np.ndarray, texts: int) -> np.ndarray:
    """For each text and register the hash of the earliest point; texts must each have a shingle."""
    sig = np.zeros((texts, REGISTERS), dtype=U)
    size = np.bincount(of, weights=n, minlength=texts)
    todo, reach = np.arange(texts), 4.0
    level = np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
    while len(todo):
        mine = np.isin(of, todo) if len(todo) < texts else np.ones(len(of), bool)
        until = REGISTERS / size * (np.log(REGISTERS) + reach)
        some, text, count, top = s[mine], of[mine], n[mine], level[mine]
        each = top + 1
        own = np.repeat(np.arange(len(some)), each)
        k = np.arange(len(own)) - np.repeat(np.cumsum(each) - each, each)
        low = np.where(k > 0, 2.0 ** np.maximum(k - 1, 0), 0.0)
        rate = np.maximum(low, 1.0)
        state, t = mix(some[own] + k.astype(U) * GOLDEN), np.zeros(len(own))
        text, count, end = text[own], count[own], until[text[own]]
        best = np.full(texts * REGISTERS, np.inf)
        value = np.zeros(texts * REGISTERS, dtype=U)
        while len(state):
            state = state + GOLDEN
            r = mix(state)
            t = t - np.log1p(-((r >> U(11)).astype(np.float64) * 2.0**-53)) / rate
            on = t <= end
            if not on.all():
                state, t, r, text, count, end, low, rate = (x[on] for x in (state, t, r, text, count, end, low, rate))
            q = mix(r ^ U(0x5851F42D4C957F2D))
            to = text * REGISTERS + ((q >> U(32)) * U(REGISTERS) >> U(32)).astype(np.int64)
            ok = (low == 0) | (low + rate * ((q & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) < count)
            at, when = to[ok], t[ok]
            np.minimum.at(best, at, when)
            won = best[at] == when
            value[at[won]] = r[ok][won]
        best, value = best.reshape(texts, -1), value.reshape(texts, -1)
        full = np.isfinite(best[todo]).all(axis=1)
        sig[todo[full]] = value[todo[full]]
        todo, reach = todo[~full], reach * 2 + 4
    return sig


def bands_of(sig: np.ndarray) -> np.ndarray:
    """A hash for each band of each text, which tells bands apart."""
    out = np.arange(BANDS, dtype=U)[None, :] * GOLDEN
    parts = sig.reshape(len(sig), BANDS, ROWS)
    for i in range(ROWS):
        out = mix(out ^ parts[:, :, i]) + GOLDEN
    return out.view(np.int64)


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows id, text become id, fingerprint of the words in their order (null: no word), bands and number of shingles."""
    for batch in batches:
        data, at = text_bytes(batch.column(1))
        for i, j, w, of in chunks(data, at):
            s, so, n = counted(*shingles(w, of))
            there = np.unique(so)
            place = np.searchsorted(there, so)
            bands = np.zeros((j - i, BANDS), dtype=np.int64)
            mark = np.zeros((j - i, 2), dtype=U)
            size = np.bincount(so, n, j - i).astype(np.int64)
            if len(there):
                bands[there] = bands_of(signatures(s, place, n, len(there)))
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                rank = (np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))).astype(U)
                for k, salt in enumerate((U(1), U(0x632BE59BD9B4E019))):
                    mark[there, k] = np.add.reduceat(mix(w + mix((rank + U(1)) * GOLDEN * salt)), first)
            has = np.isin(np.arange(j - i), there)
            prints = [m.tobytes() if ok else None for m, ok in zip(mark, has, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(prints, pa.binary()), lists, pa.array(size)], names=["id", "fp", "bands", "n"])


def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows id, text become id and the shingles of the text; the second of equal ones differs from the first, and so on."""
    for batch in batches:
        data, at = text_bytes(batch.column(1))
        for i, j, w, of in chunks(data, at):
            s, so, n = counted(*shingles(w, of))
            again = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            s, so = np.repeat(s, n), np.repeat(so, n)
            s = np.where(again > 0, mix(s + again.astype(U) * GOLDEN), s)
            end = np.cumsum(np.bincount(so, minlength=j - i))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, end], pa.int32()), pa.array(s.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], lists], names=["id", "x"])


def tally(counters: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows x (arrays) become counters of the values of x, in blocks: at, and the places and counts that are not 0."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, dtype=np.int32)
        for batch in batches:
            np.add.at(total, batch.column(0).flatten().to_numpy().view(U) % U(counters), 1)
        for at, part in enumerate(total.reshape(-1, block)):
            some = np.flatnonzero(part)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([some.astype(np.int32).tobytes()], pa.binary()), pa.array([part[some].tobytes()], pa.binary())], names=["at", "places", "counts"])

    return blocks


def added(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of tally of the same place become one, in levels: 0 no text, 1 one text, and so on, ever wider."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total.setdefault(at, np.zeros(block, dtype=np.int64))[np.frombuffer(places, dtype=np.int32)] += np.frombuffer(counts, dtype=np.int32)
        for at, n in total.items():
            level = np.minimum(np.where(n < 2, n, np.log2(np.maximum(n, 1)) * 8 - 6), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([level.tobytes()], pa.binary())], names=["at", "levels"])

    return blocks


def prefix(levels: np.ndarray, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows id, x become id, n (how many x), and of the first x by level, as many as the prefix of the similarity has,
    those that more than one text may have, with their places."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size, x = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            of = np.repeat(np.arange(len(size)), size)
            level = levels[x.view(U) % U(len(levels))]
            order = np.lexsort((x, level, of))
            x, level = x[order], level[order]
            pos = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
            on = (pos < (size - np.ceil(least * size - 1e-9).astype(np.int64) + 1)[of]) & (level > 1)
            end = pa.array(np.r_[0, np.cumsum(np.bincount(of[on], minlength=len(size)))], pa.int32())
            out = [pa.ListArray.from_arrays(end, pa.array(v[on], pa.int64())) for v in (x, pos)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), *out], names=["id", "n", "x", "pos"])

    return first


def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, b, a_text, b_text become a, b and the weighted Jaccard similarity of their shingles."""
    for batch in batches:
        (da, aa), (db, ab) = text_bytes(batch.column(2)), text_bytes(batch.column(3))
        out, i = np.zeros(len(batch)), 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(aa + ab, aa[i] + ab[i] + CHUNK, side="right")) - 1)
            j = min(j, len(batch))
            keys, texts, sides = [], [], []
            for side, (d, at) in enumerate(((da, aa), (db, ab))):
                for x, _, w, of in chunks(d[at[i] : at[j]], at[i : j + 1] - at[i]):
                    s, so = shingles(w, of)
                    keys.append(s)
                    texts.append(so + x)
                    sides.append(np.full(len(s), side))
            s, of, side = np.concatenate(keys), np.concatenate(texts), np.concatenate(sides)
            order = np.lexsort((s, of))
            s, of, side = s[order], of[order], side[order]
            start = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (of[1:] != of[:-1])]) if len(s) else np.zeros(0, int)
            if len(start):
                b = np.add.reduceat(side, start)
                a = np.diff(np.r_[start, len(s)]) - b
                low = np.bincount(of[start], np.minimum(a, b), j - i)
                high = np.bincount(of[start], np.maximum(a, b), j - i)
                out[i:j] = low / np.maximum(high, 1)
            i = j
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "similarity"])


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH rows and BATCH_BYTES at most, for jobs that run inside."""
    before = {f"spark.sql.execution.arrow.{name}": None for name in ("maxRecordsPerBatch", "maxBytesPerBatch")}
    for (name, _), most in zip(list(before.items()), (BATCH, BATCH_BYTES), strict=True):
        before[name] = spark.conf.get(name)
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def pick(rows: DataFrame, ids: DataFrame, keep: bool = True, key: str = "id") -> DataFrame:
    """Rows whose key is (or is not) among the column id of ids, by broadcast where these are few."""
    few = ids.limit(FEW_IDS + 1).count() <= FEW_IDS
    ids = ids.withColumnRenamed("id", key)
    return rows.join(F.broadcast(ids) if few else ids, key, "left_semi" if keep else "left_anti").select(rows.columns)


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs a, b of ids with the similarity of their texts in docs (id, text).

    A text in more than SPLIT pairs as a is copied for each SPLIT of these, so that no task has all pairs of one text.
    """
    ids = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = pick(docs, ids)
    of_a = pairs.groupBy("a").agg(F.count("*").alias("n"))
    parts = of_a.select("a", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SPLIT).cast("int"))).alias("part"))
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text")).join(parts, "a")
    many = attach_groups(pairs, checkpoint(of_a.filter(F.col("n") > SPLIT)), "a", "n")
    split = many.select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.floor((F.col("n") - 1) / SPLIT) + 1), F.lit(0)).cast("int").alias("part"))
    with small_batches(pairs.sparkSession):
        both = split.join(texts.select(F.col("id").alias("b"), F.col("text").alias("b_text")), "b").join(a, ["a", "part"])
        return checkpoint(both.select("a", "b", "a_text", "b_text").mapInArrow(lean(overlap), "a long, b long, similarity double"))


def shingle_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id and x, the shingles of its text, of the texts of ids."""
    with small_batches(docs.sparkSession):
        return checkpoint(pick(docs, ids).repartition("id").mapInArrow(lean(elements), "id long, x array<long>"))


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """id, n (its shingles), x (a shingle), pos and core, for the rarest shingles of sets (id, x).

    Shingles are ordered by the level of their counter, which others may share, and by their value: one order for all
    texts. A shingle's place in the order of its text is pos. Those whose counter has one text come first, count, and
    are not returned. Of two texts of at least the similarity, the first shingle in common is among these rows for
    both, and core for the smaller of them. Full counters make more rows, never fewer links.
    """
    with small_batches(sets.sparkSession):
        if (sets.agg(F.sum(F.size("x").cast("long"))).first()[0] or 0) > CROWDED * COUNTERS:
            return cores(joined_prefixes(sets, least), least)
        blocks = sets.select("x").mapInArrow(lean(tally(COUNTERS, BLOCK)), "at long, places binary, counts binary").repartition("at").mapInArrow(lean(added(BLOCK)), "at long, levels binary")
        levels = np.zeros(COUNTERS, dtype=np.uint8)
        for r in blocks.collect():
            levels[r["at"] * BLOCK : (r["at"] + 1) * BLOCK] = np.frombuffer(r["levels"], dtype=np.uint8)
        rows = checkpoint(sets.mapInArrow(lean(prefix(levels, least)), "id long, n long, x array<long>, pos array<long>").filter(F.size("x") > 0))
    return cores(rows.select("id", "n", F.explode(F.arrays_zip("x", "pos")).alias("e")).select("id", "n", "e.x", "e.pos"), least)


def cores(rows: DataFrame, least: float) -> DataFrame:
    core = F.col("n") - F.ceil(F.lit(2 * least / (1 + least)) * F.col("n") - 1e-9) + 1
    return rows.select("id", "n", "x", "pos", (F.col("pos") < core).alias("core"))


def joined_prefixes(sets: DataFrame, least: float) -> DataFrame:
    """id, n, x and pos as prefix() has them, in the order of how many texts have a shingle and its value, each counted by
    itself: for any number of shingles. Only a text's own shingles meet in one place."""
    each = sets.select("id", F.explode("x").alias("x"))
    counts = checkpoint(each.groupBy("x").agg(F.count("*").alias("c")))
    order = checkpoint(attach_groups(each, counts, "x", "c", "inner").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "x"))).alias("own")))
    n = F.size("own").cast("long")
    first = F.slice("own", F.lit(1), (n - F.ceil(F.lit(least) * n - 1e-9) + 1).cast("int"))
    rows = order.select("id", n.alias("n"), F.posexplode(first).alias("pos", "e")).filter(F.col("e.c") > 1)
    return checkpoint(rows.select("id", "n", "e.x", F.col("pos").cast("long").alias("pos")))


def crowd_pairs(crowd: DataFrame, docs: DataFrame, least: float, sets: DataFrame | None = None) -> DataFrame:
    """Pairs a < b of crowd (id, label, maybe family) of different labels and families that may have the similarity.

    Of the rows of a shingle, those of its most frequent family (label, if there are none) are not compared with each
    other: where most texts are connected, the work is the others times all. The rows of a frequent shingle are dealt to
    parts, each of which meets these others. sets: shingle_sets of crowd, if they are there.
    """
    sets = shingle_sets(crowd.select("id"), docs) if sets is None else sets
    crowd = crowd.select("id", "label", crowd["family" if "family" in crowd.columns else "label"].alias("family"))
    rows = checkpoint(prefixes(sets, least).join(crowd, "id"))
    by_family = rows.groupBy("x", "family").agg(F.count("*").alias("c"))
    most = checkpoint(by_family.groupBy("x").agg(F.max_by("family", F.struct("c", "family")).alias("top"), F.sum("c").alias("c"), F.count("*").alias("families")).filter("families > 1").drop("families"))
    meet = attach_groups(rows, most, "x", "c", "inner").withColumn("minor", F.col("family") != F.col("top")).withColumn("parts", F.ceil(F.col("c") / MEET))
    meet = checkpoint(meet.withColumn("part", F.pmod(F.xxhash64("id"), "parts")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    left = meet.filter("minor").withColumn("part", every).select(*[F.col(c).alias(f"l_{c}") for c in ("x", "part", "id", "n", "pos", "core", "label", "family")])
    short = F.when(F.col("n") < F.col("l_n"), F.col("core")).otherwise(F.col("l_core"))
    need = F.ceil(F.lit(least / (1 + least)) * (F.col("n") + F.col("l_n")) - 1e-9)
    on = (F.col("x") == F.col("l_x")) & (F.col("part") == F.col("l_part")) & (F.col("label") != F.col("l_label")) & (F.col("family") != F.col("l_family")) & (~F.col("minor") | (F.col("l_id") < F.col("id"))) & short & alike(F.col("n"), F.col("l_n"), least) & (F.least(F.col("n") - F.col("pos"), F.col("l_n") - F.col("l_pos")) >= need)
    return left.join(meet, on).select(F.least("id", "l_id").alias("a"), F.greatest("id", "l_id").alias("b")).distinct()


def hubs_of(crowd: DataFrame, done: DataFrame) -> DataFrame:
    """crowd (id, label) with hub and root: hub is, of a text and those that it is known to be loosely like, the one that
    most are like, and root the hub of the hub. done: verified pairs."""
    like = done.filter(F.col("similarity") >= LOOSE)
    both = checkpoint(like.select(F.col("a").alias("id"), F.col("b").alias("hub")).unionByName(like.select(F.col("b").alias("id"), F.col("a").alias("hub"))))
    near = checkpoint(both.groupBy("hub").agg(F.count("*").alias("m")))
    every = attach_groups(both, near, "hub", "m", "inner").unionByName(near.select(F.col("hub").alias("id"), "hub", "m"), allowMissingColumns=True)
    best = checkpoint(every.groupBy("id").agg(F.max(F.struct("m", "hub")).alias("top")).select("id", F.col("top.hub").alias("hub")))
    roots = checkpoint(best.groupBy("hub").agg(F.count("*").alias("m")).join(best.select(F.col("id").alias("hub"), F.col("hub").alias("root")), "hub"))
    found = attach_groups(best, roots, "hub", "m", "inner").select("id", "hub", "root")
    return checkpoint(crowd.join(found, "id", "left").select("id", "label", F.coalesce("hub", "id").alias("hub"), F.coalesce("root", "id").alias("root")))


def differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """id, label, family, n, m (shingles of the text and of its family's) and d, the shingles that one of both has.

    members: hubs_of. The family is the root, where the text is loosely like it, else the hub. A text that many others
    name is copied for each SPLIT of these.
    """
    each = checkpoint(members.select("id", "label", "root", F.explode(F.array_distinct(F.array("root", "hub"))).alias("family")))
    named = checkpoint(each.groupBy("family").agg(F.count("*").alias("c")))
    parts = named.select("family", F.explode(F.sequence(F.lit(0), F.floor((F.col("c") - 1) / SPLIT).cast("int"))).alias("part"))
    of = sets.select(F.col("id").alias("family"), F.col("x").alias("y")).join(parts, "family")
    split = attach_groups(each, named, "family", "c", "inner").withColumn("part", F.pmod(F.xxhash64("id"), F.floor((F.col("c") - 1) / SPLIT) + 1).cast("int"))
    both = split.join(sets, "id").join(of, ["family", "part"])
    d = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
    rows = both.select("id", "label", "family", F.size("x").cast("long").alias("n"), F.size("y").cast("long").alias("m"), d.alias("d"), (F.col("family") == F.col("root")).alias("first"))
    rows = rows.withColumn("order", F.when(F.col("first") & (likeness(F.col("n"), F.col("m"), F.size("d")) >= LOOSE), 2).when(~F.col("first"), 1).otherwise(0))
    return checkpoint(rows.groupBy("id").agg(F.max_by(F.struct("label", "family", "n", "m", "d"), "order").alias("r")).select("id", "r.*"))


def likeness(n: Column, m: Column, d: Column) -> Column:
    """The similarity of texts of n and m shingles of which d are in one only; 1 for two texts without any."""
    return F.coalesce((n + m - d) / (n + m + d), F.lit(1.0))


def family_pairs(kin: DataFrame, least: float) -> DataFrame:
    """Pairs a < b of kin (as differences has it) of one family that may have the similarity and are not known to be
    connected, neither by label nor as both are linked to the text of the family.

    What one of two texts has is what their differences from a third do not share. Of n and m shingles, at most
    (n + m) (1 - least) / (1 + least) may be in one only. Two texts that may be linked whatever their differences share are both
    linked to the third. Others share some, the more the larger these are. In one order of a family, rarest first, the
    first that both have has enough behind it in both; of the text whose differences are fewer for its length, it is
    among the first ones (core). Copies that each differ in their own way share none of these.
    """
    each = kin.select("id", F.explode("d").alias("x"), "family").select("id", F.xxhash64("family", "x").alias("x"))
    counts = checkpoint(each.groupBy("x").agg(F.count("*").alias("c")))
    own = checkpoint(attach_groups(each, counts, "x", "c", "inner").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "x"))).alias("own")))
    spare, size = F.lit((1 - least) / (1 + least)) * F.col("n"), F.size("own")
    rows = kin.select("id", "label", "n", (likeness(F.col("n"), F.col("m"), F.size("d")) >= least).alias("near")).join(own, "id")
    rows = rows.select("id", "label", "n", "near", (size - spare).alias("far"), (size + spare).alias("reach"), F.posexplode("own").alias("pos", "e")).filter("e.c > 1")
    rows = rows.select("id", "label", "n", "near", "far", (F.col("reach") - 2 * F.col("pos")).alias("reach"), "e.x", F.ceil(F.col("e.c") / MEET).alias("parts"))
    rows = checkpoint(rows.withColumn("part", F.pmod(F.xxhash64("id"), "parts")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    core = rows.filter(F.col("reach") >= F.col("far") - 1e-6).withColumn("part", every).select(*[F.col(c).alias(f"l_{c}") for c in ("x", "part", "id", "label", "n", "near", "far", "reach")])
    fewer = (F.col("l_far") < F.col("far")) | (F.col("l_far") == F.col("far")) & (F.col("l_id") < F.col("id"))
    enough = (F.col("l_reach") >= F.col("far") - 1e-6) & (F.col("reach") >= F.col("l_far") - 1e-6)
    on = (F.col("x") == F.col("l_x")) & (F.col("part") == F.col("l_part")) & (F.col("label") != F.col("l_label")) & ~(F.col("near") & F.col("l_near")) & fewer & enough & alike(F.col("n"), F.col("l_n"), least)
    return core.join(rows, on).select(F.least("id", "l_id").alias("a"), F.greatest("id", "l_id").alias("b")).distinct()


def alike(n: Column, m: Column, least: float) -> Column:
    """Whether texts of n and m shingles can have the similarity."""
    return F.least(n, m) >= F.lit(least) * F.greatest(n, m) - 1e-9


def stars(rows: DataFrame, least: float) -> DataFrame:
    """Pairs a < b of each text with the centre of each of its buckets of the first STARS bands.

    The centre is the member whose buckets are largest: among copies with changes, the one with the fewest.
    """
    first = rows.select("id", "n", F.explode(F.slice("bands", 1, STARS)).alias("bucket"))
    sizes = checkpoint(first.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"))
    live = attach_groups(first, sizes, "bucket", "m", "inner")
    mine = checkpoint(live.groupBy("id", "n").agg(F.sum("m").alias("weight"), F.collect_list("bucket").alias("at")))
    each = mine.select("id", "n", "weight", F.explode("at").alias("bucket"))
    centres = checkpoint(each.groupBy("bucket").agg(F.count("*").alias("m"), F.max(F.struct("weight", F.col("id").alias("centre"), F.col("n").alias("k"))).alias("top")))
    pairs = attach_groups(each, centres, "bucket", "m", "inner").filter((F.col("id") != F.col("top.centre")) & alike(F.col("n"), F.col("top.k"), least))
    return pairs.select(F.least("id", "top.centre").alias("a"), F.greatest("id", "top.centre").alias("b")).distinct()


def links_of(rows: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Edges a < b of at least the similarity, enough to connect all texts that share a bucket and a link.

    rows: id, bands, n. First each text is compared with the centres of some of its buckets. Of the buckets that then
    hold texts which are not connected, small ones are compared in full, but for connected pairs, and the members of
    large ones meet by their differences from one of their family, and by prefixes those of other families.
    """
    done = verify(checkpoint(stars(rows, least)), docs)
    edges = done.filter(F.col("similarity") >= least).select("a", "b")
    label = components(edges)
    known = checkpoint(rows.join(label, "id", "left").select("id", "n", "bands", F.coalesce("label", "id").alias("label")))
    each = known.select("id", "n", "label", F.explode("bands").alias("bucket"))
    mixed = checkpoint(each.groupBy("bucket").agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high"))
    live = checkpoint(attach_groups(each, mixed.select("bucket", "m"), "bucket", "m", "inner"))
    few = live.filter(F.col("m") <= SMALL)
    other = few.select("bucket", *[F.col(c).alias(f"o_{c}") for c in ("id", "n", "label")])
    pairs = few.join(other, "bucket").filter((F.col("id") < F.col("o_id")) & (F.col("label") != F.col("o_label")) & alike(F.col("n"), F.col("o_n"), least))
    pairs = checkpoint(pairs.select(F.col("id").alias("a"), F.col("o_id").alias("b")).distinct().join(done.select("a", "b"), ["a", "b"], "left_anti"))
    edges = edges.unionByName(verify(pairs, docs).filter(F.col("similarity") >= least).select("a", "b"))
    crowd = checkpoint(live.filter(F.col("m") > SMALL).select("id", "label").distinct())
    if crowd.isEmpty():
        return edges
    members = hubs_of(crowd, done)
    sets = shingle_sets(checkpoint(members.select(F.explode(F.array("id", "hub", "root")).alias("id")).distinct()), docs)
    kin = differences(members, sets)
    near = kin.filter((F.col("id") != F.col("family")) & (likeness(F.col("n"), F.col("m"), F.size("d")) >= least))
    edges = edges.unionByName(near.select(F.least("id", "family").alias("a"), F.greatest("id", "family").alias("b")))
    pairs = family_pairs(kin, least).unionByName(crowd_pairs(kin.select("id", "label", "family"), docs, least, sets))
    pairs = checkpoint(pairs.join(done.select("a", "b"), ["a", "b"], "left_anti"))
    return edges.unionByName(verify(pairs, docs).filter(F.col("similarity") >= least).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """id and label, the least id that it is connected to, by turns of large and small stars.

    The least neighbours of a turn are a table, so that their join, which has all links of a large class under one key,
    is one that Spark may split. The tables of a turn go with it.
    """
    e, mark = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = checkpoint(large)
        below = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(below, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(below.select("u", F.col("m").alias("v"))).distinct()
        new = checkpoint(small)
        for old in (e, least, large, below):
            discard(old)
        e = new
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return e.select(F.col("u").alias("id"), F.col("v").alias("label"))
        mark = now


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: key, class_id (the least key of those it is connected to), class_docs and kept.

    kept is true for one document of each class, the one that gives it its id. Texts of the same words in the same
    order are copies, whatever is between the words. A text without a word, or null, and a document with a null key is
    a class of its own (class_id is its key) and kept; one of any length is read whole, CHUNK bytes at a time. Keys are whole numbers and should be unique: repeated rows are
    copies of each other with one key, and all of them are kept or none. No rows in, no rows out. Other columns of docs
    are neither read nor returned.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    with small_batches(rows.sparkSession):
        sketches = checkpoint(rows.mapInArrow(lean(sketch), "id long, fp binary, bands array<long>, n long"))
    known = sketches.select("id", F.when(F.col("id").isNotNull(), F.col("fp")).alias("fp"))
    groups = checkpoint(known.filter("fp is not null").groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    own = sketches.join(groups.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"]).select("id", "bands", "n")
    edges = links_of(checkpoint(own), rows, least)
    label = components(edges)
    classes = groups.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("label", "rep").alias("class_id"), "n")
    sizes = classes.groupBy("class_id").agg(F.sum("n").alias("class_docs"))
    out = attach_groups(known, checkpoint(classes.join(sizes, "class_id")), "fp", "n")
    return out.select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_docs", F.lit(1)).alias("class_docs"), F.coalesce(F.col("class_id") == F.col("id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without those that are not kept, with its own columns; of repeated rows of a key, one stays.

    Texts that are null, empty or of any length, null keys and empty tables are as near_duplicates says: what has no words
    or no key stays. Columns of docs keep their names, whatever these are.
    """
    found = checkpoint(near_duplicates(docs, text=text, key=key))
    gone = checkpoint(found.filter("not kept").select(F.col(key).alias("id")).distinct())
    out = pick(docs, gone, keep=False, key=key)
    again = found.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").isEmpty()
    return out if again else out.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(out.filter(F.col(key).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
