"""Byte-level BPE encoding and decoding.

A text's pieces, the matches of the tokenizer's pattern, are cut in the JVM. The pieces of the corpus are counted, by
batches first; the most frequent ones, at most MOST, are encoded once each: higher-order functions fold merges over the
array of a word's bytes, always the leftmost of the lowest rank, which a literal rank map gives. Their ids are broadcast, a
table of bounded size, and the texts' pieces looked up in it, a batch at a time and without a shuffle. Pieces that are too
rare for the table are encoded where they occur, by the same merges in numpy, many words at once, and those longer than
LONG bytes with a heap. Decoding takes the bytes of each id from an array and joins them.

Bytes go through expressions as text, one character from U+0000 to U+00FF a byte.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound_batches, checkpoint, lean, let, read, short_plans

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The table of encoded pieces has so many rows at most.
MOST = 1 << 18
#: Bytes of a piece up to which merges are folded by higher-order functions, which take time with the square of it.
LONG = 48
#: The rank map is an array of so many small maps, since looking up in a map literal is linear.
SHELVES = 1 << 13
#: Pieces that a task works on at a time.
SLICE = 1 << 18
NONE = 2**31 - 1


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def latin(data: bytes) -> str:
    return data.decode("latin-1")


def rank_map(path: str) -> Column:
    shelves: list[dict[str, int]] = [{} for _ in range(SHELVES)]
    for data, rank in ranks(path).items():
        shelves[zlib.crc32(latin(data).encode()) % SHELVES][latin(data)] = rank
    return F.from_json(F.lit(json.dumps(shelves)), "array<map<string,int>>")


def token_array(path: str) -> Column:
    by = {rank: latin(data) for data, rank in ranks(path).items()}
    return F.from_json(F.lit(json.dumps([by.get(i, "") for i in range(max(by) + 1)])), "array<string>")


def rank_of(table: Column, part: Column) -> Column:
    """The rank of some bytes, NONE if they are no token."""
    shelf = F.get(table, (F.crc32(part.cast("binary")) % SHELVES).cast("int"))
    return F.coalesce(F.element_at(shelf, part), F.lit(NONE))


def fold(word: Column, table: Column) -> Column:
    """The ids of a word of at least one byte.

    The state has the parts of the word and the ranks of neighbours. A merge makes one part of two, whose ranks with the
    parts around it are the only new ones. The table is named once, so that a plan holds one copy of it.
    """
    return let(table, lambda t: folded(word, t))


def folded(word: Column, table: Column) -> Column:
    def merge(parts: Column, r: Column, at: Column) -> Column:
        def joined(both: Column) -> Column:
            before = F.when(at > 1, rank_of(table, F.concat(F.get(parts, at - 2), both)))
            behind = F.when(at < F.size(r), rank_of(table, F.concat(both, F.get(parts, at + 1))))
            ranks_ = F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), F.array_compact(F.array(before, behind)), F.slice(r, at + 2, F.size(r)))
            return F.struct(F.concat(F.slice(parts, F.lit(1), at - 1), F.array(both), F.slice(parts, at + 2, F.size(parts))).alias("parts"), ranks_.alias("r"))

        return let(F.concat(F.get(parts, at - 1), F.get(parts, at)), joined)

    def step(state: Column, _: Column) -> Column:
        parts, r = state["parts"], state["r"]
        low = F.array_min(r)
        return F.when(F.coalesce(low, F.lit(NONE)) == NONE, state).otherwise(merge(parts, r, F.array_position(r, low).cast("int")))

    def first(letters: Column) -> Column:
        pairs = F.filter(F.transform(letters, lambda x, i: F.when(i + 1 < F.size(letters), rank_of(table, F.concat(x, F.get(letters, i + 1))))), lambda x: x.isNotNull())
        return F.struct(letters.alias("parts"), pairs.alias("r"))

    start = let(F.filter(F.split(word, ""), lambda x: x != ""), first)
    parts = F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step, lambda s: s["parts"])
    return let(rank_of(table, word), lambda own: F.when(own != NONE, F.array(own)).otherwise(F.transform(parts, lambda p: rank_of(table, p))))


def merged(data: bytes, rank: dict[bytes, int]) -> list[int]:
    """The ids of a piece by the same merges, with a heap of pairs: for pieces that have no row in the table."""
    if data in rank:
        return [rank[data]]
    n = len(data)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    gone = [False] * n
    heap = [(rank[p], i, i + 2) for i in range(n - 1) if (p := data[i : i + 2]) in rank]
    heapq.heapify(heap)
    while heap:
        r, i, e = heapq.heappop(heap)
        j = end[i]
        if gone[i] or j >= n or end[j] != e or gone[j]:
            continue
        gone[j] = True
        end[i] = e
        if e < n:
            before[e] = i
            if (s := rank.get(data[i : end[e]])) is not None:
                heapq.heappush(heap, (s, i, end[e]))
        if (h := before[i]) >= 0 and (s := rank.get(data[h:e])) is not None:
            heapq.heappush(heap, (s, h, e))
    return [rank[data[i : end[i]]] for i in range(n) if not gone[i]]


class Merges:
    """The same merges of many words at once, in numpy.

    Words of one length in bytes go together. Each round merges one pair of every word that still has one, so that all that
    are left have the same number of parts.
    """

    def __init__(self, rank: dict[bytes, int]):
        self.rank = rank
        self.byte = np.array([rank.get(bytes([i]), NONE) for i in range(256)], np.int32)
        pairs = {}
        for token, r in rank.items():
            for i in range(1, len(token)):
                left, right = rank.get(token[:i]), rank.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = r
        self.key = np.array(sorted(pairs), np.int64)
        self.value = np.array([pairs[k] for k in self.key.tolist()], np.int32)
        self.two = np.full((256, 256), NONE, np.int32)
        for token, r in rank.items():
            if len(token) == 2:
                self.two[token[0], token[1]] = r

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of tokens, NONE of those that make none."""
        if not len(self.key):
            return np.full(len(left), NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.value[at], NONE)

    def one_length(self, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of words, a row of bytes each, and their ids, a row each, as words are done."""
        place, parts, r = np.arange(len(letters)), self.byte[letters], self.two[letters[:, :-1], letters[:, 1:]]
        while r.shape[1] and len(place):
            at = r.argmin(axis=1)
            low = r[np.arange(len(place)), at]
            left = low != NONE
            if not left.all():
                yield place[~left], parts[~left]
                place, parts, r, at, low = place[left], parts[left], r[left], at[left], low[left]
            row, n = np.arange(len(place)), r.shape[1]
            parts[row, at] = low
            stay = np.ones(parts.shape, bool)
            stay[row, at + 1] = False
            parts = parts[stay].reshape(len(place), n)
            stay = np.ones(r.shape, bool)
            stay[row, at] = False
            r = r[stay].reshape(len(place), n - 1)
            i = np.flatnonzero(at > 0)
            r[i, at[i] - 1] = self.rank_of(parts[i, at[i] - 1], low[i])
            i = np.flatnonzero(at < n - 1)
            r[i, at[i]] = self.rank_of(low[i], parts[i, at[i] + 1])
        if len(place):
            yield place, parts

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them, one after another."""
        size, found, length = np.zeros(len(words), np.int64), [], defaultdict(list)
        for i, w in enumerate(words):
            if (own := self.rank.get(w)) is not None:
                size[i] = 1
                found.append((np.array([i]), np.array([[own]])))
            elif len(w) > LONG or not w:
                own = merged(w, self.rank)
                size[i] = len(own)
                found.append((np.array([i]), np.array([own])))
            else:
                length[len(w)].append(i)
        for n, of in length.items():
            of = np.array(of)
            letters = np.frombuffer(b"".join([words[i] for i in of]), np.uint8).reshape(-1, n)
            if (self.byte[letters] == NONE).any():
                raise KeyError("a byte has no token")
            for place, ids in self.one_length(letters):
                size[of[place]] = ids.shape[1]
                found.append((of[place], ids))
        start = np.cumsum(size) - size
        flat = np.zeros(size.sum(), np.int32)
        for of, ids in found:
            flat[start[of][:, None] + np.arange(ids.shape[1])] = ids
        return size, flat


def pieces(text: Column, pattern: str) -> Column:
    """Matches of the pattern; null where a character is unknown to the JVM, which Python then splits.

    All characters below U+0378 are known to it, so that their kind need not be looked up.
    """
    return F.when(text.rlike(r"[\x{378}-\x{10FFFF}&&\p{Cn}]"), F.lit(None)).otherwise(F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), 0))


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The most frequent of the counted words: all that occur 2 ** i times or more, for the least i that fits."""
    level = F.floor(F.log2(F.col("n"))).cast("int")
    sizes = sorted(((r["l"], r["c"]) for r in words.groupBy(level.alias("l")).agg(F.count("*").alias("c")).collect()), reverse=True)
    least, total = 64, 0
    for i, c in sizes:
        if total + c > most:
            break
        least, total = i, total + c
    return words.filter(level >= least)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different pieces of each batch of arrays of them, and how often they are there."""
    for batch in batches:
        coded = batch.column(0).flatten().dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n, pa.int64())], names=["piece", "n"])


def table_of(rows: DataFrame, path: str, most: int) -> pa.Table:
    """Frequent pieces of a column of arrays `p`, and their ids."""
    words = checkpoint(rows.select("p").mapInArrow(lean(counted), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")))
    some = frequent(words, most).filter(F.octet_length("piece") <= LONG)
    word = F.decode(F.col("piece").cast("binary"), "ISO-8859-1")
    with short_plans(rows.sparkSession):
        return some.select("piece", fold(word, rank_map(path)).alias("ids")).toArrow()


class Encoder:
    """Looks pieces up, and encodes those that are not there."""

    def __init__(self, table: pa.Table, path: str, pattern: str):
        self.table, self.path, self.pattern, self.merges = table.combine_chunks(), path, pattern, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"merges": None}

    def lists(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after another: where those of each start, how many they are, and all of them."""
        self.merges = self.merges or Merges(ranks(self.path))
        if self.table.num_rows:
            known, ids = self.table["piece"].chunk(0), self.table["ids"].chunk(0)
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            found = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
            start, size = at[found].astype(np.int64), (at[found + 1] - at[found]).astype(np.int64)
        else:
            flat, found = np.zeros(0, np.int32), np.full(len(words), -1)
            start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        rare = np.flatnonzero(found < 0)
        size[rare], own = self.merges.ids(words.take(pa.array(rare)).cast(pa.binary()).to_pylist())
        start[rare] = len(flat) + np.cumsum(size[rare]) - size[rare]
        return start, size, np.concatenate([flat, own])

    def encode(self, p: pa.ListArray) -> pa.ListArray:
        """The ids of each array of pieces."""
        coded = p.flatten().dictionary_encode()
        start, size, flat = self.lists(coded.dictionary)
        code = coded.indices.to_numpy()
        n = size[code]
        run = np.cumsum(n)
        ids = flat[np.repeat(start[code] - (run - n), n) + np.arange(run[-1] if len(run) else 0)]
        ends = np.r_[0, run][p.offsets.to_numpy() - p.offsets[0].as_py()]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))

    def split(self, text: str) -> list[str]:
        import regex

        return regex.findall(self.pattern, text)


def slices(p: pa.ListArray) -> Iterator[pa.ListArray]:
    """Parts of about SLICE pieces."""
    at, start = p.offsets.to_numpy(), 0
    while start < len(p):
        end = max(start + 1, int(np.searchsorted(at, at[start] + SLICE, side="right")) - 1)
        yield p.slice(start, end - start)
        start = end


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, pattern: str = public_tokenizers.PATTERN, most: int = MOST) -> DataFrame:
    """The kept columns and ids, an array that is empty for a text that is null or empty; repeated rows each get theirs.

    path names a vocabulary of lines of base64 and rank. No special tokens are looked for. A text of any length is encoded
    whole. No rows in, no rows out. keep must not name ids; other columns of docs, whatever their names, are not returned.
    """
    if "ids" in keep:
        raise ValueError("ids is the name of the result")
    bound_batches(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, pieces(t, pattern).alias("p"), t.alias("_t"))
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(table_of(rows.select("p"), path, most), path, pattern))
    rows = rows.withColumn("_t", F.when(F.col("p").isNull(), F.col("_t")))
    k = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, odd = batch.column(k), batch.column(k + 1)
            if odd.null_count < len(odd):
                both = zip(p.to_pylist(), odd.to_pylist(), strict=True)
                p = pa.array([x if t is None else shared.value.split(t) for x, t in both], pa.list_(pa.string()))
            ids = pa.concat_arrays([shared.value.encode(x) for x in slices(p)] or [pa.array([], pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], ids], names=[*keep, "ids"])

    return rows.mapInArrow(lean(work), rows.select(*keep, F.array(F.lit(0)).alias("ids")).schema)


def decode(ids: Column, path: str | None = None) -> Column:
    """The bytes of the ids, joined, of any number. An id that is null or no token has none; no ids make no bytes, and a
    null array makes null."""
    tokens = token_array(path or public_tokenizers.path(VOCABULARY))
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(tokens, i)), ""), "ISO-8859-1")


def digests(coded: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_tokens, and digests of the ids as decimals joined by spaces and of the bytes that they stand for.

    ids must be tokens, as `encode` gives them; bytes are those of `decode`, joined in Arrow batches.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    k = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = {r: token for token, r in ranks(path).items()}
        size = max(by, default=-1) + 1
        tokens, decimals = pa.array([by.get(i, b"") for i in range(size)], pa.large_binary()), pa.array([b"%d " % i for i in range(size)], pa.large_binary())
        for batch in batches:
            lists = batch.column(k)
            ends, ids = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()

            def hashed(table: pa.Array, last: int) -> pa.Array:
                """Of each row, the bytes of its ids in the table without the last ones."""
                found = table.take(ids)
                at = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[ends].tolist()
                data = memoryview(found.buffers()[2] or b"")
                return pa.array([hashlib.sha256(data[i : max(i, j - last)]).hexdigest() for i, j in zip(at, at[1:], strict=False)], pa.string())

            n = lists.value_lengths().cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], n, hashed(decimals, 1), hashed(tokens, 0)], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    kinds = coded.select(*keep, F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema
    return coded.select(*keep, "ids").mapInArrow(lean(work), kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(read(spark, sf_dir, "documents", "doc_id", "text")))
