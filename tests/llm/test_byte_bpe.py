"""Byte-level BPE against the tiktoken library."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from lectern.llm import byte_bpe

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(byte_bpe.VOCABULARY)
OTHER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None,
    "",
    "Hello world, it's 2024!  Two  spaces\n\n\ttabs   ",
    "naïve façade — “quotes” 日本語のテキスト 😀👩‍👩‍👧   x\u0085y",
    "a" * 5000 + " " * 300 + "=" * 500,
    "<|endoftext|> <|endoftext|>",
    "x\x00\x01\x7f y\x1c\x1dz",
    "\U00010570\U00010571 \U0001e030 \U00031350",
    "Hello world, it's 2024!  Two  spaces\n\n\ttabs   ",
]


def library(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(path), special_tokens={})


@pytest.mark.parametrize("path", [PATH, OTHER])
@pytest.mark.parametrize("most", [byte_bpe.MOST, 3])
def test_ids(spark, path, most):
    t = library(path)
    docs = spark.createDataFrame([(i, x, "clash", 1) for i, x in enumerate(TEXTS)], "doc_id long, text string, ids string, p int")
    coded = byte_bpe.encode(docs, path=path, most=most)
    rows = coded.withColumn("back", byte_bpe.decode(coded["ids"], path)).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in rows} == {i: t.encode_ordinary(x or "") for i, x in enumerate(TEXTS)}
    assert {r["doc_id"]: bytes(r["back"]) for r in rows} == {i: (x or "").encode() for i, x in enumerate(TEXTS)}


def test_heap_merges():
    t, rank = library(PATH), byte_bpe.ranks(PATH)
    for text in ["ababab", "mississippi", "ééééé", " " * 7, "aaaaaaaab", "zzxqj"]:
        assert byte_bpe.merged(text.encode(), rank) == t.encode_ordinary(text)


@pytest.mark.parametrize("path", [PATH, OTHER])
def test_rare_words_are_merged_together(path, monkeypatch):
    """Words that have no row in the table go through numpy at once; only long ones have a heap each."""
    import random

    t, rng, heap = library(path), random.Random(5), byte_bpe.merged
    words = ["".join(rng.choice("aabcdeinorst éß日0=\u0085") for _ in range(n)) for n in list(range(1, 24)) * 20] + ["a" * 48, "é" * 30, "ab" * 500, "the", " "]
    words = list(dict.fromkeys(words))
    seen = []
    monkeypatch.setattr(byte_bpe, "merged", lambda data, rank: seen.append(data) or heap(data, rank))
    table = pa.table({"piece": pa.array(["the"]), "ids": pa.array([t._encode_single_piece(b"the")], pa.list_(pa.int32()))})
    start, size, flat = byte_bpe.Encoder(table, path, public_tokenizers.PATTERN).lists(pa.array(words))
    assert [flat[i : i + n].tolist() for i, n in zip(start, size, strict=True)] == [t._encode_single_piece(w.encode()) for w in words]
    assert sorted(map(len, seen)) == [60, 1000]


def test_unknown_characters_are_found(spark):
    """The shorter search finds the characters that the JVM does not know, and no others."""
    points = [*range(0x300, 0x600), 0x1FFFF, 0x30000, 0xE0000, 0x10FFFF, 0x1F600]
    rows = spark.createDataFrame([(i, chr(i)) for i in points], "i int, c string")
    assert rows.filter(byte_bpe.pieces(rows.c, ".").isNull() != rows.c.rlike(r"\p{Cn}")).count() == 0
    low = spark.createDataFrame([("".join(map(chr, range(0x378))),)], "c string")
    assert not low.filter(low.c.rlike(r"\p{Cn}")).count(), "none below U+0378 is unknown"


def test_digests(spark):
    t = library(OTHER)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").coalesce(1)
    rows = byte_bpe.digests(byte_bpe.encode(docs, keep=("id",), path=OTHER), OTHER, ("id",)).collect()
    for r in rows:
        text = TEXTS[r["id"]] or ""
        ids = t.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert len(rows) == len(TEXTS)
    assert byte_bpe.digests(spark.createDataFrame([], "doc_id long, ids array<int>")).count() == 0


def test_query(spark):
    t = library(PATH)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = byte_bpe.query(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = t.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_long_texts_and_slices(spark, monkeypatch):
    t = library(PATH)
    texts = ["word " * 200_000 + "end", "x" * 100_000, " ".join(f"w{i}" for i in range(60_000)), None, "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(byte_bpe, "SLICE", 1000)
    rows = byte_bpe.encode(docs).collect()
    assert sorted((r["doc_id"], len(r["ids"])) for r in rows) == sorted((i, len(t.encode_ordinary(x or ""))) for i, x in enumerate(texts) for _ in range(2))
    with pytest.raises(ValueError, match="ids"):
        byte_bpe.encode(docs.withColumn("ids", docs.text), keep=("doc_id", "ids"))


def test_folded_words(spark):
    """The expression alone, over words of all lengths."""
    import random

    from pyspark.sql import functions as F

    t, rng = library(PATH), random.Random(3)
    words = ["".join(rng.choice("abcdeinorst éß") for _ in range(n)).strip() or "x" for n in list(range(1, 48)) * 6]
    words = [w for w in words if len(w.encode()) <= byte_bpe.LONG]
    word = F.decode(F.col("w").cast("binary"), "ISO-8859-1")
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", byte_bpe.fold(word, byte_bpe.rank_map(PATH)).alias("ids")).collect()
    assert all(list(r["ids"]) == t._encode_single_piece(r["w"].encode()) for r in rows)


def test_empty(spark):
    assert byte_bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
