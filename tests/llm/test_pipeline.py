"""The stages of the pipeline one after another, against brute force."""

from __future__ import annotations

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import byte_bpe, mixing
from tests.llm.test_near_duplicates import classes
from tests.llm.test_row_operators import plain_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "123 456", "en", "src0", 7), (10**6 + 2, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(extra).withColumns({c: F.lit("clash") for c in ("id", "score", "lang_pred", "kept", "bucket")})
    columns, n = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = {r["doc_id"]: r for r in docs.collect()}
        n.append(len(after))
        assert set(after) <= set(before) and docs.count() == len(after)
        if name != "bpe":
            assert docs.columns == columns
        if name == "language_id":
            assert set(before) - set(after) == {10**6, 10**6 + 1, 10**6 + 2}
        elif name == "near_dedup":
            assert set(after) == {i for i, c in classes({i: r["text"] for i, r in before.items()}).items() if i == c}
        elif name == "pii":
            assert set(after) == set(before)
            for i, r in after.items():
                assert plain_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])
                assert plain_spans(before[i]["text"]) or r["text"] == before[i]["text"] or "<SECRET>" in r["text"] or "<PHONE>" in r["text"]
        elif name == "mixing":
            assert after == {i: before[i] for i in after}
            assert 0.3 < sum(len(r["text"]) for r in after.values()) / sum(len(r["text"]) for r in before.values()) < 0.7
            again = {r["doc_id"] for r in mixing.mix(spark.read.parquet(f"{tmp_path}/{i - 1}")).collect() if r["kept"]}
            assert set(after) == again
        else:
            t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(public_tokenizers.path(byte_bpe.VOCABULARY)), special_tokens={})
            assert {i: list(r["ids"]) for i, r in after.items()} == {i: t.encode_ordinary(r["text"]) for i, r in before.items()}
            assert all(r["decoded_ok"] and r["n_tokens"] == len(r["ids"]) for r in after.values())
    assert n[0] > n[1] == n[2] > n[3] == n[4] > 0


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_long_texts_and_repeated_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null").dropDuplicates(["text"])
    long = " ".join(r["text"] for r in docs.filter("lang = 'en'").collect()) * 12
    twice = [(10**6, long, "en", "src0", len(long))] * 2 + [(10**6 + 1, long.replace(" the ", " that ", 3), "en", "src1", len(long))]
    docs = docs.unionByName(spark.createDataFrame(twice, docs.schema))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        if name == "mixing":
            continue
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept = sorted(r["doc_id"] for r in docs.filter("doc_id >= 1000000").select("doc_id").collect())
        assert kept == ([10**6, 10**6, 10**6 + 1] if name == "language_id" else [10**6])
    row = docs.filter("doc_id = 1000000").select("decoded_ok", "n_tokens").first()
    assert row["decoded_ok"] and row["n_tokens"] > 100_000
