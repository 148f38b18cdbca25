from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from lectern.llm import prefix_trie
from lectern.llm.queries import queries

SCHEMA = "conv_id long, turn long, role string, text string, key string, d int, n int"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Nodes of the trie of rows (conv_id, turn, role, text), by walking every prefix."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + v[h:]
    members = {}
    for c, v in made.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    children = {p: [] for p in members}
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[x] for x in children[p])
    ends = {p: ",".join(map(str, sorted(c for c in members[p] if len(made[c]) == len(p)))) for p in members}
    return sorted((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p in members)


def found(df, **more):
    got = prefix_trie.prefix_trie(df, **more)
    assert got.columns == COLS
    return sorted(tuple(r) for r in got.collect())


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA).repartition(parts)


def some(rng, n=160):
    rows = []
    for c in rng.permutation(n).tolist():
        if c % 7 != 3:
            rows += [(c, t, ("user", "assistant")[t % 2], "ab"[rng.integers(2)] * int(rng.integers(1, 3))) for t in range(int(rng.integers(1, 9)))]
    return rows


@pytest.mark.parametrize("bits", [64, 5])
def test_equals_a_walk(spark, bits, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 4)
    rows = some(np.random.default_rng(bits))
    assert found(frame(spark, rows), bits=bits) == brute(rows)


def test_long_conversations_in_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PART", 8)
    rows = [(c, t, "user", f"t{t % 11}" if t < 40 - c % 5 else f"own {c}") for c in (0, 1, 2, 3, 104, 250) for t in range(60 + c % 7)]
    assert found(frame(spark, rows, 6)) == brute(rows)


def test_edges(spark):
    rows = [(None, 0, "user", "lost"), (5, None, None, None), (5, 0, "user", None), (5, 0, "user", None), (5, 0, "a", "z"), (5, 0, "a", "y")]
    rows += [(0, 3, "user", "é😀"), (0, 1, "", "user"), (0, 2, "user", ""), (300, 1, "u", "x" * 300_000), (-7, 1, "u", "x"), (-101, 4, "u", "x")]
    rows += [(x, 1, "u", "x") for x in range(1, 40)] + [((1 << 60) + x, 1, "u", "x") for x in range(3)]
    assert found(frame(spark, rows)) == brute(rows)
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(None, 1, "u", "x")])) == []
    # every own turn gives way to the absent first of the family
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    assert found(frame(spark, [(alone, 1, "u", "x")])) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_many_ends_make_one_hash(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(100 * c, 0, "u", "same") for c in range(500)]
    assert found(frame(spark, rows, 9)) == brute(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    got = queries()["op13_prefix_trie"](spark, "/root/testdata/sf0.01")
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
