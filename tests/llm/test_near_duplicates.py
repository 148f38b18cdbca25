"""Near duplicates against all pairs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import near_duplicates as nd


def multiset(text: str | None) -> Counter:
    w = [x for x in (text or "").replace("\n", " ").split(" ") if x]
    if len(w) < nd.WORDS:
        return Counter([tuple(w)] if w else [])
    return Counter(tuple(w[i : i + nd.WORDS]) for i in range(len(w) - nd.WORDS + 1))


def jaccard(a: Counter, b: Counter) -> float:
    return sum((a & b).values()) / sum((a | b).values()) if a and b else 0.0


def classes(texts: dict[int, str | None]) -> dict[int, int]:
    """The least id of all that are connected, over all pairs that share a shingle."""
    sets = {i: multiset(t) for i, t in texts.items()}
    by: dict = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    seen = set()
    for own in by.values():
        for n, i in enumerate(own):
            for j in own[:n]:
                if (i, j) not in seen and root(i) != root(j):
                    seen.add((i, j))
                    if jaccard(sets[i], sets[j]) >= nd.SIMILARITY:
                        a, b = sorted((root(i), root(j)))
                        up[b] = a
    return {i: root(i) for i in texts}


def signature(texts: list[str]) -> np.ndarray:
    data, at = nd.text_bytes(pa.array(texts))
    (_, _, w, of), = nd.chunks(data, at)
    s, so, n = nd.counted(*nd.shingles(w, of))
    return nd.signatures(s, so, n, len(texts))


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    agree, want = [], []
    for k in range(100):
        base = [f"w{k}x{i}" for i in range(120)]
        v = list(base) * (1 + k % 3)
        for _ in range(k % 20):
            v[rng.integers(len(v))] = f"x{rng.integers(10**6)}"
        a, b = " ".join([f"s{k}", *base * (1 + k % 2)]), " ".join([f"s{k}", *v])
        sig = signature([a, b])
        agree.append((sig[0] == sig[1]).mean())
        want.append(jaccard(multiset(a), multiset(b)))
    assert abs(np.mean(np.array(agree) - want)) < 0.015
    assert np.abs(np.array(agree) - want).max() < 0.2


def test_words_do_not_depend_on_neighbours():
    texts = ["one two  three four\tfive six", "", None, "one two three", " x ", "one two three four five six"]
    data, at = nd.text_bytes(pa.array(texts))
    whole = [(w.tolist(), of.tolist()) for _, _, w, of in nd.chunks(data, at)]
    assert whole[0][1] == [0] * 6 + [3] * 3 + [4] + [5] * 6
    assert whole[0][0][:6] == whole[0][0][-6:] and whole[0][0][:3] == whole[0][0][6:9]
    part = nd.text_bytes(pa.array(texts).slice(3, 2))
    assert next(nd.chunks(*part))[2].tolist() == whole[0][0][6:10]


def test_long_text_in_parts(monkeypatch):
    text = " ".join(f"word{i % 97}" for i in range(3000))
    one = signature([text])
    monkeypatch.setattr(nd, "CHUNK", 1000)
    data, at = nd.text_bytes(pa.array([text]))
    (_, _, w, of), = nd.chunks(data, at)
    s, so, n = nd.counted(*nd.shingles(w, of))
    assert (nd.signatures(s, so, n, 1) == one).all()


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = nd.query(spark, sf).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == classes(texts)
    n = Counter(r["class_id"] for r in rows)
    assert all(r["class_docs"] == n[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in rows)


@pytest.fixture(scope="module")
def heap():
    """A large group of near copies, a chain, and many texts with one passage in common."""
    rng = np.random.default_rng(2)
    word = lambda: f"v{rng.integers(10**6)}"
    base, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    texts, chain = {}, [word() for _ in range(200)]
    for i in range(120):
        v = list(base)
        for _ in range(rng.integers(1, 4)):
            v[rng.integers(150)] = word()
        texts[i] = " ".join(v)
    for i in range(200, 240):
        chain[(i * 5) % 200] = word()
        chain[(i * 5 + 1) % 200] = word()
        texts[i] = " ".join(chain)
    for i in range(300, 420):
        texts[i] = " ".join([*passage, *(word() for _ in range(30))])
    texts |= {500: None, 501: "", 502: "too short", 503: "too short", 504: "too  short\n", 505: " \t ", 506: texts[3]}
    return texts


def test_groups(spark, heap):
    rows = nd.near_duplicates(spark.createDataFrame([(i, t, i, "x") for i, t in heap.items()], "doc_id long, text string, id long, fp string").repartition(3)).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == classes(heap)


def test_deduplicate(spark, heap):
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in heap.items()] + [(1, heap[1], 0), (300, heap[300], len(heap[300])), (None, "x", 1), (None, "x", 1)], "doc_id long, text string, n_chars long")
    want = {i for i, c in classes(heap).items() if i == c}
    got = [r["doc_id"] for r in nd.deduplicate(docs).collect()]
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 2
    assert nd.deduplicate(docs.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)]
    up = {i: i for p in pairs for i in p}
    for _ in range(400):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["id"]: r["label"] for r in nd.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {i for a, b in pairs if a != b for i in (a, b)}
    assert got == {i: up[i] for i in linked if up[i] != i}


@pytest.mark.parametrize(("counters", "crowded"), [(1, 1 << 40), (1 << 10, 1 << 40), (1 << 22, 8), (1 << 21, 0)])
def test_prefixes_meet(spark, heap, counters, crowded, monkeypatch):
    monkeypatch.setattr(nd, "COUNTERS", counters)
    monkeypatch.setattr(nd, "CROWDED", crowded)
    monkeypatch.setattr(nd, "MEET", 7)
    monkeypatch.setattr(nd, "BLOCK", min(counters, 1 << 8))
    docs = spark.createDataFrame(list(heap.items()), "id long, text string")
    label = {i: i % 5 if i < 200 else i for i in heap}
    crowd = spark.createDataFrame(list(label.items()), "id long, label long")
    got = {(r["a"], r["b"]) for r in nd.crowd_pairs(crowd, docs, nd.SIMILARITY).collect()}
    sets = {i: multiset(t) for i, t in heap.items()}
    want = {(i, j) for i in sets for j in sets if i < j and label[i] != label[j] and jaccard(sets[i], sets[j]) >= nd.SIMILARITY}
    assert want <= got
    if counters > 1 << 10:
        assert not [p for p in got if set(p) & set(range(300, 420))], "texts with no more than a passage in common"


@pytest.mark.parametrize("split", [3, 1000])
def test_verify_splits_hot_texts(spark, heap, split, monkeypatch):
    monkeypatch.setattr(nd, "SPLIT", split)
    docs = spark.createDataFrame(list(heap.items()), "id long, text string")
    pairs = [(0, i) for i in range(1, 120)] + [(1, 2), (502, 503)]
    got = {(r["a"], r["b"]): r["similarity"] for r in nd.verify(spark.createDataFrame(pairs, "a long, b long"), docs).collect()}
    assert got == pytest.approx({(a, b): jaccard(multiset(heap[a]), multiset(heap[b])) for a, b in pairs})


def test_long_texts(spark):
    words = [f"w{(i * 7919) % 4001}" for i in range(120_000)]
    near = [w if i % 400 else "changed" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words))), (4, "\n".join(words))], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def copies(n: int, words: int = 120, changed: int = 3) -> dict[int, str]:
    """Texts that each differ in other words from one text, which is not there; few pairs are linked."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(words)]
    texts = {}
    for i in range(n):
        v = list(base)
        for at in rng.choice(words, changed, replace=False):
            v[at] = f"c{rng.integers(10**9)}"
        texts[i] = " ".join(v)
    return texts


def compared(spark, texts: dict[int, str], monkeypatch) -> tuple[int, dict[int, int]]:
    """How many pairs of texts are verified, and the class of each."""
    made, verify = [], nd.verify
    with monkeypatch.context() as m:
        m.setattr(nd, "verify", lambda pairs, docs: made.append(pairs.count()) or verify(pairs, docs))
        rows = nd.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    return sum(made), {r["doc_id"]: r["class_id"] for r in rows}


def test_pairs_of_copies_that_are_not_linked(spark, monkeypatch):
    few, _ = compared(spark, copies(150), monkeypatch)
    texts = copies(600)
    many, got = compared(spark, texts, monkeypatch)
    assert many <= 4 * few, (few, many)
    assert got == classes(texts)


def test_differences_from_a_family(spark):
    """Deletions, changes that texts share, chains of them and a text of no family: no link between two labels is lost."""
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(100)]
    texts = {0: " ".join(base)}
    for i in range(1, 240):
        v, first = list(base), rng.integers(0, 80)
        for at in range(first, first + rng.integers(1, 14)):
            v[at] = "" if i % 3 == 0 else f"d{at}" if i % 3 == 1 else f"e{rng.integers(10**9)}"
        texts[i] = " ".join(x for x in v if x)
    texts[240] = " ".join(f"z{i}" for i in range(50))
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    sets = {i: multiset(t) for i, t in texts.items()}
    want = {(i, j) for i in sets for j in sets if i < j and jaccard(sets[i], sets[j]) >= nd.SIMILARITY}
    members = spark.createDataFrame([(i, i, 0 if i < 200 else 230 if i < 240 else i, 0 if i < 240 else i) for i in texts], "id long, label long, hub long, root long")
    kin = nd.differences(members, nd.shingle_sets(members.select("id"), docs))
    found = {r["id"]: r for r in kin.collect()}
    size = lambda i: sum(sets[i].values())
    for i, r in found.items():
        c = r["family"]
        assert (r["n"], r["m"], len(r["d"])) == (size(i), size(c), sum(((sets[i] - sets[c]) + (sets[c] - sets[i])).values()))
    pairs = {(r["a"], r["b"]) for r in nd.family_pairs(kin, nd.SIMILARITY).collect()}
    linked = {i for i, r in found.items() if (min(i, r["family"]), max(i, r["family"])) in want or i == r["family"]}
    assert {p for p in want if found[p[0]]["family"] == found[p[1]]["family"] and not linked >= set(p)} <= pairs
