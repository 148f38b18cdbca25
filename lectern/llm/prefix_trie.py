"""The trie of all prefixes of conversations, with its counts.

Turns are numbered by a sort over the whole table, so that one long conversation is not one task's work. Each turn gets
a fingerprint; turns that share one are compared with the text of a representative, and another text under the same
fingerprint is a kind of its own, so that (mark, kind) stands for a text exactly. A numpy scan sums these along each
conversation as a polynomial, which gives every prefix a fingerprint. A prefix belongs to the representative of its
fingerprint if its depth, its last turn and the fingerprint of its parent are the representative's; as this is asked of
every prefix, whole prefixes are equal turn by turn. Where it fails the group is split, and asked again.

What is summed over subtrees needs no walk by levels: each node's value stands at its representative's own row, a
suffix sum carries it up along that conversation, and the rows of a node add up to its subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import attach_groups, bound_batches, checkpoint, lean, read

#: Conversations of one family, whose first may lend its turns, and the most turns that are lent.
FAMILY, LENT = 100, 5
#: Turns of one fingerprint whose texts a task compares at a time, on average.
RUN = 256
#: Turns of one conversation that are scanned by one task; sums of such parts are then added up.
PART = 4096
#: Ids that are joined to one piece of text.
PIECE = 1 << 16
#: Base of the polynomial.
BASE = 0x9E6C63D0876A3F6B

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits are as good as random."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def power(d: np.ndarray) -> np.ndarray:
    """BASE to each of d, modulo 2 ** 64."""
    out, base, d = np.ones(len(d), dtype=U), BASE, d.astype(U)
    for i in range(int(d.max()).bit_length() if len(d) else 0):
        out = np.where((d >> U(i)) & U(1), out * U(base), out)
        base = base * base % (1 << 64)
    return out


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal keys begins, the first row included."""
    n = len(keys[0])
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]) if n else np.zeros(0, int)


def since(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Running sums, which begin anew at each of at; values are unsigned and wrap."""
    run = np.cumsum(values)
    return run - np.repeat(run[at] - values[at], np.diff(np.r_[at, len(values)]))


def numbered(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows conv, chars, role, text become conv, part (this task), i (from 0), mark, chars, role, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, before = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not len(batch):
                continue
            conv = batch.column(0).to_numpy()
            at = starts(conv)
            i = np.arange(len(conv)) - np.repeat(at, np.diff(np.r_[at, len(conv)]))
            if conv[0] == last:
                i[: at[1] if len(at) > 1 else len(conv)] += before
            last, before = conv[-1], i[-1] + 1
            mark = np.zeros(len(conv), dtype=U)
            for k, (role, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                of = hashlib.blake2b(role.encode(), digest_size=8)
                of.update(b"\xff" + text.encode())
                mark[k] = int.from_bytes(of.digest(), "little")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(conv), part), pa.int32()), pa.array(i), pa.array((mark & U((1 << bits) - 1)).view(np.int64)), *batch.columns[1:]], names=["conv", "part", "i", "mark", "chars", "role", "text"])

    return run


def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by mark and salt get the number of their text among those of their mark and salt, and keep role and
    text only where they are the first of them."""
    at, known = None, {}
    for batch in batches:
        of, role, text = np.zeros(len(batch), dtype=np.int32), [], []
        key = zip(batch.column("mark").to_pylist(), batch.column("salt").to_pylist(), strict=True)
        for k, (now, *both) in enumerate(zip(key, batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)):
            if now != at:
                at, known = now, {}
            new = tuple(both) not in known
            of[k] = known.setdefault(tuple(both), len(known))
            role.append(both[0] if new else None)
            text.append(both[1] if new else None)
        kept = [batch.column(c) for c in ("id", "mark", "salt", "salts")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(of), pa.array(role, pa.string()), pa.array(text, pa.string())], names=["id", "mark", "salt", "salts", "kind", "role", "text"])


def kinds_of(rows: DataFrame) -> DataFrame:
    """id, mark and kind of turns whose mark is not theirs alone; rows: id, mark, role, text.

    The turns of a frequent mark are dealt to many tasks by salt; the first turn of each text there stands for it when
    these are compared with each other.
    """
    schema = "id struct<conv: long, part: int, i: long>, mark long, salt long, salts long, kind int, role string, text string"
    counts = checkpoint(rows.groupBy("mark").agg(F.count("*").alias("m")).filter("m > 1"))
    some = attach_groups(rows, counts, "mark", "m", "inner").withColumn("salts", F.ceil(F.col("m") / RUN)).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))

    def compared(x: DataFrame) -> DataFrame:
        return checkpoint(x.select("id", "mark", "salt", "salts", "role", "text").repartition("mark", "salt").sortWithinPartitions("mark", "salt").mapInArrow(lean(kinds), schema))

    local = compared(some)
    first = local.filter((F.col("salts") > 1) & F.col("text").isNotNull()).select("id", "mark", F.col("salt").alias("own"), F.lit(0).cast("long").alias("salt"), "salts", "kind", "role", "text")
    met = compared(first.drop("kind", "own")).select("id", F.col("kind").alias("final"))
    final = first.join(met, "id").select("mark", F.col("own").alias("salt"), "kind", "final")
    return local.select("id", "mark", "salt", "kind").join(final, ["mark", "salt", "kind"], "left").select("id", F.coalesce("final", "kind").alias("kind"))


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv, chunk and d get term, their turn's, and total, the sum of terms from the chunk's first."""
    last, before = None, U(0)
    for batch in batches:
        if not len(batch):
            continue
        conv, chunk, d, mark, kind = (batch.column(c).to_numpy() for c in ("conv", "chunk", "d", "mark", "kind"))
        term = mixed(mixed(mark.view(U)) + mixed(kind.astype(U) + U(1))) * power(d)
        at = starts(conv, chunk)
        total = since(term, at)
        if (conv[0], chunk[0]) == last:
            total[: at[1] if len(at) > 1 else len(conv)] += before
        last, before = (conv[-1], chunk[-1]), total[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(term.view(np.int64)), pa.array(total.view(np.int64))], names=[*batch.schema.names, "term", "total"])


def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows conv, chunk, total sorted by conv and chunk get carry, the sum of the totals of earlier chunks."""
    last, before = None, U(0)
    for batch in batches:
        if not len(batch):
            continue
        conv, total = batch.column(0).to_numpy(), batch.column(2).to_numpy().view(U)
        at = starts(conv)
        run = since(total, at)
        if conv[0] == last:
            run[: at[1] if len(at) > 1 else len(conv)] += before
        last, before = conv[-1], run[-1]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((run - total).view(np.int64))], names=["conv", "chunk", "carry"])


def fingerprint(total: np.ndarray, d: np.ndarray, bits: int) -> pa.Array:
    return pa.array((mixed(total + mixed(d.astype(U) + U(7))) & U((1 << bits) - 1)).view(np.int64))


def keyed(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with term, total and carry get key and prev, the fingerprints of the prefix and of its parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, term, total, carry = (batch.column(c).to_numpy() for c in ("d", "term", "total", "carry"))
            full = total.view(U) + carry.view(U)
            names = ["conv", "d", "mark", "kind", "chars", "turns"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], fingerprint(full, d, bits), fingerprint(full - term.view(U), d - 1, bits)], names=[*names, "key", "prev"])

    return run


def numbered_turns(rows: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Turns conv, pos (from 1), mark, kind, chars, and the conversations conv, n; rows: conv, turn, role, text."""
    placed = rows.repartitionByRange("conv", "turn").sortWithinPartitions("conv", "turn", "role", "text").select("conv", F.length("text").cast("long").alias("chars"), "role", "text")
    placed = checkpoint(placed.mapInArrow(lean(numbered(bits)), "conv long, part int, i long, mark long, chars long, role string, text string"))
    parts = placed.groupBy("conv", "part").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = checkpoint(parts.withColumn("before", before))
    # a conversation goes on in a next part only where a part ends: there are fewer of these rows than parts
    later = F.broadcast(parts.filter("before > 0").select("conv", "part", "before"))
    ident = F.struct("conv", "part", "i")
    kind = kinds_of(placed.select(ident.alias("id"), "mark", "role", "text"))
    turns = placed.select("conv", "part", "i", "mark", "chars").join(kind.select("id.*", "kind"), ["conv", "part", "i"], "left").join(later, ["conv", "part"], "left")
    turns = turns.select("conv", (F.col("i") + F.coalesce("before", F.lit(0)) + 1).alias("pos"), "mark", F.coalesce("kind", F.lit(0)).alias("kind"), "chars")
    return checkpoint(turns), parts.groupBy("conv").agg(F.sum("m").alias("n"))


def rebuilt(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations (conv, d, mark, kind, chars, turns), and conv and turns of all of these."""
    convs = convs.select("conv", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % (LENT + 1)).alias("h"))
    convs = convs.join(convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = convs.withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("turns", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = checkpoint(convs.drop("base_n"))
    heads = turns.filter((F.col("conv") % FAMILY == 0) & (F.col("pos") <= LENT)).withColumnRenamed("conv", "base")
    cols = ["conv", "d", "mark", "kind", "chars", "turns"]
    lent = convs.filter("lent > 0").join(heads, "base").filter("pos <= lent").withColumn("d", F.col("pos"))
    own = attach_groups(turns, convs.select("conv", "n", "h", "lent", "turns"), "conv", "n", "inner").filter("pos > h").withColumn("d", F.col("lent") + F.col("pos") - F.col("h"))
    return lent.select(cols).unionByName(own.select(cols)), convs.select("conv", "turns")


def prefixes(turns: DataFrame, convs: DataFrame, bits: int) -> DataFrame:
    """A row for each prefix of each conversation: conv, d, mark, kind, chars, turns, key and prev."""
    by = ["conv", "chunk"]
    rows = turns.withColumn("chunk", F.floor((F.col("d") - 1) / PART)).repartition(*by).sortWithinPartitions(*by, "d")
    rows = checkpoint(rows.mapInArrow(lean(scanned), "conv long, d long, mark long, kind int, chars long, turns long, chunk long, term long, total long"))
    if rows.filter("chunk > 0").isEmpty():
        rows = rows.withColumn("carry", F.lit(0).cast("long"))
    else:
        sums = rows.filter(F.col("turns") > PART).groupBy(by).agg(F.max_by("total", "d").alias("total"))
        carry = sums.repartition("conv").sortWithinPartitions(*by).mapInArrow(lean(carried), "conv long, chunk long, carry long")
        rows = rows.join(carry, by, "left").withColumn("carry", F.coalesce("carry", F.lit(0)))
    rows = rows.mapInArrow(lean(keyed(bits)), "conv long, d long, mark long, kind int, chars long, turns long, key long, prev long")
    zero = np.zeros(1, dtype=U)
    root = fingerprint(zero, zero, bits)[0].as_py()
    none = [F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("mark"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chars"), "turns", F.lit(root).cast("long").alias("key"), F.lit(None).cast("long").alias("prev")]
    return checkpoint(rows.unionByName(convs.select("conv", *none)))


#: What a prefix must share with the representative of its fingerprint.
SHARED = ("d", "mark", "kind", "prev")


def verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows, and nodes key, conv (the least), n, d, prev, chars; groups of unequal prefixes are split in both."""
    while True:
        ends = [f(c).alias(f"{name}_{c}") for c in SHARED for name, f in (("min", F.min), ("max", F.max))]
        nodes = checkpoint(rows.groupBy("key").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.max("chars").alias("chars"), *ends))
        unlike = reduce(lambda a, b: a | b, [~F.col(f"min_{c}").eqNullSafe(F.col(f"max_{c}")) for c in SHARED])
        bad = checkpoint(nodes.filter(unlike).select("key", "n", F.lit(True).alias("bad")))
        if bad.isEmpty():
            return rows, nodes.select("key", "conv", "n", F.col("min_d").alias("d"), F.col("min_prev").alias("prev"), "chars")
        split = F.when(F.col("bad"), F.xxhash64("key", *SHARED)).otherwise(F.col("key"))
        rows = checkpoint(attach_groups(rows, bad, "key", "n").withColumn("key", split).drop("bad", "n", "prev"))
        rows = checkpoint(rows.join(rows.select("conv", (F.col("d") + 1).alias("d"), F.col("key").alias("prev")), ["conv", "d"], "left"))


def subtrees(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, saved_tokens and n_leaves of all nodes; nodes: conv, d, n, chars, n_children."""
    own = nodes.select("conv", "d", ((F.col("n") - 1) * F.col("chars")).alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"))
    rows = rows.select("conv", "d", "key").join(own, ["conv", "d"], "left").withColumn("chunk", F.floor(F.col("d") / PART))
    local = Window.partitionBy("conv", "chunk").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {c: F.coalesce(F.sum(c).over(local), F.lit(0)).alias(c) for c in ("saved", "leaf")}
    rows = rows.select("conv", "chunk", "d", "key", *sums.values())
    if not nodes.filter(F.col("d") >= PART).isEmpty():
        whole = rows.groupBy("conv", "chunk").agg(*[F.min_by(c, "d").alias(c) for c in sums])
        later = Window.partitionBy("conv").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
        more = whole.select("conv", "chunk", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"more_{c}") for c in sums])
        rows = rows.join(more, ["conv", "chunk"]).select("key", *[(F.col(c) + F.col(f"more_{c}")).alias(c) for c in sums])
    return rows.groupBy("key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows key, conv sorted by both become key, first and text: the ids of a key in a batch, joined by commas."""
    for batch in batches:
        if len(batch):
            key, conv = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own = starts(key)
            at = [x for a, b in zip(own, np.r_[own[1:], len(key)], strict=True) for x in range(a, b, PIECE)]
            text = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(at, [*at[1:], len(key)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(conv[at]), pa.array(text)], names=["key", "first", "text"])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows key, first and text sorted by key and first become key and the SHA-256 of its texts, joined by commas."""
    at, sha = None, None
    for batch in batches:
        keys, out = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != at:
                if sha is not None:
                    keys.append(at)
                    out.append(sha.hexdigest())
                at, sha = key, hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.string())], names=["key", "ends_sha256"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([sha.hexdigest()])], names=["key", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """key and ends_sha256 of nodes at which conversations end. A hash has its order, so one task reads all ids of a
    node; they come to it as pieces of text, which other tasks have joined, and it keeps none of them."""
    last = rows.filter(F.col("d") == F.col("turns")).select("key", "conv")
    texts = last.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(lean(pieces), "key long, first long, text string")
    return texts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(lean(digests), "key long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bits: int = 64) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations: conv_id (its least conversation), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Turns are ordered by turn, null first; turns at one number, and repeated rows, by role and text. Null roles and texts
    are empty, rows with a null key have no conversation. A conversation starts with the first turns of the first of its
    family, as many as its own checksum says, and goes on with its own; where that leaves none it belongs to the root only.
    Texts are compared whole, whatever their length. No rows in, no rows out, not even a root. Other columns are neither
    read nor returned. bits: of a fingerprint; fewer make more groups that are split, and the same rows.
    """
    bound_batches(conversations.sparkSession)
    rows = conversations.select(F.col(key).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.col("conv").isNotNull())
    rows, nodes = verified(prefixes(*rebuilt(*numbered_turns(rows, bits)), bits))
    children = nodes.filter(F.col("prev").isNotNull()).groupBy(F.col("prev").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = checkpoint(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    nodes = nodes.join(subtrees(rows, nodes), "key").join(ends(rows), "key", "left")
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("prev"), F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("size"))
    out = attach_groups(checkpoint(nodes), checkpoint(parents), "prev", "size")
    return out.select(F.col("conv").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


SQL = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, c - c % 100 AS base, count(*) AS n,
  xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 6 AS h FROM t GROUP BY c),
r AS (SELECT k.c, t.pos AS d, t.role, t.text FROM k JOIN t ON t.c = k.base AND t.pos <= k.h
  UNION ALL SELECT k.c, least(k.h, coalesce(b.n, 0)) + t.pos - k.h, t.role, t.text FROM k JOIN t ON t.c = k.c AND t.pos > k.h LEFT JOIN k b ON b.c = k.base),
p AS (SELECT c, d, sha256(string_agg(concat(length(role), ':', role, length(text), ':', text), '') OVER (PARTITION BY c ORDER BY d)) AS key, length(text) AS chars FROM r
  UNION ALL SELECT c, 0, '', 0 FROM k),
q AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS prev, d = max(d) OVER (PARTITION BY c) AS is_end FROM p),
n AS (SELECT key, min(c) AS conv_id, max(d) AS depth, max(prev) AS prev, count(*) AS n_convs, max(chars) AS chars,
  string_agg(CASE WHEN is_end THEN c::VARCHAR END, ',' ORDER BY c) AS ends FROM q GROUP BY key),
m AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.prev = n.key) AS n_children FROM n),
u AS (SELECT DISTINCT a.key AS top, b.key FROM q a JOIN q b ON a.c = b.c AND b.d >= a.d),
s AS (SELECT u.top, sum((m.n_convs - 1) * m.chars)::BIGINT AS saved_tokens, count(*) FILTER (WHERE m.n_children = 0) AS n_leaves FROM u JOIN m ON m.key = u.key GROUP BY u.top)
SELECT m.conv_id, m.depth::BIGINT AS depth, x.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN s ON s.top = m.key LEFT JOIN m x ON x.key = m.prev
"""
