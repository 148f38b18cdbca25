"""Quality rules: failures by host, shrunk by an empirical beta prior, joined back to the documents.

One scan measures each text with built-in functions. What goes on from there is a narrow row a document. Failures are
summed by host before any shuffle. Over all hosts, the rate of failures has a beta distribution whose mean and
concentration are found by moments; a host's rate is the mean of its posterior, so that a host of few documents stays
near the rate of all. The host's verdict then decides how strict the document's own rules are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import attach_groups, checkpoint, let, read, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 50
WORD_CHARS = (2, 12)
#: Up to so many different repeated windows are looked up in a list.
FEW = 24
#: Shrunk rates of failing documents from which a host is watched or blocked.
WATCH_RATE, BLOCK_RATE = 0.10, 0.95


def repeat_words(w: Column) -> Column:
    """Words in windows of three that occur twice or more among the words w.

    A window stands for 64 bits of a hash of its words, and for 96 where so many repeat that all are sorted: two different
    ones of a text agree once in 10 ** 19 pairs. Where all are distinct there is none. Where few repeat, they
    are looked up; else all are sorted with their places and those equal to a neighbour are repeated. The places, in
    order, then tell how many words each adds to the ones before it. The last two places hold fewer words, so that no
    other is equal to them.
    """
    window = lambda x, i: (x, F.get(w, i + 1), F.get(w, i + 2))
    keys = F.transform(w, lambda x, i: F.xxhash64(*window(x, i)))
    windows = F.transform(w, lambda x, i: F.struct(F.xxhash64(*window(x, i)).alias("k"), F.hash(*window(x, i)).alias("h"), i.alias("i")))

    def places(s: Column) -> Column:
        same = lambda x, y: F.coalesce((x["k"] == y["k"]) & (x["h"] == y["h"]), F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")), lambda a: a["n"])

    def looked_up(k: Column, twice: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(k) - 1), lambda i: F.array_contains(twice, F.get(k, i)))

    def counted(k: Column) -> Column:
        twice = let(F.sort_array(k), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))
        many = covered(let(F.sort_array(windows), places))
        return let(twice, lambda t: F.when(F.size(t) == 0, 0).when(F.size(t) <= FEW, covered(looked_up(k, t))).otherwise(many))

    return let(keys, counted)


def measure(docs: DataFrame, text: str, host: str, key: str) -> DataFrame:
    """key, host and the base counts of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(words(F.col(text)), lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeat_words(w).alias("n_repeat_words")))
    dup = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    out = docs.select(F.col(key), F.col(host).alias("host"), counts.alias("c"), dup.alias("d"), F.regexp_count(t, F.lit("[#*$%&|<>]")).alias("n_symbols"))
    long = lambda c: F.col(c).cast("long").alias(c.rpartition(".")[2])
    return out.select(key, "host", long("c.n_words"), long("c.word_chars"), long("n_symbols"), long("d.n_dup_lines"), long("c.n_repeat_words"), long("d.n_lines"))


def judge(rows: DataFrame) -> DataFrame:
    """base_failed and soft_fails, the number of other rules that a document fails, in whole numbers throughout."""
    n, chars = F.col("n_words"), F.col("word_chars")
    soft = [100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * n, 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"), (chars < WORD_CHARS[0] * n) | (chars > WORD_CHARS[1] * n)]
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    return rows.withColumns({"base_failed": base, "soft_fails": sum(x.cast("int") for x in soft)})


def beta_prior(n: int, f: int, f2n: float, hosts: int) -> tuple[float, float]:
    """Alpha and beta by moments, from sums over hosts of n, f and f * f / n.

    The variance between hosts is that of their rates, weighted by n, less what sampling adds to it. Where nothing is
    left of it or every host has the same rate, the prior is as firm as 10,000 documents.
    """
    if not n:
        return 1.0, 1.0
    m = f / n
    spread = m * (1 - m)
    between = f2n / n - m * m - spread * hosts / n
    firm = min(10_000.0, max(1.0, spread / between - 1)) if between > 1e-9 else 10_000.0
    return m * firm, (1 - m) * firm


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """One row a document: key, the base counts, base_failed, soft_fails, host, host_rate, host_state and kept.

    A document that fails a base rule is dropped. On a blocked host all go; on a watched one those that fail any other
    rule; elsewhere those that fail two. A null text has no word and fails. A document with a null host is judged as
    if it were on a host of its own that nothing is known of: at the rate of all documents. A text of any length is one
    row, whose words and windows are arrays of it. Repeated rows stay, each
    is counted; no rows in, no rows out. Other columns of docs are neither read nor returned.
    """
    rows = checkpoint(judge(measure(docs, text, host, key)))
    fails = (F.col("base_failed") | (F.col("soft_fails") > 0)).cast("long")
    hosts = checkpoint(rows.filter("host is not null").groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(fails).alias("host_fails")))
    s = hosts.agg(F.sum("host_docs"), F.sum("host_fails"), F.sum(F.col("host_fails") * F.col("host_fails") / F.col("host_docs")), F.count("*")).first()
    alpha, beta = beta_prior(s[0] or 0, s[1] or 0, s[2] or 0.0, s[3])
    rate = lambda f, n: (f + F.lit(alpha)) / (n + F.lit(alpha + beta))
    hosts = hosts.withColumn("host_rate", rate(F.col("host_fails"), F.col("host_docs")))
    out = attach_groups(rows, hosts, "host", "host_docs").withColumn("host_rate", F.coalesce("host_rate", rate(F.lit(0), F.lit(0))))
    state = F.when(F.col("host_rate") >= BLOCK_RATE, "blocked").when(F.col("host_rate") >= WATCH_RATE, "watched").otherwise("trusted")
    kept = ~F.col("base_failed") & (F.col("host_state") != "blocked") & (F.col("soft_fails") < F.when(F.col("host_state") == "watched", 1).otherwise(2))
    return out.withColumn("host_state", state).withColumn("kept", kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "soft_fails", "host_state", F.round("host_rate", 6).alias("host_rate"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT rid, i, word || ' ' || lead(word) OVER s || ' ' || lead(word, 2) OVER s AS k FROM p WINDOW s AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM g WHERE k IS NOT NULL),
c AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN c USING (rid)),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
        (100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words)::INT + (100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines)::INT
        + (word_chars < {WORD_CHARS[0]} * n_words OR word_chars > {WORD_CHARS[1]} * n_words)::INT AS soft_fails FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum((base_failed OR soft_fails > 0)::INT)::DOUBLE AS f FROM j WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS q, count(*) / sum(n) AS hn FROM h),
b AS (SELECT m, q - m * m - m * (1 - m) * hn AS between_hosts FROM s),
a AS (SELECT m, CASE WHEN between_hosts > 1e-9 THEN least(10000.0, greatest(1.0, m * (1 - m) / between_hosts - 1)) ELSE 10000.0 END AS firm FROM b),
k AS (SELECT j.*, (coalesce(f, 0) + m * firm) / (coalesce(n, 0) + firm) AS rate FROM j LEFT JOIN h USING (source), a),
v AS (SELECT *, CASE WHEN rate >= {BLOCK_RATE} THEN 'blocked' WHEN rate >= {WATCH_RATE} THEN 'watched' ELSE 'trusted' END AS host_state FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND host_state <> 'blocked' AND soft_fails < CASE WHEN host_state = 'watched' THEN 1 ELSE 2 END AS kept,
  soft_fails, host_state, round(rate, 6) AS host_rate FROM v
"""
