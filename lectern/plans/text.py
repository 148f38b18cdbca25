"""Queries of text and similarity over whole tables and whole texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import article_index as A
from ..operators import grams as G
from ..operators import overview as O
from ..operators import similarity as S
from .tables import table

#: Terms that occur in the test documents.
TERMS = ["the", "and", "that", "with", "der", "und", "die", "que", "les", "con", "para"]
MARKERS = ["token = ", "licensed", "@mail", "worthless"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with the turn before: what is said (content) and what it is said about (source)."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    b = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", T.normal(F.col("text")).alias("content"), T.normal(F.col("source")).alias("source"), "text")


def simple(**columns):
    """A query of columns over documents, each a function of the text."""
    return lambda spark, sf_dir: documents(spark, sf_dir).select("doc_id", *[c(F.col("text")).alias(n) for n, c in columns.items()])


def char_ngram_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.measures(documents(spark, sf_dir), "doc_id", "text")


def gram_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gram_frequencies(documents(spark, sf_dir), "text")


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    if (words := G.vocabulary(d, "text")) is not None:
        out = G.norms(d, "doc_id", "text", words)
    else:
        out = S.tfidf(S.term_counts(d, "doc_id", "text"), d.count()).groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.max("w").alias("most"))
    return out.select("doc_id", F.round("norm", 4).alias("norm"), F.round("most", 4).alias("most"))


def scores(spark: SparkSession, sf_dir: str, least: float = 0.0, top: int | None = None) -> DataFrame:
    """Every twentieth document against all."""
    return S.article_cosines(documents(spark, sf_dir), "doc_id", "text", F.col("doc_id") % 20 == 0, least, top).withColumn("score", F.round("text_score", 6))


def similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(spark, sf_dir, S.THRESHOLD, S.TOP)
    return S.ranked(found, "query", "doc_id", "score").filter("selected").select("query", "doc_id", F.round("score", 4).alias("score"), "rank")


def tfidf_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("query", "doc_id", F.round("text_score", 4).alias("score"))


def retrieval_audit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted where pairs are scored, before anything is shuffled; the best of a query are selected first, so that no rank
    is needed to count them."""
    d, asked = documents(spark, sf_dir), F.col("doc_id") % 20 == 0
    counts = G.tallies(d, "doc_id", "text", asked, S.THRESHOLD)
    if counts is None:
        counts = A.tallies(A.build(d, "doc_id", "text"), d.filter(asked), "text", S.THRESHOLD, own=False)
    return counts.withColumn("selected", F.least("over", F.lit(S.TOP).cast("long")))


def new_article_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth document, changed (with the text of the next one behind its own), against an index of documents.

    Six of seven documents are indexed: some of the changed ones have an old row there, others are new.
    """
    d = documents(spark, sf_dir)
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    changed = d.filter(F.col("doc_id") % 20 == 0).join(after, "doc_id", "left").select("doc_id", F.concat("text", F.lit(" "), F.coalesce("next", F.lit(""))).alias("text"))
    found = A.cosines(A.build(d.filter(F.col("doc_id") % 7 != 3), "doc_id", "text"), changed, "text", S.THRESHOLD, S.TOP)
    return S.ranked(found.withColumn("score", F.round("text_score", 6)), "query", "doc_id", "score").filter("selected").select("query", "doc_id", F.round("score", 4).alias("score"), "rank")


def meaningful(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    """Texts of at least so many characters of content; exploded, so that the filter does not count them once more."""
    n = T.meaningful_chars(F.col("text")).cast("long")
    return documents(spark, sf_dir).select("doc_id", F.explode(F.array(n)).alias("n")).filter(F.col("n") >= least)


def words_of(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-zà-ÿ]+"), lambda x: F.length(x) >= 4))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    b = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("other"))
    return c.join(b, ["conv_id", "turn"])


def jaccard_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(S.jaccard(words_of(F.col("text")), words_of(F.col("other"))), 6).alias("jaccard"))


def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = S.jaccard(words_of(F.col("text")), words_of(F.col("other")))
    length = F.least(F.length("text"), F.length("other")) / F.greatest(F.length("text"), F.length("other"), F.lit(1))
    parts = {"text": length, "title": j, "topics": j, "entities": length, "parameters": j, "methods": length, "scenarios": j}
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(S.final_score(parts), 4).alias("final"))


def title_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(S.title_ratio(T.normal(F.col("text")), T.normal(F.col("other"))), 6).alias("ratio"))


def bigram_grounding_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(T.grounding(F.col("content"), F.col("source")), 6).alias("ratio"))


def ungrounded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).select("conv_id", "turn", "source", F.explode(F.array_distinct(F.transform(F.split("text", r"[ \n]+"), T.normal))).alias("term"))
    return t.filter((F.length("term") >= 8) & ~F.contains("source", F.col("term"))).groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.min("term").alias("first_term"))


def overview_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = turns(spark, sf_dir).withColumn("raw", T.clean_content(F.col("text")))
    errors, warnings = O.retrieval_messages(F.col("raw"), F.col("source"), none, none, F.length("source"), MARKERS, least=100, most=1500)
    return rows.select("conv_id", "turn", errors.alias("e"), warnings.alias("w")).select("conv_id", "turn", F.array_join("e", ",").alias("errors"), F.array_join("w", ",").alias("warnings"), (F.size("e") == 0).alias("valid"))


#: Rows of candidates up to which they are broadcast to be looked for in every text.
FEW = 10_000


#: Bytes of candidates up to which one automaton of all of them is made in each task.
SMALL = 64 << 20


def found_at_once(d: DataFrame, b: DataFrame) -> DataFrame:
    """doc_id and the candidates c of b that are part of s, and not of source if d has one; one pass over each text finds all."""
    import ahocorasick

    shared = d.sparkSession.sparkContext.broadcast([r["c"] for r in b.select("c").distinct().collect()])

    def work(batches):
        automaton = ahocorasick.Automaton()
        for i, c in enumerate(shared.value):
            automaton.add_word(c, i)
        names = pa.array(shared.value, pa.string())
        if shared.value:
            automaton.make_automaton()
        for batch in batches:
            at, of = [], []
            for i, s in enumerate(batch.column(1).to_pylist() if shared.value else []):
                hits = {x for _, x in automaton.iter(s)} if s else set()
                if hits and batch.num_columns > 2 and (source := batch.column(2)[i].as_py()):
                    hits = {x for x in hits if shared.value[x] not in source}
                at += [i] * len(hits)
                of += hits
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), names.take(pa.array(of, pa.int64()))], names=["doc_id", "c"])

    return d.select("doc_id", "s", *(["source"] if "source" in d.columns else [])).mapInArrow(work, f"doc_id {dict(d.dtypes)['doc_id']}, c string")


def contaminated(d: DataFrame, b: DataFrame, few: int = FEW) -> DataFrame:
    """Candidates of b whose normal form c, if any, is part of a document's normal form s, and not of its source's if d has one.

    While candidates are few and small, by an automaton of all of them in each task; else they meet texts by their first
    24 characters, or all of a shorter one.
    """
    b = b.filter("c != ''")
    clean = ~F.contains(F.coalesce("source", F.lit("")), F.col("c")) if "source" in d.columns else F.lit(True)
    n, size = b.select(F.length("c").alias("size")).limit(few + 1).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n <= few and size <= SMALL:
        return found_at_once(d, b).join(F.broadcast(b), "c").select("doc_id", "item_id")
    b = b.withColumn("head", F.substring("c", 1, 24))
    sizes = tuple(sorted(r[0] for r in b.select(F.length("head")).distinct().collect()))
    at = d.select("*", F.explode(F.array_distinct(T.let(F.col("s"), lambda x: S.grams(x, sizes)))).alias("head"))
    return at.join(b, "head").filter(F.contains("s", F.col("c")) & clean).select("doc_id", "item_id")


def contamination_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items within documents, which have no source text here."""
    d = documents(spark, sf_dir).select("doc_id", T.normal(F.col("text")).alias("s"))
    return contaminated(d, table(spark, sf_dir, "benchmark").select("item_id", T.normal(F.col("text")).alias("c")))


QUERIES = {
    "char_ngram_tf": char_ngram_tf,
    "gram_document_frequency": gram_document_frequency,
    "tfidf_weights": tfidf_weights,
    "tfidf_cosine_pairs": tfidf_cosine_pairs,
    "similarity_topk": similarity_topk,
    "retrieval_audit_flags": retrieval_audit_flags,
    "new_article_topk": new_article_topk,
    "jaccard_sets": jaccard_sets,
    "weighted_score": weighted_score,
    "title_ratio": title_ratio,
    "content_hash": simple(hash=lambda text: T.content_hash(text)),
    "utf8_byte_length": simple(bytes=lambda text: F.octet_length(text).cast("long"), chars=lambda text: F.length(text).cast("long")),
    "normal_form": simple(length=lambda text: F.length(T.normal(text)).cast("long"), hash=lambda text: F.sha2(T.normal(text), 256)),
    "extract_headings": simple(headings=lambda text: F.array_join(T.line_headings(text), "|")),
    "extract_parameters": simple(parameters=lambda text: F.array_join(T.parameters(text), "|")),
    "technical_entities": simple(entities=lambda text: F.array_join(T.technical_entities(text), "|")),
    "stable_unique_cap": simple(words=lambda text: F.array_join(T.unique(F.split(text, r"[ \n]+"), 40), " ")),
    "clean_body_dedup": simple(body=lambda text: F.sha2(T.clean_body(text), 256)),
    "clean_content": simple(hash=lambda text: F.sha2(T.clean_content(text), 256)),
    "keyword_first_position": simple(keywords=lambda text: F.array_join(T.terms_by_position(text, TERMS), ",")),
    "evenly_sampled_segments": simple(sample=lambda text: F.sha2(F.array_join(T.evenly(F.filter(F.transform(T.lines(text), lambda x: F.trim(x)), lambda x: x != ""), 5), "\n"), 256)),
    "fixed_chunk_1200": lambda s, d: documents(s, d).select("doc_id", F.posexplode(T.cuts(F.col("text"), 1200)).alias("pos", "chunk")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("chunk").alias("hash"), F.length("chunk").cast("long").alias("chars")),
    "reliable_text_filter": lambda s, d: meaningful(s, d, 20),
    "valid_text_filter": lambda s, d: meaningful(s, d, 1),
    "marker_filter": lambda s, d: documents(s, d).filter(T.contains_any(F.col("text"), MARKERS)).select("doc_id"),
    "ordered_distinct_union": simple(parts=lambda text: F.array_join(F.array_distinct(F.concat(T.line_headings(text), F.slice(T.lines(text), 1, 2))), "|")),
    "bigram_grounding_ratio": bigram_grounding_ratio,
    "ungrounded_terms": ungrounded_terms,
    "overview_validation": overview_validation,
    "contamination_theta_join": contamination_theta_join,
    "safe_file_key": lambda s, d: table(s, d, "pages", "page_id", "url").select("page_id", T.file_key(F.col("url")).alias("key")),
    "link_token_extract": lambda s, d: table(s, d, "pages", "page_id", "url").select("page_id", T.first_link(F.concat(F.lit("see "), "url", F.lit(") x"))).alias("link"), T.node_token(F.concat(F.lit("https://h/wiki/n"), F.col("page_id").cast("string"), F.lit("?a"))).alias("token")),
    "a1_column_letters": lambda s, d: table(s, d, "part", "p_partkey").select("p_partkey", T.column_letters(F.col("p_partkey")).alias("letters")),
    "polymorphic_timestamp": lambda s, d: table(s, d, "events", "event_id", "ts").select("event_id", T.moment_text(F.when(F.col("event_id") % 5 == 0, (F.lit(40000) + F.col("event_id") % 900).cast("string")).when(F.col("event_id") % 5 == 1, (F.lit(1_600_000_000) + F.col("event_id")).cast("string")).when(F.col("event_id") % 5 == 2, ((F.lit(1_600_000_000) + F.col("event_id")) * 1000).cast("string")).when(F.col("event_id") % 5 == 3, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("soon"))).alias("at")),
    "json_props": lambda s, d: table(s, d, "events", "event_id", "props").select("event_id", F.from_json("props", "k long")["k"].alias("k")),
    "parse_fenced_json": lambda s, d: table(s, d, "events", "event_id", "props").select("event_id", F.from_json(T.without_fence(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```\n"), "props", F.lit("```"))).otherwise(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("not json"))), "k long")["k"].alias("k")),
}

TF = r"""d AS (SELECT doc_id AS id, regexp_replace(lower(text), '[^0-9a-z\x{4e00}-\x{9fff}]+', '', 'g') AS s FROM documents),
g AS (SELECT id, unnest(list_transform(range(1, length(s) - n + 2), lambda i: substr(s, i, n))) AS gram FROM d, (VALUES (2), (3), (4)) v(n) WHERE length(s) >= n),
tf AS (SELECT id, gram, count(*) AS c FROM g GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram), n AS (SELECT count(*) AS n FROM d),
w AS (SELECT id, gram, c * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM tf JOIN df USING (gram), n)"""
DOTS = f"""{TF}, nrm AS (SELECT id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY id),
dot AS (SELECT a.id AS query, b.id AS doc_id, sum(a.w * b.w) AS dot FROM w a JOIN w b USING (gram) WHERE a.id % 20 = 0 AND a.id <> b.id GROUP BY ALL),
sc AS (SELECT query, doc_id, dot / (x.nrm * y.nrm) AS t, round(dot / (x.nrm * y.nrm), 6) AS score FROM dot JOIN nrm x ON x.id = query JOIN nrm y ON y.id = doc_id),
rk AS (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id))::INT AS rank FROM sc)"""
PAIRS = "p AS (SELECT conv_id, a.turn, a.text, b.text AS other FROM conversations a JOIN conversations b USING (conv_id) WHERE b.turn = a.turn - 1)"
SETS = r"""s AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-zà-ÿ]+'), lambda x: length(x) >= 4)) AS a, list_distinct(list_filter(regexp_split_to_array(lower(other), '[^a-zà-ÿ]+'), lambda x: length(x) >= 4)) AS b FROM p),
j AS (SELECT *, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END AS j FROM s)"""
TURNS = r"""t AS (SELECT conv_id, turn, text, regexp_replace(lower(text), '[^0-9a-z\x{4e00}-\x{9fff}]+', '', 'g') AS content, regexp_replace(lower(other), '[^0-9a-z\x{4e00}-\x{9fff}]+', '', 'g') AS source FROM p),
b AS (SELECT conv_id, turn, source, unnest(list_distinct(list_transform(range(1, length(content)), lambda i: substr(content, i, 2)))) AS g FROM t WHERE length(content) >= 2),
gr AS (SELECT conv_id, turn, sum(contains(source, g)::INT) / count(*) AS ratio FROM b GROUP BY ALL)"""
UNIQUE = """, k AS (SELECT doc_id, pos, x, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY pos) AS rn FROM e WHERE x <> ''),
u AS (SELECT doc_id, pos, x, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM k WHERE rn = 1)"""
LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"
HEADINGS = rf"""{LINES}, e AS (SELECT doc_id, pos, trim(regexp_replace(line, '\s+', ' ', 'g')) AS x FROM l WHERE length(trim(regexp_replace(line, '\s+', ' ', 'g'))) BETWEEN 2 AND 30
  AND NOT regexp_matches(trim(regexp_replace(line, '\s+', ' ', 'g')), '[。！？；.!?;]$')){UNIQUE},
h AS (SELECT doc_id, list(x ORDER BY pos) AS h FROM u WHERE place <= 20 GROUP BY doc_id)"""
MEANING = r"length(regexp_replace(regexp_replace(text, '\[图片说明：.*?\]|!\[[^\]]*\]\([^)]*\)', '', 'g'), '[^0-9A-Za-z\x{4e00}-\x{9fff}]', '', 'g'))"
HITS = " OR ".join(f"contains(text, '{m}')" for m in MARKERS)

SQL = {
    "char_ngram_tf": f"WITH {TF} SELECT id AS doc_id, count(*) AS grams, sum(c)::BIGINT AS total, max(c) AS most FROM tf GROUP BY id",
    "gram_document_frequency": f"WITH {TF} SELECT gram, df FROM df",
    "tfidf_weights": f"WITH {TF} SELECT id AS doc_id, round(sqrt(sum(w * w)), 4) AS norm, round(max(w), 4) AS most FROM w GROUP BY id",
    "tfidf_cosine_pairs": f"WITH {DOTS} SELECT query, doc_id, round(t, 4) AS score FROM sc",
    "similarity_topk": f"WITH {DOTS} SELECT query, doc_id, round(score, 4) AS score, rank FROM rk WHERE rank <= 5 AND score >= 0.35",
    "retrieval_audit_flags": f"WITH {DOTS} SELECT query, count(*) AS scored, count(*) FILTER (WHERE score >= 0.35) AS over, count(*) FILTER (WHERE score >= 0.35 AND rank <= 5) AS selected FROM rk GROUP BY query",
    "new_article_topk": rf"""WITH t AS (SELECT doc_id AS id, 0 AS q, text FROM documents WHERE doc_id % 7 <> 3 UNION ALL SELECT d.doc_id, 1, d.text || ' ' || coalesce(n.text, '') FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1 WHERE d.doc_id % 20 = 0),
      s AS (SELECT id, q, regexp_replace(lower(text), '[^0-9a-z\x{{4e00}}-\x{{9fff}}]+', '', 'g') AS s FROM t), g AS (SELECT id, q, unnest(list_transform(range(1, length(s) - n + 2), lambda i: substr(s, i, n))) AS gram FROM s, (VALUES (2), (3), (4)) v(n) WHERE length(s) >= n),
      tf AS (SELECT id, q, gram, count(*) AS c FROM g GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM tf WHERE q = 0 GROUP BY gram),
      qs AS (SELECT a.id AS query, (SELECT count(*) FROM t WHERE q = 0 AND id <> a.id) + 1 AS n FROM t a WHERE a.q = 1),
      c AS (SELECT query, n, tf.id, tf.q, tf.gram, tf.c, coalesce(df.df, 0) - (o.gram IS NOT NULL)::INT + (u.gram IS NOT NULL)::INT AS df FROM qs JOIN tf ON tf.q = 0 AND tf.id <> query OR tf.q = 1 AND tf.id = query
        LEFT JOIN df ON df.gram = tf.gram LEFT JOIN tf o ON o.id = query AND o.q = 0 AND o.gram = tf.gram LEFT JOIN tf u ON u.id = query AND u.q = 1 AND u.gram = tf.gram),
      w AS (SELECT query, id, q, gram, c * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM c), l AS (SELECT query, id, q, sqrt(sum(w * w)) AS l FROM w GROUP BY ALL),
      dot AS (SELECT a.query, b.id AS doc_id, sum(a.w * b.w) AS dot FROM w a JOIN w b ON b.query = a.query AND b.gram = a.gram AND b.q = 0 WHERE a.q = 1 GROUP BY ALL),
      sc AS (SELECT dot.query, doc_id, round(dot / (x.l * y.l), 6) AS score FROM dot JOIN l x ON x.query = dot.query AND x.q = 1 JOIN l y ON y.query = dot.query AND y.q = 0 AND y.id = doc_id),
      rk AS (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id))::INT AS rank FROM sc) SELECT query, doc_id, round(score, 4) AS score, rank FROM rk WHERE rank <= 5 AND score >= 0.35""",
    "jaccard_sets": f"WITH {PAIRS}, {SETS} SELECT conv_id, turn, round(j, 6) AS jaccard FROM j",
    "weighted_score": f"WITH {PAIRS}, {SETS}, x AS (SELECT *, least(length(text), length(other)) / greatest(length(text), length(other), 1) AS l FROM j) SELECT conv_id, turn, round(round(0.60 * l + 0.10 * j + 0.10 * j + 0.05 * l + 0.05 * j + 0.05 * l + 0.05 * j, 6), 4) AS final FROM x",
    "content_hash": r"SELECT doc_id, sha256(lower(regexp_replace(text, '\s+', '', 'g'))) AS hash FROM documents",
    "utf8_byte_length": "SELECT doc_id, strlen(text) AS bytes, length(text) AS chars FROM documents",
    "normal_form": f"WITH {TF} SELECT id AS doc_id, length(s) AS length, sha256(s) AS hash FROM d",
    "extract_headings": f"WITH {HEADINGS} SELECT d.doc_id, coalesce(array_to_string(h, '|'), '') AS headings FROM documents d LEFT JOIN h USING (doc_id)",
    "stable_unique_cap": rf"WITH w AS (SELECT doc_id, regexp_split_to_array(text, '[ \n]+') AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM w){UNIQUE}, r AS (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS words FROM u WHERE place <= 40 GROUP BY doc_id) SELECT d.doc_id, coalesce(words, '') AS words FROM documents d LEFT JOIN r USING (doc_id)",
    "clean_body_dedup": rf"WITH {LINES}, e AS (SELECT doc_id, pos, trim(trim(regexp_replace(regexp_replace(line, '^\s*([-+*>]|\d+[.)]|#{{1,6}})\s*', ''), '\s+', ' ', 'g')), ' |' || chr(9)) AS x FROM l WHERE NOT regexp_matches(line, '^\s*#{{1,6}}\s+')), k AS (SELECT doc_id, pos, x, row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(x, '\s+', '', 'g')) ORDER BY pos) AS rn FROM e WHERE x <> ''), r AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY pos) AS body FROM k WHERE rn = 1 GROUP BY doc_id) SELECT d.doc_id, sha256(coalesce(body, '')) AS body FROM documents d LEFT JOIN r USING (doc_id)",
    "clean_content": rf"WITH {LINES}, e AS (SELECT doc_id, pos, trim(regexp_replace(line, '[ \t]+', ' ', 'g')) AS x FROM l), r AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY pos) AS body FROM e WHERE x <> '' GROUP BY doc_id) SELECT d.doc_id, sha256(coalesce(body, '')) AS hash FROM documents d LEFT JOIN r USING (doc_id)",
    "keyword_first_position": f"WITH t AS (SELECT unnest({TERMS!r}) AS term), f AS (SELECT doc_id, string_agg(term, ',' ORDER BY instr(text, term), term) AS keywords FROM documents, t WHERE contains(text, term) GROUP BY doc_id) SELECT d.doc_id, coalesce(keywords, '') AS keywords FROM documents d LEFT JOIN f USING (doc_id)",
    "evenly_sampled_segments": f"WITH {LINES}, e AS (SELECT doc_id, trim(line) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM l WHERE trim(line) <> ''), s AS (SELECT DISTINCT doc_id, n, round_even(j * (n - 1) / greatest(least(n, 5) - 1, 1), 0)::BIGINT AS i FROM (SELECT DISTINCT doc_id, n FROM e), (SELECT unnest(range(5)) AS j) WHERE j < least(n, 5)), r AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM e JOIN s USING (doc_id, n, i) GROUP BY doc_id) SELECT d.doc_id, sha256(coalesce(t, '')) AS sample FROM documents d LEFT JOIN r USING (doc_id)",
    "fixed_chunk_1200": "WITH c AS (SELECT doc_id, text, unnest(range(0, ((length(text) - 1) // 1200) + 1)) AS pos FROM documents WHERE length(text) > 0) SELECT doc_id, pos, md5(substr(text, pos * 1200 + 1, 1200)) AS hash, length(substr(text, pos * 1200 + 1, 1200)) AS chars FROM c",
    "reliable_text_filter": f"SELECT doc_id, {MEANING} AS n FROM documents WHERE {MEANING} >= 20",
    "valid_text_filter": f"SELECT doc_id, {MEANING} AS n FROM documents WHERE {MEANING} >= 1",
    "marker_filter": f"SELECT doc_id FROM documents WHERE {HITS}",
    "ordered_distinct_union": f"WITH {HEADINGS}, o AS (SELECT doc_id, list_concat(coalesce(h, []), string_split(text, chr(10))[1:2]) AS o FROM documents LEFT JOIN h USING (doc_id)), x AS (SELECT doc_id, unnest(o) AS v, generate_subscripts(o, 1) AS pos FROM o), y AS (SELECT doc_id, v, min(pos) AS pos FROM x GROUP BY ALL) SELECT doc_id, string_agg(v, '|' ORDER BY pos) AS parts FROM y GROUP BY doc_id",
    "bigram_grounding_ratio": f"WITH {PAIRS}, {TURNS} SELECT t.conv_id, t.turn, round(ratio, 6) AS ratio FROM t LEFT JOIN gr USING (conv_id, turn)",
    "ungrounded_terms": rf"WITH {PAIRS}, {TURNS}, x AS (SELECT DISTINCT conv_id, turn, source, regexp_replace(lower(unnest(regexp_split_to_array(text, '[ \n]+'))), '[^0-9a-z\x{{4e00}}-\x{{9fff}}]+', '', 'g') AS term FROM t) SELECT conv_id, turn, count(*) AS n, min(term) AS first_term FROM x WHERE length(term) >= 8 AND NOT contains(source, term) GROUP BY ALL",
    "overview_validation": f"""WITH {PAIRS}, {TURNS}, v AS (SELECT t.*, coalesce(ratio, 0.0) AS r, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '[ \\t]+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS raw FROM t LEFT JOIN gr USING (conv_id, turn)),
      e AS (SELECT conv_id, turn, list_filter([CASE WHEN content = '' THEN 'retrieval_overview_content_empty' END, CASE WHEN length(raw) > 1500 THEN 'retrieval_overview_exceeds_max_chars' END, CASE WHEN {HITS} THEN 'retrieval_overview_contains_review_language' END, CASE WHEN content <> '' AND source <> '' AND r < 0.02 AND NOT (length(content) = 1 AND contains(source, content)) THEN 'retrieval_overview_not_grounded_in_source' END], lambda x: x IS NOT NULL) AS e,
        CASE WHEN length(raw) < 100 AND length(source) >= 300 THEN 'retrieval_overview_short_for_source' ELSE '' END AS warnings FROM v) SELECT conv_id, turn, array_to_string(e, ',') AS errors, warnings, len(e) = 0 AS valid FROM e""",
    "contamination_theta_join": f"WITH {TF}, c AS (SELECT item_id, regexp_replace(lower(text), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g') AS c FROM benchmark) SELECT id AS doc_id, item_id FROM d, c WHERE c <> '' AND contains(s, c)",
    "safe_file_key": r"SELECT page_id, substr(regexp_replace(url, '[^\w-]', '_', 'g'), 1, 120) AS key FROM pages",
    "link_token_extract": r"""SELECT page_id, regexp_replace(regexp_extract(url, 'https?://[^\s"'')]+'), '/+$', '') AS link, 'n' || page_id AS token FROM pages""",
    "a1_column_letters": "SELECT p_partkey, CASE WHEN p_partkey > 702 THEN chr((65 + (((p_partkey - 1) // 26 - 1) // 26 - 1) % 26)::INT) ELSE '' END || CASE WHEN p_partkey > 26 THEN chr((65 + ((p_partkey - 1) // 26 - 1) % 26)::INT) ELSE '' END || chr((65 + (p_partkey - 1) % 26)::INT) AS letters FROM part",
    "polymorphic_timestamp": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(TIMESTAMP '1899-12-30' + to_days((40000 + event_id % 900)::INT), '%Y/%m/%d %H:%M:%S') WHEN 1 THEN strftime(TIMESTAMP '1970-01-01' + to_seconds(1600000000 + event_id), '%Y/%m/%d %H:%M:%S') WHEN 2 THEN strftime(TIMESTAMP '1970-01-01' + to_seconds(1600000000 + event_id), '%Y/%m/%d %H:%M:%S') WHEN 3 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') ELSE 'soon' END AS at FROM events",
    "json_props": "SELECT event_id, (props->>'k')::BIGINT AS k FROM events",
    "parse_fenced_json": "SELECT event_id, CASE WHEN event_id % 3 < 2 OR event_id % 2 = 0 THEN (props->>'k')::BIGINT END AS k FROM events",
}
