"""Mixing sources to target weights: raked token weights, then a sample by calibrated probabilities.

Documents are summed to cells (source, language, topic). Iterative proportional fitting multiplies the weights of the
cells by one factor a source, a language and a topic until each marginal has its target share. Each half step is one
aggregation of the cells, whose factors are joined to them: those of large categories by broadcast, others by shuffle.
No category is folded into another; only totals reach the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import attach_groups, checkpoint, discard, read

DIMS = ("source", "lang", "topic")
#: Exponents that draw the shares of each dimension together: 1 leaves them, 0 makes them equal.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Tokens to sample, of all.
FRACTION = 0.5
BYTES_A_TOKEN = 4
SWEEPS, TOLERANCE = 40, 1e-6
#: Categories of a dimension up to which their factors are joined to the cells by broadcast.
FEW = 10_000
SEED = 17


def default_topic(text: Column) -> Column:
    """A genre by plain marks: tables, records with numbers, or prose by its length."""
    return F.when(F.contains(text, F.lit(" | ")), "table").when(text.rlike("[0-9]"), "records").when(F.length(text) < 400, "note").when(F.length(text) < 2500, "article").otherwise("long")


def category(value: Column) -> Column:
    """Text that tells a null from any value."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def own_value(value: Column) -> Column:
    """What category() was made of, as text."""
    return F.when(value != "null", F.substr(value, F.lit(2)))


def table(spark: SparkSession, dim: str, of: dict[str, float], name: str) -> DataFrame:
    """The targets that a caller gives for a dimension, to be broadcast."""
    rows = json.dumps([{"k": k, "v": v} for k, v in of.items()])
    one = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<k:string,v:double>>")))
    return F.broadcast(one.select(F.col("k").alias(dim), F.col("v").alias(name)))


def aim(cells: DataFrame, targets: dict[str, dict] | None, total: int) -> DataFrame:
    """cells with a weight to begin with, and each dimension's target share as want_source, want_lang and want_topic."""
    cells = cells.withColumn("weight", F.lit(1.0))
    for d in DIMS:
        want = f"want_{d}"
        if targets and d in targets:
            given = {"null" if k is None else f"={k}": v for k, v in targets[d].items()}
            goal = table(cells.sparkSession, d, {k: v / sum(given.values()) for k, v in given.items()}, want)
            cells = cells.join(goal, d, "left").withColumn(want, F.coalesce(want, F.lit(0.0)))
            cells = cells.withColumn("weight", F.when(F.col(want) > 0, F.col("weight")).otherwise(0.0))
        else:
            share = F.sum("tokens") / (total or 1)
            own = checkpoint(cells.groupBy(d).agg(F.when(share > 0, F.pow(share, F.lit(TEMPER[d]))).otherwise(0.0).alias(want), F.count("*").alias("_n")))
            heat = own.agg(F.sum(want)).first()[0]
            cells = attach_groups(cells, own.withColumn(want, F.col(want) / (heat or 1)), d, "_n").drop("_n")
    return checkpoint(cells)


def rake(cells: DataFrame, total: int) -> tuple[DataFrame, float]:
    """cells with new weights, so that the weighted tokens of each category have its target share, and the largest part of
    all tokens by which the last sweep still moved a share.

    It ends when a whole sweep has moved no share by more than TOLERANCE, or after SWEEPS (targets that contradict
    each other have no solution; the last dimension's marginals then hold). A sweep is one job and one table where no
    dimension has more than FEW categories, else one for each dimension.
    """
    worst = 0.0
    few = max(cells.agg(*[F.count_distinct(d) for d in DIMS]).first()) <= FEW
    for _ in range(SWEEPS):
        new = cells.withColumn("_worst", F.lit(0.0))
        for d in DIMS:
            mass = new.groupBy(d).agg(F.sum(F.col("tokens") * F.col("weight")).alias("_m"), F.max(f"want_{d}").alias("_want"), F.count("*").alias("_n"))
            ratio = F.when(F.col("_m") > 0, F.col("_want") * total / F.col("_m")).otherwise(1.0)
            moved = F.when(F.col("_m") > 0, F.abs(F.col("_m") - F.col("_want") * total) / total).otherwise(0.0)
            steps = mass.select(d, "_n", ratio.alias("_ratio"), moved.alias("_moved"))
            both = new.join(F.broadcast(steps), d, "left") if few else attach_groups(new, checkpoint(steps), d, "_n")
            new = both.withColumns({"weight": F.col("weight") * F.col("_ratio"), "_worst": F.greatest("_worst", "_moved")}).drop("_ratio", "_moved", "_n")
            new = new if few else checkpoint(new)
        new = checkpoint(new)
        discard(cells)
        cells, worst = new.drop("_worst"), new.agg(F.max("_worst")).first()[0]
        if worst <= TOLERANCE:
            break
    return cells, worst


def calibrate(cells: DataFrame, want: float) -> float:
    """The number by which weights become probabilities, at most 1, that sample as many tokens as wanted.

    Cells at 1 are set aside and the rest is scaled anew, until no other cell gets there.
    """
    scale, last = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(scale) >= 1
        r = cells.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("weight"))).alias("rest")).first()
        if r["n"] == last or not r["rest"]:
            return scale
        last, new = r["n"], (want - r["full"]) / r["rest"]
        if new <= scale:
            return scale
        scale = new


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, fraction: float = FRACTION, text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, tokens: Column | None = None, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """One row a document: key, source, lang, topic, tokens, weight, probability, kept and gap.

    targets gives shares by dimension and value (None for null; values that it leaves out are dropped, weight 0);
    dimensions that it leaves out, or all, aim at their own shares raised to TEMPER. source, lang and topic are the
    document's own as text, null where it has none. tokens defaults to a quarter of the
    text's bytes, rounded up; a null text has 0, and the weight of its cell like any other. kept follows from a hash of
    the key, the same in every run; repeated rows share their fate. A probability is 1 where the weight asks for more
    copies than there are. gap, one value, is the largest part of all tokens by which a share was off when raking
    ended: above TOLERANCE the targets contradict each other, and no weights have all of them. A text of any length is one row. No rows in, no rows out. Other columns of docs are neither read nor returned.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.ceil(F.octet_length(t) / BYTES_A_TOKEN) if tokens is None else tokens
    rows = docs.select(F.col(key), category(F.col(source)).alias("source"), category(F.col(lang)).alias("lang"), category(default_topic(t) if topic is None else topic).alias("topic"), F.coalesce(n.cast("long"), F.lit(0)).alias("tokens"))
    rows = checkpoint(rows)
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    sums = checkpoint(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    cells, scale, gap = aim(sums, targets, total), 1.0, 0.0
    if total:
        cells, gap = rake(cells, total)
        scale = calibrate(cells, fraction * total)
    groups = cells.select(F.struct(*DIMS).alias("_cell"), "weight", "rows")
    out = attach_groups(rows.withColumn("_cell", F.struct(*DIMS)), groups, "_cell", "rows").drop("rows")
    luck = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11) * F.lit(2.0**-53)
    out = out.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(scale)))
    return out.select(key, *[own_value(F.col(d)).alias(d) for d in DIMS], "tokens", "weight", "probability", (luck < F.col("probability")).alias("kept"), F.lit(float(gap)).alias("gap"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"))
