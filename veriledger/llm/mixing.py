"""Mixing sources to target weights.

Words are counted per source, targets are filled up to a cap, and each document is emitted
floor(rate) times plus one Bernoulli copy whose draw is a hash of seed and doc_id, so reruns and
retried tasks agree. A source is one row of the plan; documents never move for the aggregate
(partial sums) nor, while the plan is counted to be small, for the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriledger.llm.common import WORD, as_text, bounded_broadcast, quoted, store, unit_hash

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def word_count(text) -> F.Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_plan(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, size) rows to one row per source: source_size, weight, target, rate.

    Sources in code point order, null last, take the weights in turn and share the total size.
    Nobody gets more than cap times its size; what is over goes to the others by weight. That is
    water filling: with sources by cap/weight, a source is capped as long as it lies under the
    level that the rest would share. An empty source gets 0. The windows see one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    fill = Window.partitionBy(F.lit(0)).orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    agg = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = agg.withColumn("place", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
    limits = ranked.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most").cast("double") / F.col("weight").cast("double"))
    level = limits.withColumn("room", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(fill), F.lit(0))).withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0)))
    level = level.withColumn("level", F.col("room").cast("double") / F.col("rest").cast("double")).withColumn("capped", F.col("ratio") <= F.col("level"))
    level = level.withColumn("shared", F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.struct("ratio", "place"))).over(everything))
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("weight").cast("double") * F.col("shared"))
    rate = F.when(F.col("source_size") == 0, 0.0).when(F.col("capped"), float(cap)).otherwise(F.col("target") / F.col("source_size").cast("double"))
    return level.withColumn("target", target).select("source", "source_size", "weight", "target", rate.alias("rate"))


def draw_key(doc_id, text) -> F.Column:
    """What a row draws by: its id and its text, so that rows without an id, or of one id, don't all
    draw alike; only repeated rows do."""
    return F.concat(as_text(doc_id), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))


def copies(rate, key, seed: str = SEED) -> F.Column:
    """floor(rate), and one more if the hashed draw is under the fraction."""
    whole = F.floor(rate)
    return (whole + (unit_hash(key, seed) < rate - whole).cast("long")).cast("long")


def mix_counts(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for every row of docs.

    Null text counts no words, null source is a source of its own; rows draw by doc_id and text, so
    repeated rows draw alike and are all counted. Extra columns are ignored. Empty in, empty out.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw_key(F.col("doc_id"), F.col("text")).alias("__draw"))
    plan = bounded_broadcast(store(source_plan(docs.select("source", word_count(F.col("text")).alias("size")), weights, cap), "mix-plan")).withColumnRenamed("source", "__source")
    out = sized.join(plan, sized["source"].eqNullSafe(plan["__source"])).drop("__source")
    return out.withColumn("copies", copies(F.col("rate"), F.col("__draw"), seed)).withColumn("taken", F.col("copies") * F.col("size")).drop("__draw")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """docs with each row repeated as the mix takes it; columns, extra ones included, stay. Nulls,
    empty texts and repeated rows count as in mix_counts; an empty table stays empty."""
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    plan = bounded_broadcast(store(source_plan(sized, weights, cap), "mix-plan"))
    plan = plan.select(F.col("source").alias("__mix_source"), F.col("rate").alias("__mix_rate"))
    out = docs.join(plan, docs["source"].eqNullSafe(plan["__mix_source"]))
    out = out.withColumn("__mix_copies", copies(F.col("__mix_rate"), draw_key(F.col("doc_id"), F.col("text")), seed)).where("__mix_copies > 0")
    return out.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))).select(*quoted(docs.columns))
