"""Agreement between several passes over the same document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriledger.functions.text import normalise_text


def median_vote(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value: the upper median."""
    return values.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("v")).select(*keys, F.element_at("v", (F.size("v") / 2).cast("int") + 1).alias(value))


def majority_vote(values: DataFrame, keys: list[str], value: str, order: str, normal: bool = True) -> DataFrame:
    """keys, value: the most frequent text (under its normal form, if asked), first seen among
    equals, in the first spelling it had. Two partial aggregates, no window."""
    form = normalise_text(F.col(value)) if normal else F.col(value)
    counted = values.where(F.col(value).isNotNull()).withColumn("form", form).groupBy(*keys, "form").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min_by(value, order).alias("spelled"))
    return counted.groupBy(*keys).agg(F.min_by("spelled", F.struct(-F.col("n"), "first")).alias(value))


def vote_items(passes: DataFrame) -> DataFrame:
    """doc_id, pos, qty, price_k, description over the passes (doc_id, pos, pass, ...); positions
    that only some passes have are voted on by those."""
    keys = ["doc_id", "pos"]
    out = median_vote(passes, keys, "qty").join(median_vote(passes, keys, "price_k"), keys)
    return out.join(majority_vote(passes, keys, "description", "pass", False), keys)
