"""Ratcliff-Obershelp similarity, the one function that needs Python: Arrow batches of pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else 1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def text_similarity(a: Column, b: Column) -> Column:
    """Ratio of a against b as they are; it isn't symmetric. Null in, null out."""
    return F.when(a == b, 1.0).otherwise(_ratio(a, b))


def similar_pairs(pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """pairs with column `out`: each distinct pair of texts is compared once."""
    scored = pairs.select(a, b).distinct().withColumn(out, text_similarity(F.col(a), F.col(b)))
    left = pairs.alias("p")
    return left.join(scored.alias("s"), F.col(f"p.{a}").eqNullSafe(F.col(f"s.{a}")) & F.col(f"p.{b}").eqNullSafe(F.col(f"s.{b}")), "left").select("p.*", out)
