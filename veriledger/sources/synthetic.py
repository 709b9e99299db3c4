"""Synthetic documents from row numbers: deterministic, in any order, of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generate(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n documents as the rules take them: three types in turn, languages 30 / 35 / 35 %, one to
    eight lines whose products, sums and tax agree, tax numbers with a right check digit."""
    h = lambda *xs: F.pmod(F.xxhash64(F.lit(seed), *xs), F.lit(1_000_000))
    rows = spark.range(n).withColumn("doc_type", F.element_at(F.array(F.lit("invoice"), F.lit("po"), F.lit("receipt")), (F.col("id") % 3 + 1).cast("int")))
    draw = h("id", F.lit("lang")) / 10_000
    rows = rows.withColumn("language", F.when(draw < 30, "tr").when(draw < 65, "en").otherwise("mixed"))
    rows = rows.withColumn("items", F.transform(F.sequence(F.lit(0), (h("id", F.lit("n")) % 8).cast("int")), lambda i: F.struct(i.cast("long").alias("pos"), F.concat(F.lit("SKU-"), h(F.col("id"), i).cast("string")).alias("sku"), (h(F.col("id"), i, F.lit("q")) % 20 + 1).alias("qty"), (h(F.col("id"), i, F.lit("p")) + 100).alias("price_k"), F.lit(0).cast("long").alias("disc_k"))))
    rows = rows.withColumn("items", F.transform("items", lambda x: x.withField("total_k", x["qty"] * x["price_k"])))
    sub = F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x["total_k"])
    order = F.col("doc_type") == "po"
    rows = rows.withColumn("sub_k", sub).withColumn("tax_k", F.when(order, 0).otherwise(F.floor((F.col("sub_k") * 18 + 50) / 100)))
    body = F.lpad((h("id", F.lit("tax")) * 997 + 1).cast("string"), 9, "0")
    check = sum(_vkn_part(body, i) for i in range(9))
    return rows.select(
        F.col("id").alias("doc_id"), "doc_type", "language", F.format_string("GEN%09d", "id").alias("number"), F.date_add(F.lit("2026-01-01").cast("date"), (h("id", F.lit("d")) % 200).cast("int")).cast("string").alias("date_text"),
        F.concat(F.lit("Company "), (h("id", F.lit("c")) % 50).cast("string")).alias("party"), F.concat(body, ((10 - check % 10) % 10).cast("string")).alias("tax_id"), F.lit("TRY").alias("currency"), "sub_k", "tax_k", (F.col("sub_k") + F.col("tax_k")).alias("amount_k"), "items",
    )


def _vkn_part(body: F.Column, i: int) -> F.Column:
    moved = (F.substring(body, i + 1, 1).cast("int") + (9 - i)) % 10
    rest = moved * 2 ** (9 - i) % 9
    return F.when(moved == 0, 0).when(rest == 0, 9).otherwise(rest)
