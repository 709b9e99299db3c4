"""Validation of ground truth, and the report on a data set's quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledger.operators.rules import NUMBER, TOLERANCE, item_sum

CURRENCIES, LANGUAGES = ("TRY", "USD", "EUR"), ("tr", "en", "mixed")


def _name(names: dict[str, str]) -> Column:
    return F.when(F.col("doc_type") == "po", names["po"]).when(F.col("doc_type") == "receipt", names["receipt"]).otherwise(names["invoice"])


def missing_fields() -> list[Column]:
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    return [F.when(blank("number"), F.concat(F.lit("missing:"), _name(NUMBER)))] + [F.when(blank(c), F.lit(f"missing:{n}")) for c, n in (("date_text", "date"), ("party", "party"), ("currency", "currency"), ("language", "language"))] + [F.when(F.col("amount_k").isNull(), F.lit("missing:total_amount"))]


def format_errors() -> list[Column]:
    iso = F.col("date_text").rlike(r"^\d{4}-\d{2}-\d{2}$")
    return [
        F.when(~iso, F.lit("date:format")).when(F.try_to_date("date_text", "yyyy-MM-dd").isNull(), F.lit("date:value")),
        F.when((F.col("doc_type") == "invoice") & (F.col("tax_id") != "") & ~F.col("tax_id").rlike(r"^\d{10}$"), F.lit("tax_id:format")),
        F.when(~F.col("currency").isin(*CURRENCIES), F.lit("currency:unknown")),
        F.when(~F.col("language").isin(*LANGUAGES), F.lit("language:unknown")),
        F.when(F.col("amount_k") <= 0, F.lit("total_amount:positive")),
    ]


def item_errors() -> Column:
    """array<string> over the lines: a field without value, a quantity or price that isn't over 0,
    a total that isn't their product."""

    def of(i: Column) -> Column:
        at = lambda text: F.concat(F.lit("item "), i["pos"].cast("string"), F.lit(":" + text))
        return F.array(*[F.when(i[c].isNull(), at("missing " + c)) for c in ("sku", "qty", "price_k", "total_k")], F.when(i["qty"] <= 0, at("quantity")), F.when(i["price_k"] <= 0, at("unit_price")), F.when(F.abs(i["qty"] * i["price_k"] - i["total_k"]) > TOLERANCE, at("total")))

    return F.when(F.size("items") == 0, F.array(F.lit("items:empty"))).otherwise(F.filter(F.flatten(F.transform("items", of)), lambda x: x.isNotNull()))


def math_errors() -> list[Column]:
    order = F.col("doc_type") == "po"
    return [
        F.when(~order & (F.abs(F.col("sub_k") + F.col("tax_k") - F.col("amount_k")) > TOLERANCE), F.lit("math:total")),
        F.when(~order & (F.size("items") > 0) & (F.abs(item_sum() - F.col("sub_k")) > TOLERANCE), F.lit("math:subtotal")),
        F.when(order & (F.size("items") > 0) & (F.abs(item_sum() - F.col("amount_k")) > TOLERANCE), F.lit("math:po_total")),
    ]


def validate(documents: DataFrame) -> DataFrame:
    """documents (with `language`) with errors and ok. Missing fields end a document's checks."""
    some = lambda cs: F.filter(F.array(*cs), lambda x: x.isNotNull())
    first = some(missing_fields())
    rest = F.concat(some(format_errors()), item_errors(), some(math_errors()))
    out = documents.withColumn("missing", first).withColumn("errors", F.when(F.size("missing") > 0, F.col("missing")).otherwise(rest)).drop("missing")
    return out.withColumn("ok", F.size("errors") == 0)


def totals(validated: DataFrame, *by: str) -> DataFrame:
    return validated.groupBy(*by).agg(F.count("*").alias("total_docs"), F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"))


def quality_report(validated: DataFrame) -> DataFrame:
    """One row per language: count, per mille of all (1 place of a per cent), status of the set."""
    by = validated.groupBy("language").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad"))
    whole = by.agg(F.sum("n").alias("all"), F.sum("bad").alias("all_bad"))
    out = by.crossJoin(F.broadcast(whole))  # one row
    return out.select("language", "n", F.floor((F.col("n") * 2000 + F.col("all")) / (2 * F.col("all"))).alias("per_mille"), F.when(F.col("all_bad") == 0, "READY FOR TRAINING").otherwise("NEEDS REVIEW").alias("status"))
