"""Filling what is missing, applying corrections to what was flagged, and telling what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledger.functions.text import as_date
from veriledger.operators.rules import _printed, computed, is_correctable, item_sum


def repair_arithmetic(documents: DataFrame) -> DataFrame:
    """Fill missing line totals, a missing subtotal (not on orders, which have none) and a missing
    total over 0. What is printed is never replaced, not even if it isn't a number."""

    def filled(i: Column) -> Column:
        return i.withField("total_k", F.coalesce(i["total_k"], computed(i) - F.coalesce(i["disc_k"], F.lit(0))))

    out = documents.withColumn("items", F.transform("items", filled))
    out = out.withColumn("sub_k", F.when((F.col("doc_type") != "po") & (F.size("items") > 0), F.coalesce("sub_k", F.when(_printed(documents, "sub").isNull(), item_sum()))).otherwise(F.col("sub_k")))
    expected = F.coalesce(F.col("sub_k") + F.col("tax_k"), F.col("sub_k"), item_sum())
    return out.withColumn("amount_k", F.coalesce("amount_k", F.when((expected > 0) & _printed(documents, "amount").isNull(), expected)))


def flatten(documents: DataFrame) -> DataFrame:
    """doc_id, path, value (text) of every header field and every field of every line."""
    head = {"number": "number", "date": "date_text", "party": "party", "tax_id": "tax_id", "currency": "currency", "subtotal": "sub_k", "tax_amount": "tax_k", "total_amount": "amount_k"}
    pair = lambda path, value: F.struct(path.alias("path"), value.cast("string").alias("value"))
    fields = [pair(F.lit(p), F.col(c)) for p, c in head.items()]
    line = lambda i: F.array(*[pair(F.concat(F.lit("items["), i["pos"].cast("string"), F.lit("]." + n)), i[c]) for n, c in (("sku", "sku"), ("quantity", "qty"), ("unit_price", "price_k"), ("discount", "disc_k"), ("total", "total_k"))])
    return documents.select("doc_id", F.explode(F.concat(F.array(*fields), F.flatten(F.transform("items", line)))).alias("f")).select("doc_id", "f.path", "f.value")


def changed_fields(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, path of flattened fields whose value differs, absent and null alike."""
    a, b = before.withColumnRenamed("value", "old"), after.withColumnRenamed("value", "new")
    return a.join(b, ["doc_id", "path"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("doc_id", "path")


def apply_corrections(flat: DataFrame, corrections: DataFrame) -> DataFrame:
    """flat (doc_id, path, value) with corrected values; item paths that don't exist are ignored,
    header paths that don't exist are added."""
    fixed = corrections.select("doc_id", "path", F.col("value").alias("new"), F.lit(True).alias("hit"))
    out = flat.join(fixed, ["doc_id", "path"], "full_outer")
    there = F.col("value").isNotNull() | ~F.col("path").startswith("items[")
    return out.where(there).select("doc_id", "path", F.when(F.col("hit"), F.col("new")).otherwise(F.col("value")).alias("value"))


def merge_allowed(flat: DataFrame, proposed: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, refused): proposals on allowed paths win unless null; the others are refused."""
    keep = proposed.join(allowed.select("doc_id", "path"), ["doc_id", "path"], "left_semi").where("value is not null")
    refused = proposed.join(allowed.select("doc_id", "path"), ["doc_id", "path"], "left_anti").select("doc_id", "path")
    new = keep.select("doc_id", "path", F.col("value").alias("new"))
    merged = flat.join(new, ["doc_id", "path"], "left").select("doc_id", "path", F.coalesce("new", "value").alias("value"))
    return merged, refused


def to_correct(issues: DataFrame) -> DataFrame:
    """The issues worth a second reading: critical and correctable."""
    return issues.where((F.col("severity") == "critical") & is_correctable(F.col("rule")))


def unrequested(changed: DataFrame, flagged: DataFrame) -> DataFrame:
    """doc_id, reason of changes to paths that nobody flagged."""
    rest = changed.join(flagged.select("doc_id", F.col("field").alias("path")), ["doc_id", "path"], "left_anti")
    return rest.select("doc_id", F.concat(F.lit("unrequested_correction: "), F.col("path")).alias("reason"))


def pipeline_verdict(documents: DataFrame, reasons: DataFrame) -> DataFrame:
    """doc_id, verdict, n_reasons: REVIEW with any reason; documents never drop out."""
    n = reasons.groupBy("doc_id").agg(F.count("*").alias("n"))
    return documents.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.when(F.coalesce("n", F.lit(0)) > 0, "REVIEW").otherwise("OK").alias("verdict"), F.coalesce("n", F.lit(0)).alias("n_reasons"))


def issue_text(severity: Column, field: Column, message: Column) -> Column:
    return F.concat(F.lit("- ["), F.upper(severity), F.lit("] Field '"), field, F.lit("': "), message)


def canonical(rows: DataFrame, channel: str = "email_pdf") -> DataFrame:
    """From extracted fields of any document type to one shape; empty text counts as absent."""
    pick = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs if c in rows.columns], F.lit(None).cast("string"))
    out = {"doc_number": pick("invoice_number", "receipt_number", "po_number"), "supplier_name": pick("vendor_name", "supplier_name", "store_name"), "supplier_tax_id": pick("vendor_tax_id", "supplier_tax_id", "store_tax_id")}
    return rows.select("doc_id", *[c.alias(n) for n, c in out.items()], as_date(pick("date")).alias("issue_date"), F.coalesce(pick("currency"), F.lit("TRY")).alias("currency"), F.lit(channel).alias("channel"), pick("source_ref").alias("source_ref"))


def canonical_efatura(rows: DataFrame) -> DataFrame:
    """The same shape from structured e-invoice fields."""
    pick = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs if c in rows.columns], F.lit(None).cast("string"))
    return rows.select("doc_id", pick("doc_number", "invoice_number").alias("doc_number"), F.col("supplier_name"), F.col("supplier_tax_id"), as_date(pick("issue_date", "date")).alias("issue_date"), F.coalesce(pick("currency"), F.lit("TRY")).alias("currency"), F.lit("efatura").alias("channel"), pick("source_ref", "ettn").alias("source_ref"))
