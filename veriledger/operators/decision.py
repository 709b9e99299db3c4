"""Findings from every source, and the pay, hold or review decision they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledger.operators.rules import issue_message

FINDING = ["doc_id", "kind", "severity", "field", "source", "message", "basis", "expected", "actual", "amount_k", "line", "blocks_payment"]
#: The kind of finding each rule leads to.
RULE_KINDS = {
    "total_mismatch": "TOTAL_MISMATCH", "subtotal_mismatch": "SUBTOTAL_MISMATCH", "item_total_mismatch": "LINE_TOTAL_MISMATCH", "tax_id_checksum_invalid": "TAX_ID_INVALID", "tax_id_label_captured": "TAX_ID_MALFORMED",
    "seller_tax_id_missing": "SELLER_TAX_ID_MISSING", "required_field_missing": "FIELD_MISSING", "negative_amount": "NEGATIVE_AMOUNT", "negative_discount": "NEGATIVE_DISCOUNT", "tax_rate_implausible": "TAX_RATE_IMPLAUSIBLE",
    "date_format_invalid": "DATE_FORMAT", "date_implausible": "DATE_IMPLAUSIBLE", "numeric_invalid": "NOT_NUMERIC", "total_implausible": "TOTAL_IMPLAUSIBLE",
}
PRICED_RULES = ("total_mismatch", "subtotal_mismatch", "item_total_mismatch")
#: The kind of finding a differing field leads to.
FIELD_KINDS = {"quantity": "QTY_MISMATCH", "unit_price": "PRICE_MISMATCH", "total": "LINE_TOTAL_MISMATCH", "description": "DESC_MISMATCH", "total_amount": "TOTAL_MISMATCH", "currency": "CURRENCY_MISMATCH"}
#: Fields nothing can be checked against.
UNVERIFIABLE = ("invoice_number", "po_number", "receipt_number", "date", "due_date", "delivery_date", "vendor_name", "supplier_name", "store_name", "buyer_name", "vendor_address", "supplier_address", "store_address", "buyer_address", "payment_terms", "notes", "currency")
NOT_COUNTED = ("doc_type", "language", "items")


def _named(names: dict[str, str], key: Column, other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key), other)


def _finding(df: DataFrame, **values) -> DataFrame:
    defaults = {"message": F.lit("").cast("string"), "expected": F.lit(None).cast("string"), "actual": F.lit(None).cast("string"), "amount_k": F.lit(None).cast("long"), "line": F.lit(None).cast("long"), "blocks_payment": F.lit(False)}
    cols = defaults | {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
    return df.select("doc_id", *[cols[c].alias(c) for c in FINDING[1:]])


def from_verification(issues: DataFrame) -> DataFrame:
    """One document read on its own: arithmetic is priced, but is nobody's debt."""
    kind = _named(RULE_KINDS, F.col("rule"), F.coalesce(F.nullif(F.upper("rule"), F.lit("")), F.lit("OTHER")))
    price = F.when(F.col("rule").isin(*PRICED_RULES), F.col("actual_k") - F.col("expected_k"))
    return _finding(issues, kind=kind, severity=F.col("severity"), field=F.col("field"), source="document", basis="single_document", message=issue_message(), expected=F.col("expected_k").cast("string"), actual=F.col("actual_k").cast("string"), amount_k=price)


def from_discrepancies(found: DataFrame) -> DataFrame:
    """Lines of an order and its invoice: a price gap counts per unit, a quantity gap per price.
    Invoiced but not ordered: critical, priced, and of the document as a whole; ordered but not
    invoiced: a warning."""
    qty = F.coalesce(F.nullif("inv_qty", F.lit(0)), F.nullif("po_qty", F.lit(0)))
    price = F.coalesce(F.nullif("po_price_k", F.lit(0)), F.nullif("inv_price_k", F.lit(0)))
    gap = F.col("inv_value") - F.col("po_value")
    amount = F.when(F.col("field") == "unit_price", gap * qty).when(F.col("field") == "quantity", gap * price).when(F.col("field").isin("total", "total_amount"), gap)
    kind, field, expected, actual = _named(FIELD_KINDS, F.col("field"), F.lit("OTHER")), F.col("field"), F.col("po_value").cast("string"), F.col("inv_value").cast("string")
    if "inv_sku" in found.columns:
        extra, missing = field == "_extra_invoice_line", field == "_missing_po_line"
        kind = F.when(extra, "NOT_IN_PO").when(missing, "MISSING_ITEM").otherwise(kind)
        amount = F.when(extra, F.col("inv_value")).when(missing, F.lit(None)).otherwise(amount)
        expected, actual = F.when(missing, F.col("po_sku")).when(~extra, expected), F.when(extra, F.col("inv_sku")).when(~missing, actual)
        field = F.when(extra | missing, "items").otherwise(field)
    return _finding(found, kind=kind, severity=F.col("severity"), field=field, source="po_match", basis="cross_source", expected=expected, actual=actual, amount_k=amount.cast("long"), line=F.col("line"))


def from_scalars(checks: DataFrame) -> DataFrame:
    bad = checks.where(F.col("severity").isin("critical", "warning"))
    amount = F.when(F.col("field") == "total_amount", F.col("b_total") - F.col("a_total"))
    return _finding(bad, kind=_named(FIELD_KINDS, F.col("field"), F.lit("OTHER")), severity=F.col("severity"), field=F.col("field"), source="po_match", basis="cross_source", amount_k=amount)


def from_unmatched(lone_inv: DataFrame, lone_po: DataFrame) -> DataFrame:
    """Invoiced but not ordered: critical, priced, and of the document as a whole; ordered but not
    invoiced: a warning."""
    extra = _finding(lone_inv, kind="NOT_IN_PO", severity="critical", field="items", source="po_match", basis="cross_source", actual=F.col("sku"), amount_k=F.col("total_k"))
    return extra.unionByName(_finding(lone_po, kind="MISSING_ITEM", severity="warning", field="items", source="po_match", basis="cross_source", expected=F.col("sku")))


def extraction_failed(documents: DataFrame, extracted: DataFrame) -> DataFrame:
    """A finding for each document that gave no data."""
    return _finding(documents.join(extracted.select("doc_id"), "doc_id", "left_anti"), kind="EXTRACTION_FAILED", severity="critical", field="_document", source="document", basis="single_document")


def with_flags(findings: DataFrame) -> DataFrame:
    """findings with is_priced, is_financial and holds_payment."""
    priced, financial = F.coalesce(F.abs("amount_k") >= 1, F.lit(False)), F.col("basis") == "cross_source"
    return findings.withColumns({"is_priced": priced, "is_financial": financial, "holds_payment": (F.col("severity") == "critical") & financial & (F.col("blocks_payment") | priced)})


def net_impact(findings: DataFrame, basis: str) -> DataFrame:
    """doc_id, impact_k: each line's largest amount, summed; the largest amount of the document as a
    whole only if no line has one. Of equal sizes the positive counts."""
    priced = findings.where((F.col("basis") == basis) & (F.abs("amount_k") >= 1))
    size = F.struct(F.abs("amount_k"), "amount_k")
    lines = priced.groupBy("doc_id", "line").agg(F.max_by("amount_k", size).alias("amount_k"))
    return lines.groupBy("doc_id").agg(F.coalesce(F.sum(F.when(F.col("line").isNotNull(), F.col("amount_k"))), F.max(F.when(F.col("line").isNull(), F.col("amount_k")))).alias("impact_k"))


def decide(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, verdict, financial_k, internal_k, n_findings for every document. Findings are read
    once: first a row for each line of a document, then one for each document."""
    priced = F.coalesce(F.abs("amount_k") >= 1, F.lit(False))
    f = with_flags(findings).withColumn("size", F.when(priced, F.struct(F.abs("amount_k"), "amount_k")))
    lines = f.groupBy("doc_id", "line", "basis").agg(F.bool_or("holds_payment").alias("hold"), F.bool_or(F.col("severity") == "critical").alias("critical"), F.count("*").alias("n"), F.max("size").getField("amount_k").alias("k"))
    of = lambda basis: F.coalesce(F.sum(F.when((F.col("basis") == basis) & F.col("line").isNotNull(), F.col("k"))), F.max(F.when((F.col("basis") == basis) & F.col("line").isNull(), F.col("k"))))
    agg = lines.groupBy("doc_id").agg(F.bool_or("hold").alias("hold"), F.bool_or("critical").alias("critical"), F.sum("n").alias("n_findings"), of("cross_source").alias("financial_k"), of("single_document").alias("internal_k"))
    verdict = F.when(F.col("hold"), "HOLD").when(F.col("critical"), "REVIEW").otherwise("PAY")
    out = documents.select("doc_id").join(agg, "doc_id", "left")
    return out.select("doc_id", verdict.alias("verdict"), F.coalesce("financial_k", F.lit(0)).alias("financial_k"), F.coalesce("internal_k", F.lit(0)).alias("internal_k"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def coverage(fields: DataFrame) -> DataFrame:
    """doc_id, checked, unverifiable, coverage_pm (per mille) and blind, the paths that nothing can be
    checked against, from header fields (path, value)."""
    some = fields.where((F.col("value") != "") & ~F.col("path").startswith("_") & ~F.col("path").isin(*NOT_COUNTED))
    n = some.groupBy("doc_id").agg(F.count_if(~F.col("path").isin(*UNVERIFIABLE)).alias("checked"), F.count_if(F.col("path").isin(*UNVERIFIABLE)).alias("unverifiable"), F.array_sort(F.collect_list(F.when(F.col("path").isin(*UNVERIFIABLE), F.col("path")))).alias("blind"))
    of = F.col("checked") + F.col("unverifiable")
    return n.withColumn("coverage_pm", F.floor((F.col("checked") * 2000 + of) / (2 * of)))


def with_coverage(decisions: DataFrame, covered: DataFrame) -> DataFrame:
    """decisions with checked, coverage_pm and blind; a document without fields has 0 and none."""
    out = decisions.join(covered.select("doc_id", "checked", "coverage_pm", "blind"), "doc_id", "left")
    return out.withColumns({"checked": F.coalesce("checked", F.lit(0)), "coverage_pm": F.coalesce("coverage_pm", F.lit(0)), "blind": F.coalesce("blind", F.array().cast("array<string>"))})


def portfolio(decisions: DataFrame) -> DataFrame:
    """Per verdict: documents, the first and last id, sums of impacts."""
    return decisions.groupBy("verdict").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum("financial_k").alias("financial_k"), F.sum("internal_k").alias("internal_k"))
