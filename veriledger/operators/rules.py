"""Verification rules on documents that carry their lines as an array.

assemble() brings headers and lines together by doc_id, the only shuffle; every rule after that is
a column of the document's row, so a document's issues, report and decision need no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledger.functions.taxid import classify_tax_id

#: Kuruş that printed and computed figures may differ by.
TOLERANCE = 2
MOST_ITEMS, MOST_AMOUNT_K = 50, 1_000_000_000
#: What a field is called, by document type.
NUMBER = {"invoice": "invoice_number", "po": "po_number", "receipt": "receipt_number"}
PARTY = {"invoice": "vendor_name", "po": "supplier_name", "receipt": "store_name"}
TAX = {"invoice": "vendor_tax_id", "po": "supplier_tax_id", "receipt": "store_tax_id"}
#: All fields that may hold a tax number, and the amounts that must be numbers.
TAX_FIELDS = ("vendor_tax_id", "buyer_tax_id", "supplier_tax_id", "store_tax_id", "tax_id")
AMOUNTS = {"subtotal": "sub", "tax_amount": "tax", "total_amount": "amount", "change_amount": "change"}
NOT_CORRECTABLE = ("tax_id_checksum_invalid",)
#: What an issue of a rule says, before the value or figures it is about.
MESSAGES = {
    "required_field_missing": "required, but missing or empty", "date_format_invalid": "not written as YYYY-MM-DD", "date_invalid": "not a day of the calendar", "date_implausible": "year is implausible",
    "numeric_invalid": "not a number", "negative_amount": "amount is negative", "item_total_mismatch": "quantity times price, less discount, isn't the line's total", "negative_discount": "discount is negative",
    "subtotal_mismatch": "lines don't add up to the subtotal", "total_mismatch": "parts don't add up to the total", "tax_rate_implausible": "tax is over half of the subtotal", "too_many_items": "unusually many lines",
    "total_implausible": "total is implausibly large", "tax_id_label_captured": "the number came with its label", "tax_id_unverifiable": "no check digit to verify", "tax_id_checksum_invalid": "check digit is wrong", "seller_tax_id_missing": "the seller's number is missing on a lira invoice",
}
ISSUE = "struct<rule:string,field:string,severity:string,expected_k:bigint,actual_k:bigint,detail:string>"


def assemble(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """headers with `items`, their lines in order of pos; empty if there is none."""
    item = F.struct("pos", "sku", "qty", "price_k", "disc_k", "total_k")
    grouped = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.array().cast(grouped.schema["items"].dataType)
    return headers.join(grouped, "doc_id", "left").withColumn("items", F.coalesce("items", none))


def _by_type(names: dict[str, str]) -> Column:
    kind = F.col("doc_type")
    out = F.when(kind == "po", names["po"]).when(kind == "receipt", names["receipt"])
    return out.otherwise(names["invoice"])


def _issue(rule, field, severity, expected=None, actual=None, detail=None) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(text(rule).alias("rule"), text(field).alias("field"), text(severity).alias("severity"), text(expected).cast("long").alias("expected_k"), text(actual).cast("long").alias("actual_k"), text(detail).cast("string").alias("detail"))


def _off(a: Column, b: Column) -> Column:
    return F.abs(a - b) > TOLERANCE


def computed(i: Column) -> Column:
    """A line's quantity, which may have a fraction, times its price, in whole kuruş."""
    return F.round(i["qty"].cast("decimal(24,6)") * i["price_k"], 0).cast("long")


def _printed(documents: DataFrame, name: str) -> Column:
    """What stands for an amount that isn't a number: null if it is one, or the column is absent."""
    return F.nullif(F.trim(f"{name}_text"), F.lit("")) if f"{name}_text" in documents.columns else F.lit(None).cast("string")


def item_sum() -> Column:
    return F.aggregate("items", F.lit(0).cast("long"), lambda s, i: s + F.coalesce(i["total_k"], F.lit(0)))


def required_issues(documents: DataFrame) -> list[Column]:
    """A critical issue for each of five fields that is null or empty; a total that isn't a number
    is there."""
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    tests = [(blank("number"), _by_type(NUMBER)), (blank("date_text"), "date"), (blank("party"), _by_type(PARTY)), (F.size("items") == 0, "items"), (F.col("amount_k").isNull() & _printed(documents, "amount").isNull(), "total_amount")]
    return [F.when(t, _issue("required_field_missing", f, "critical")) for t, f in tests]


def date_issues(column: str = "date_text", field: str = "date") -> list[Column]:
    """Not ISO, not a day of the calendar, or a year before 2000 or after 2030."""
    c = F.col(column)
    shaped, day = c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd")
    rule = F.when(~shaped, "date_format_invalid").when(day.isNull(), "date_invalid").when(~F.year(day).between(2000, 2030), "date_implausible")
    return [F.when(c.isNotNull() & rule.isNotNull(), _issue(rule, field, "warning", detail=c))]


def amount_issues(documents: DataFrame) -> list[Column]:
    """Amounts that aren't numbers (columns named _text hold what stands there), or under 0."""
    out = []
    for field, name in AMOUNTS.items():
        bad = _printed(documents, name)
        k = F.col(f"{name}_k") if f"{name}_k" in documents.columns else F.lit(None).cast("long")
        out.append(F.when(bad.isNotNull(), _issue("numeric_invalid", field, "warning", detail=bad)).when(k < 0, _issue("negative_amount", field, "warning", actual=k)))
    return out


def item_issues() -> Column:
    """Per line: quantity times price, less a discount on invoices, against the printed total; and
    a discount under 0, on invoices whose line can be computed."""
    invoice = F.col("doc_type") == "invoice"

    def of(i: Column) -> Column:
        disc = F.when(invoice, F.coalesce(i["disc_k"], F.lit(0))).otherwise(0)
        expected = computed(i) - disc
        at = lambda f: F.concat(F.lit("items["), i["pos"].cast("string"), F.lit("]." + f))
        return F.array(F.when(_off(expected, i["total_k"]), _issue("item_total_mismatch", at("total"), "critical", expected, i["total_k"])), F.when((disc < 0) & expected.isNotNull() & i["total_k"].isNotNull(), _issue("negative_discount", at("discount"), "warning", actual=disc)))

    return F.flatten(F.transform("items", of))


def sum_issues() -> list[Column]:
    """Lines against the subtotal, subtotal and tax against the total; on an order, lines against
    the total."""
    order, lines, some = F.col("doc_type") == "po", item_sum(), F.size("items") > 0
    whole = F.col("sub_k") + F.col("tax_k")
    return [
        F.when(~order & some & _off(lines, F.col("sub_k")), _issue("subtotal_mismatch", "subtotal", "critical", lines, F.col("sub_k"))),
        F.when(~order & _off(whole, F.col("amount_k")), _issue("total_mismatch", "total_amount", "critical", whole, F.col("amount_k"))),
        F.when(order & some & _off(lines, F.col("amount_k")), _issue("total_mismatch", "total_amount", "critical", lines, F.col("amount_k"))),
    ]


def plausibility_issues(most_items: int = MOST_ITEMS) -> list[Column]:
    return [
        F.when((F.col("sub_k") > 0) & (F.col("tax_k") != 0) & (F.col("tax_k") * 2 > F.col("sub_k")), _issue("tax_rate_implausible", "tax_amount", "warning")),
        F.when(F.size("items") > most_items, _issue("too_many_items", "items", "info", actual=F.size("items"))),
        F.when(F.col("amount_k") > MOST_AMOUNT_K, _issue("total_implausible", "total_amount", "warning", actual=F.col("amount_k"))),
    ]


def _judged(number: Column, field: Column) -> Column:
    label = lambda f: _issue("tax_id_label_captured", field, "warning", detail=f["normalized"])
    judge = lambda f: F.when(f["kind"] == "label_captured", label(f)).when(f["valid"].isNull(), _issue("tax_id_unverifiable", field, "info", detail=number)).when(~f["valid"], _issue("tax_id_checksum_invalid", field, "critical", detail=number))
    return F.when(F.coalesce(F.trim(number) != "", F.lit(False)), F.get(F.transform(F.array(classify_tax_id(number)), judge), 0))


def tax_id_issues(documents: DataFrame) -> list[Column]:
    """A seller's number missing on a lira invoice; one whose check digit is wrong, that came with
    its label, or that can't be judged; the same for the other numbers, of which there may be a
    column each, or a map other_tax_ids."""
    blank = F.coalesce(F.trim("tax_id") == "", F.lit(True))
    lira = F.upper(F.trim(F.coalesce("currency", F.lit("")))) == "TRY"
    other = []
    for field in TAX_FIELDS:
        if field != "tax_id" and field in documents.columns:
            other.append(_judged(F.col(field), F.lit(field)))
        elif "other_tax_ids" in documents.columns:
            other.append(_judged(F.try_element_at("other_tax_ids", F.lit(field)), F.lit(field)))
    return [F.when(lira & blank & (F.col("doc_type") == "invoice"), _issue("seller_tax_id_missing", "vendor_tax_id", "warning")), _judged(F.col("tax_id"), _by_type(TAX)), *other]


def verify(documents: DataFrame, most_items: int = MOST_ITEMS) -> DataFrame:
    """documents with issues (in the order of the rules), critical, warning, info, valid, score."""
    dates = [d for c, f in (("date_text", "date"), ("due_text", "due_date"), ("delivery_text", "delivery_date")) if c in documents.columns for d in date_issues(c, f)]
    head = F.array(*required_issues(documents), *dates, *amount_issues(documents))
    tail = F.array(*sum_issues(), *plausibility_issues(most_items), *tax_id_issues(documents))
    out = documents.withColumn("issues", F.filter(F.concat(head, item_issues(), tail), lambda x: x.isNotNull()))
    count = lambda s: F.size(F.filter("issues", lambda x: x["severity"] == s))
    out = out.withColumns({s: count(s) for s in ("critical", "warning", "info")})
    score = F.greatest(100 - 20 * F.col("critical") - 5 * F.col("warning") - F.col("info"), F.lit(0)) / F.lit(100.0)
    return out.withColumns({"valid": F.col("critical") == 0, "score": score})


def issues(verified: DataFrame) -> DataFrame:
    """One row per issue: doc_id, doc_type, ord and the issue's fields."""
    return verified.select("doc_id", "doc_type", F.posexplode("issues").alias("ord", "i")).select("doc_id", "doc_type", "ord", "i.*")


def issue_message() -> Column:
    """Of an issue's row: what is wrong, then the value it is about, or both figures."""
    said = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv]), F.col("rule")), F.col("rule"))
    figure = lambda c: F.format_string("%.2f", F.col(c) / F.lit(100.0))
    both = F.when(F.col("expected_k").isNotNull() & F.col("actual_k").isNotNull(), F.concat(F.lit("expected "), figure("expected_k"), F.lit(", found "), figure("actual_k")))
    return F.concat_ws(": ", said, F.coalesce("detail", both))


def is_correctable(rule: Column, flag: Column | None = None) -> Column:
    """An explicit flag, else whether a right value can be derived at all."""
    derived = ~rule.isin(*NOT_CORRECTABLE)
    return derived if flag is None else F.coalesce(flag, derived)


def rules_only_decision() -> Column:
    """Of a verified row."""
    return F.when(~F.col("valid"), "REJECT").when(F.col("warning") > 0, "CAUTION").otherwise("ACCEPT")


def llm_counts(results: Column) -> tuple[Column, Column]:
    """(hallucinations, errors) recounted from array<struct<field, status>>."""
    n = lambda s: F.size(F.filter(F.coalesce(results, F.array().cast("array<struct<field:string,status:string>>")), lambda x: x["status"] == s))
    return n("hallucination"), n("error")


def combine(verified: DataFrame, llm: DataFrame, rule_weight: float = 0.4) -> DataFrame:
    """Ensemble of a rule report and a model's (doc_id, confidence, results): decision, score,
    number of issues and a summary. A document without a model's answer counts as confidence 0."""
    hall, err = llm_counts(F.col("results"))
    both = verified.join(llm, "doc_id", "left").withColumns({"hallucinations": hall, "errors": err, "confidence": F.coalesce("confidence", F.lit(0.0))})
    added = F.size(F.filter(F.coalesce("results", F.array().cast("array<struct<field:string,status:string>>")), lambda x: x["status"].isin("hallucination", "error", "missing")))
    decision = F.when(F.col("critical") > 0, "REJECT").when(F.col("hallucinations") > 0, "REVIEW").when((F.col("warning") > 0) | (F.col("errors") > 0), "CAUTION").otherwise("ACCEPT")
    said = F.concat_ws(" ", F.concat(F.lit("Decision: "), decision, F.lit(".")), *[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(t))) for c, t in (("critical", " critical rule violations."), ("warning", " warnings."), ("hallucinations", " hallucinations detected by LLM."), ("errors", " extraction errors detected by LLM."))], F.concat(F.lit("LLM confidence: "), F.floor(F.col("confidence") * 100 + 0.5).cast("string"), F.lit("%.")))
    score = F.floor((rule_weight * F.col("score") + (1 - rule_weight) * F.col("confidence")) * 10000 + 0.5) / F.lit(10000.0)
    return both.select("doc_id", decision.alias("decision"), score.alias("combined_score"), (F.size("issues") + added).alias("n_issues"), (F.col("hallucinations") > 0).alias("hallucination_detected"), said.alias("summary"))
