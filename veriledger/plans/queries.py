"""One query per operator over views of the driver's tables, keyed by the operator's name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriledger import functions as fn
from veriledger.operators import decision, ledger, matching, repair, reporting, rules, scoring, validate, voting
from veriledger.plans.views import view
from veriledger.sources import documents as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Lines that a document may have before it is remarked on, in these small orders.
MOST_ITEMS = 6


def query(name: str):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    heads = view(spark, d, "inv_docs").drop("n_items").withColumn("other_tax_ids", F.create_map(F.lit("buyer_tax_id"), F.col("buyer_tax_id"))).drop("buyer_tax_id")
    return rules.assemble(heads, view(spark, d, "inv_items"))


def verified(spark: SparkSession, d: str) -> DataFrame:
    return rules.verify(docs(spark, d), MOST_ITEMS)


def found(spark: SparkSession, d: str) -> DataFrame:
    return rules.issues(verified(spark, d)).withColumn("rule", F.col("rule"))


def names(spark: SparkSession, d: str) -> DataFrame:
    """Company names and numbers in the spellings that documents use."""
    s = view(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    forms = F.array(*[F.lit(x) for x in ("Ttnet A.Ş.", "TTNET ANONIM ŞIRKETI", "Sarıtekeli Market", "Öz Ltd. Şti.", "Gübre San. Tic.")])
    return s.withColumn("name", F.when(F.col("id") % 2 == 0, F.get(forms, (F.col("id") / 2).cast("int") % 5)).otherwise(F.col("name")))


def numbers(spark: SparkSession, d: str) -> DataFrame:
    """Every number of the ledger, and those of incoming documents in their own spellings under the row they come from."""
    old, new = view(spark, d, "ledger"), view(spark, d, "incoming")
    columns = ("doc_number", "supplier", "amount_key")
    return old.select(F.col("row_id").alias("id"), *columns).unionByName(new.select(F.col("doc_id").alias("id"), *columns))


# ---- scalar functions


@query("FN-01_name")
def _(s, d):
    return names(s, d).select("id", fn.normalise_name(F.col("name")).alias("name_key"))


@query("FN-02_doc_number")
def _(s, d):
    return numbers(s, d).select("id", fn.normalise_doc_number(F.col("doc_number")).alias("number_key"))


@query("FN-03_number_core")
def _(s, d):
    return numbers(s, d).select("id", fn.number_core(F.col("doc_number")).alias("number_core"))


@query("FN-04_supplier_key")
def _(s, d):
    t = view(s, d, "tax_ids")
    return t.select("suppkey", fn.supplier_key(F.when(F.col("suppkey") % 3 != 0, F.col("tax_id")), F.col("name")).alias("supplier_key"))


@query("FN-05_identity_key")
def _(s, d):
    return numbers(s, d).select("id", fn.identity_key(F.col("supplier"), fn.normalise_doc_number(F.col("doc_number"))).alias("identity_key"))


@query("FN-06_amount_key")
def _(s, d):
    return view(s, d, "orders").select("o_orderkey", fn.cents(F.col("o_totalprice")).alias("amount_key"))


@query("FN-07_as_date")
def _(s, d):
    day = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(day, "dd.MM.yyyy")).when(F.col("o_orderkey") % 5 == 1, F.date_format(day, "dd/MM/yyyy")).when(F.col("o_orderkey") % 5 == 2, F.date_format(day, "dd-MM-yyyy")).when(F.col("o_orderkey") % 5 == 3, "last month").otherwise(F.date_format(day, "yyyy-MM-dd"))
    return view(s, d, "orders").select("o_orderkey", fn.as_date(text).cast("string").alias("issue_date"))


@query("FN-08_to_number")
def _(s, d):
    text = F.concat(F.when(F.col("event_id") % 3 == 0, "1,").otherwise(""), (F.col("event_id") % 1000).cast("string"), F.when(F.col("event_id") % 7 == 0, "x").when(F.col("event_id") % 11 == 0, "d").otherwise(".5"))
    return view(s, d, "events").select("event_id", (fn.to_number(text) * 10).cast("long").alias("tenths"), fn.is_numeric(text).alias("is_numeric"))


@query("FN-09_normalize_tax_id")
def _(s, d):
    return view(s, d, "tax_ids").select("suppkey", fn.normalize_tax_id(F.col("tax_id")).alias("normalized"))


@query("FN-10_vkn")
def _(s, d):
    return view(s, d, "orders").select("o_orderkey", fn.is_valid_vkn(F.lpad((F.col("o_orderkey") * 7919 % 10000000000).cast("string"), 10, "0")).alias("valid"))


@query("FN-11_tckn")
def _(s, d):
    return view(s, d, "orders").select("o_orderkey", fn.is_valid_tckn((F.col("o_orderkey") * 7919 % 90000000000 + 10000000000).cast("string")).alias("valid"))


@query("FN-12_classify_tax_id")
def _(s, d):
    return view(s, d, "tax_ids").select("suppkey", fn.classify_tax_id(F.col("tax_id")).alias("c")).select("suppkey", "c.*")


@query("FN-13_currency")
def _(s, d):
    return view(s, d, "inv_docs").select("doc_id", fn.normalise_currency(F.concat(F.lit(" "), F.coalesce("currency", F.lit("euro")))).alias("currency"))


@query("FN-14_vendor")
def _(s, d):
    return names(s, d).select("id", fn.normalise_vendor(F.col("name")).alias("vendor"))


@query("FN-15_text")
def _(s, d):
    return view(s, d, "documents").select("doc_id", F.md5(fn.normalise_text(F.col("text"))).alias("normal"))


@query("FN-16_similarity")
def _(s, d):
    p = view(s, d, "part").select("p_partkey", "p_name", "p_type")
    from veriledger.functions.similarity import similar_pairs

    return similar_pairs(p, "p_name", "p_type", "sim").select("p_partkey", F.round("sim", 6).alias("sim"))


@query("FN-17_numeric_close")
def _(s, d):
    i = view(s, d, "po_items").alias("p").join(view(s, d, "inv_items").alias("i"), ["doc_id", "pos"])
    return i.select("doc_id", "pos", fn.numeric_close(F.col("p.price_k").cast("double"), F.col("i.price_k").cast("double"), 0.02).alias("close"))


@query("FN-18_money")
def _(s, d):
    return view(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(fn.cents(F.col("l_extendedprice"))).alias("k")).select("l_orderkey", fn.money(F.col("k") / 100).alias("money"))


@query("FN-19_turkish_money")
def _(s, d):
    return view(s, d, "orders").select("o_orderkey", fn.turkish_money(F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(1) * F.floor(F.col("o_totalprice") * 100 + 0.5).cast("decimal(18,0)") / 100).alias("money"))


@query("FN-20_stray_escapes")
def _(s, d):
    return view(s, d, "events").select("event_id", fn.strip_stray_escapes(F.replace(F.col("props"), F.lit('"'), F.lit('\\"'))).alias("text"))


def _responses(s, d):
    p = F.col("props")
    wrapped = F.when(F.col("event_id") % 4 == 0, p).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("Result "), p, F.lit(" done"))).otherwise("no answer")
    return view(s, d, "events").select(F.col("event_id").alias("doc_id"), wrapped.alias("response"))


@query("FN-21_parse_response")
def _(s, d):
    return src.parse_responses(_responses(s, d)).select("doc_id", F.try_variant_get("data", "$.k", "bigint").alias("k"))


@query("FN-22_flatten")
def _(s, d):
    return repair.flatten(docs(s, d)).where("value is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


@query("FN-23_markdown")
def _(s, d):
    return view(s, d, "part").select("p_partkey", fn.markdown_escape(F.concat("p_brand", F.lit("_*["), "p_type", F.lit("`"))).alias("text"))


@query("FN-24_days_between")
def _(s, d):
    return view(s, d, "lineitem").join(view(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.sum(fn.days_between(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))).cast("long").alias("days"))


@query("FN-25_round2")
def _(s, d):
    return view(s, d, "part").select("p_partkey", fn.cents(F.col("p_retailprice") * F.lit(0.18)).alias("tax_k"))


# ---- rules

RULES = {
    "RL-01_required": ("required_field_missing",), "RL-02_dates": ("date_format_invalid", "date_invalid", "date_implausible"), "RL-04_item_total": ("item_total_mismatch", "invoice"), "RL-05_discount": ("negative_discount",), "RL-06_subtotal": ("subtotal_mismatch", "invoice"),
    "RL-07_total": ("total_mismatch", "invoice"), "RL-08_po_math": ("item_total_mismatch", "total_mismatch", "po"), "RL-09_receipt_math": ("item_total_mismatch", "subtotal_mismatch", "total_mismatch", "receipt"), "RL-10_tax_rate": ("tax_rate_implausible",), "RL-11_many_items": ("too_many_items",),
    "RL-12_large_total": ("total_implausible",), "RL-13_tax_ids": ("tax_id_checksum_invalid", "tax_id_label_captured", "tax_id_unverifiable"), "RL-14_seller_tax_id": ("seller_tax_id_missing",),
}


def _rule_query(rule_names: tuple[str, ...]) -> Query:
    kinds = [n for n in rule_names if n in ("invoice", "po", "receipt")]
    wanted = [n for n in rule_names if n not in kinds]

    def run(s, d):
        out = found(s, d).where(F.col("rule").isin(*wanted))
        out = out.where(F.col("doc_type").isin(*kinds)) if kinds else out
        return out.select("doc_id", "rule", "field", "severity", "expected_k", "actual_k")

    return run


QUERIES |= {k: _rule_query(v) for k, v in RULES.items()}


@query("RL-03_numeric")
def _(s, d):
    return found(s, d).where("rule in ('numeric_invalid', 'negative_amount')").select("doc_id", "rule", "field", "detail", "actual_k")


@query("RL-15_report")
def _(s, d):
    return verified(s, d).select("doc_id", F.col("critical").cast("long").alias("critical"), F.col("warning").cast("long").alias("warning"), F.col("info").cast("long").alias("info"), "valid", "score")


@query("RL-16_correctable")
def _(s, d):
    return found(s, d).groupBy("rule").agg(F.count("*").alias("n"), F.bool_and(rules.is_correctable(F.col("rule"))).alias("correctable"))


def ground(s, d):
    lang = F.when(F.col("doc_id") % 31 == 0, "de").when(F.col("doc_id") % 3 == 0, "tr").when(F.col("doc_id") % 3 == 1, "en").otherwise("mixed")
    return validate.validate(docs(s, d).withColumn("language", lang))


def _errors(pattern: str) -> Query:
    return lambda s, d: ground(s, d).select("doc_id", F.explode("errors").alias("error")).where(F.col("error").rlike(pattern))


QUERIES["RL-17_gt_fields"] = _errors("^(missing|date|tax_id|currency|language|total_amount)")
QUERIES["RL-18_gt_items"] = _errors("^item")
QUERIES["RL-19_gt_math"] = _errors("^math")


@query("RL-20_batch_validate")
def _(s, d):
    return validate.totals(ground(s, d), "doc_type")


@query("RL-21_quality_report")
def _(s, d):
    return validate.quality_report(ground(s, d))


@query("RL-22_rules_only")
def _(s, d):
    return verified(s, d).select("doc_id", rules.rules_only_decision().alias("decision"), "score")


def llm_reports(s, d):
    st = lambda k: F.when(F.col("doc_id") % k == 0, F.struct(F.lit("total_amount").alias("field"), F.when(F.col("doc_id") % (k * 2) == 0, "hallucination").when(F.col("doc_id") % (k * 3) == 0, "error").otherwise("missing").alias("status")))
    return view(s, d, "inv_docs").where("doc_id % 10 <> 7").select("doc_id", ((F.col("doc_id") % 5) / F.lit(4.0)).alias("confidence"), F.filter(F.array(st(4), st(9)), lambda x: x.isNotNull()).alias("results"))


def _combined(*cols: str) -> Query:
    return lambda s, d: rules.combine(verified(s, d), llm_reports(s, d)).select("doc_id", *cols)


QUERIES["RL-23_combine"] = lambda s, d: rules.combine(verified(s, d), llm_reports(s, d)).select("doc_id", "decision", "combined_score", F.col("n_issues").cast("long").alias("n_issues"), "hallucination_detected")
QUERIES["RL-25_summary"] = _combined("summary")


@query("RL-24_llm_counts")
def _(s, d):
    h, e = rules.llm_counts(F.col("results"))
    return llm_reports(s, d).select("doc_id", h.cast("long").alias("hallucinations"), e.cast("long").alias("errors"))


# ---- repair and correction


@query("TR-01_repair")
def _(s, d):
    holes = docs(s, d).withColumn("items", F.transform("items", lambda i: i.withField("total_k", F.when(i["pos"] % 3 != 1, i["total_k"])))).withColumn("sub_k", F.when(F.col("doc_id") % 3 != 0, F.col("sub_k"))).withColumn("tax_k", F.when(F.col("doc_id") % 4 != 0, F.col("tax_k")))
    return repair.repair_arithmetic(holes).select("doc_id", rules.item_sum().alias("items_k"), "sub_k", "amount_k")


def _flat(s, d, which: str) -> DataFrame:
    return view(s, d, "fields").select("doc_id", "path", F.col(which).alias("value"))


@query("TR-02_apply_corrections")
def _(s, d):
    fixes = _flat(s, d, "truth").where("path in ('vendor_name', 'tax_rate')").unionByName(view(s, d, "orders").where("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, "items[99].total").otherwise("extra").alias("path"), F.lit("1").alias("value")))
    return repair.apply_corrections(_flat(s, d, "predicted"), fixes)


@query("TR-03_changed_fields")
def _(s, d):
    return repair.changed_fields(_flat(s, d, "truth"), _flat(s, d, "predicted"))


def _merged(s, d):
    flagged = view(s, d, "fields").where("(doc_id + length(path)) % 3 = 0").select("doc_id", "path")
    return repair.merge_allowed(_flat(s, d, "truth"), _flat(s, d, "predicted"), flagged)


QUERIES["TR-04_merge"] = lambda s, d: _merged(s, d)[0]
QUERIES["SE-04_refused"] = lambda s, d: _merged(s, d)[1]


@query("TR-05_gate")
def _(s, d):
    gated = repair.to_correct(found(s, d)).groupBy("doc_id").agg(F.count("*").alias("n_sent"))
    changes = view(s, d, "inv_docs").where("doc_id % 6 = 0").select("doc_id", F.when(F.col("doc_id") % 12 == 0, "total_amount").otherwise("notes").alias("path"))
    reasons = repair.unrequested(changes, found(s, d).select("doc_id", "field")).groupBy("doc_id").agg(F.min("reason").alias("reason"))
    return gated.join(reasons, "doc_id", "left")


@query("TR-06_verdict")
def _(s, d):
    return repair.pipeline_verdict(docs(s, d), found(s, d).where("severity = 'critical'").select("doc_id"))


@query("TR-07_issue_text")
def _(s, d):
    return found(s, d).select("doc_id", repair.issue_text(F.col("severity"), F.col("field"), rules.issue_message()).alias("text"))


def _canonical(s, d):
    v = view(s, d, "inv_docs")
    shaped = v.select("doc_id", F.when(F.col("doc_type") == "invoice", F.col("number")).otherwise("").alias("invoice_number"), F.when(F.col("doc_type") == "receipt", F.col("number")).alias("receipt_number"), F.when(F.col("doc_type") == "po", F.col("number")).alias("po_number"), F.when(F.col("doc_id") % 2 == 0, F.col("party")).otherwise("").alias("vendor_name"), F.col("party").alias("supplier_name"), F.col("tax_id").alias("vendor_tax_id"), F.col("date_text").alias("date"), "currency")
    return repair.canonical(shaped)


def _efatura(s, d):
    v = view(s, d, "inv_docs")
    return repair.canonical_efatura(v.select("doc_id", F.col("number").alias("doc_number"), F.lit("alt").alias("invoice_number"), F.col("party").alias("supplier_name"), F.col("tax_id").alias("supplier_tax_id"), F.col("date_text").alias("issue_date"), "currency", F.concat(F.lit("ettn-"), F.col("doc_id").cast("string")).alias("ettn")))


def _dates_as_text(df):
    return df.withColumn("issue_date", F.col("issue_date").cast("string"))


QUERIES["TR-08_canonical"] = lambda s, d: _dates_as_text(_canonical(s, d)).drop("source_ref")
QUERIES["TR-09_efatura"] = lambda s, d: _dates_as_text(_efatura(s, d))
QUERIES["SE-05_channels"] = lambda s, d: _canonical(s, d).unionByName(_efatura(s, d)).groupBy("channel", "currency").agg(F.count("*").alias("n"))

# ---- duplicates


def incoming(s, d):
    return view(s, d, "incoming")


def memory(s, d):
    return view(s, d, "ledger").select("row_id", "supplier", "doc_number", "issue_date", "amount_key", "channel")


def keyed(s, d):
    return ledger.with_keys(incoming(s, d)), ledger.with_keys(memory(s, d))


QUERIES["JN-01_identity"] = lambda s, d: ledger.by_identity(*keyed(s, d)).select("doc_id", "row_id")
QUERIES["JN-02_number_core"] = lambda s, d: ledger.by_number_core(*keyed(s, d)).select("doc_id", "row_id")
QUERIES["JN-03_amount_window"] = lambda s, d: ledger.by_amount_near_date(*keyed(s, d)).select("doc_id", "row_id")


def matched(s, d):
    return ledger.matches(incoming(s, d), memory(s, d))


QUERIES["JN-04_strongest"] = lambda s, d: matched(s, d).select("doc_id", "row_id", "tier", "risk", F.col("days_apart").cast("long").alias("days_apart"))
QUERIES["JN-05_history"] = lambda s, d: ledger.supplier_history(incoming(s, d), memory(s, d), 20).select("supplier", "row_id", F.col("rank").cast("long").alias("rank"))
QUERIES["SO-03_newest"] = lambda s, d: ledger.supplier_history(incoming(s, d), memory(s, d), 3).select("supplier", "row_id")
QUERIES["WN-04_history_rank"] = lambda s, d: ledger.supplier_history(incoming(s, d), memory(s, d)).groupBy("supplier").agg(F.count("*").alias("n"), F.max("rank").cast("long").alias("last_rank"))
QUERIES["AG-03_risk"] = lambda s, d: ledger.document_risk(incoming(s, d), matched(s, d))
QUERIES["SO-01_order"] = lambda s, d: ledger.ordered(matched(s, d)).select("doc_id", "row_id", F.col("place").cast("long").alias("place"))
QUERIES["FD-11_duplicate_findings"] = lambda s, d: ledger.to_findings(matched(s, d)).select("doc_id", "kind", "severity", "expected", "actual", "message", "blocks_payment")
QUERIES["WN-01_recurring"] = lambda s, d: ledger.recurring(view(s, d, "recurring"))


@query("WN-02_damper")
def _(s, d):
    hist = view(s, d, "recurring").withColumn("channel", F.lit("photo")).withColumn("doc_number", F.concat(F.lit("A"), F.col("row_id").cast("string")))
    new = hist.groupBy("supplier").agg(F.max("issue_date").alias("last")).select(F.col("supplier").cast("long").alias("doc_id"), "supplier", F.lit(2400).alias("amount_key"), F.date_add("last", 5).alias("issue_date"), F.lit("email_pdf").alias("channel"), F.lit("Z1").alias("doc_number"))
    return ledger.damped(ledger.matches(new, hist), new, hist).select("doc_id", "row_id", "risk", "recurring")


QUERIES["AG-19_ledger_count"] = lambda s, d: memory(s, d).agg(F.count("*").alias("n"))
QUERIES["SRC-10_ledger_scan"] = lambda s, d: memory(s, d).where("supplier = '7'").select("row_id", "doc_number", "amount_key")
QUERIES["SNK-01_record"] = lambda s, d: ledger.record(incoming(s, d), memory(s, d)).select("doc_id", "row_id", "supplier")

# ---- orders against invoices


def po(s, d):
    return view(s, d, "po_items")


def inv(s, d):
    return view(s, d, "inv_items").select("doc_id", "pos", "sku", "partkey", "qty", "price_k", "total_k")


def pairs(s, d):
    return matching.pair_by_sku(po(s, d), inv(s, d))


def lines(s, d):
    """Orders against invoices, in which some lines have a description and no SKU."""
    return matching.match_lines(view(s, d, "po_lines"), view(s, d, "inv_lines"))


def discrepancies(s, d):
    return matching.discrepancies(lines(s, d)).where(~F.col("field").startswith("_"))


def scalars(s, d):
    v = view(s, d, "inv_docs")
    party = F.when(F.col("doc_id") % 29 == 0, "zzzzzz").otherwise(F.col("party")).alias("party")
    orders = v.select("doc_id", (F.col("sub_k") + F.when(F.col("doc_id") % 23 == 0, F.floor(F.col("sub_k") / 10)).otherwise(0)).alias("amount_k"), F.when(F.col("doc_id") % 8 == 1, "TRY").otherwise(F.col("currency")).alias("currency"), party)
    return matching.scalar_checks(orders, v)


QUERIES["JN-06_sku_pairs"] = pairs
QUERIES["WN-03_occurrence"] = lambda s, d: pairs(s, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("inv_pos").alias("last"))
QUERIES["JN-08_match_lines"] = lambda s, d: lines(s, d).where("side = 'pair'").select("doc_id", "line", "po_pos", "inv_pos", "sim")
QUERIES["JN-09_unmatched"] = lambda s, d: lines(s, d).where("side <> 'pair'").select("doc_id", F.coalesce("po_pos", "inv_pos").alias("pos"), "side")
QUERIES["FD-01_discrepancies"] = lambda s, d: discrepancies(s, d).select("doc_id", "line", "field", "po_value", "inv_value", "severity", "diff_bp")
QUERIES["JN-10_scalars"] = lambda s, d: scalars(s, d).select("doc_id", "field", "matched", "severity")
QUERIES["FD-04_total_check"] = lambda s, d: scalars(s, d).where("field = 'total_amount'").select("doc_id", "matched", "severity")
QUERIES["FD-05_currency_check"] = lambda s, d: scalars(s, d).where("field = 'currency'").select("doc_id", "matched", "severity")


def _described(df, s, d):
    parts = view(s, d, "part").select(F.col("p_partkey").alias("partkey"), F.concat_ws(" ", "p_name", "p_brand").alias("text"), "p_type")
    return df.join(parts, "partkey", "left")


def _candidates(s, d):
    a = _described(po(s, d), s, d).select("doc_id", "pos", F.when(F.col("partkey") % 2 == 0, F.col("sku")).alias("sku"), F.col("text").alias("description"))
    b = _described(inv(s, d), s, d).select("doc_id", "pos", "sku", F.concat_ws(" ", "text", F.when(F.col("partkey") % 3 == 0, F.col("p_type"))).alias("description"))
    return matching.candidate_scores(a, b)


QUERIES["JN-07_fuzzy_scores"] = _candidates
QUERIES["JN-08_greedy"] = lambda s, d: matching.greedy_pairs(_candidates(s, d))


@query("FD-02_descriptions")
def _(s, d):
    p = view(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("line"), F.col("p_name").alias("a"), F.when(F.col("p_partkey") % 3 != 0, F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")))).alias("b"))
    return matching.description_issues(p)


@query("FD-03_match_score")
def _(s, d):
    return lines(s, d).where("side = 'pair'").select("doc_id", "line", matching.match_score(F.col("sim"), F.col("po_qty").cast("double"), F.col("inv_qty").cast("double")).alias("match_score"))


@query("FD-06_supplier_check")
def _(s, d):
    n = names(s, d)
    return matching.supplier_check(n.select(F.col("id").alias("doc_id"), F.col("name").alias("a"), F.when(F.col("id") % 3 == 0, F.upper("name")).otherwise(F.concat(F.lit("Other "), "name")).alias("b")))


@query("GR-01_goods_receipts")
def _(s, d):
    lines = view(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("sku")).agg(F.sum("l_quantity").cast("long").alias("qty"), F.min("l_partkey").alias("partkey"))
    invoice = lines.select("doc_id", "sku", "qty", F.col("qty").alias("ordered"), F.lit("2026-03-01").cast("date").alias("invoice_date"))
    got = lines.where("partkey % 9 <> 0").select("doc_id", "sku", (F.col("qty") - F.when(F.col("partkey") % 4 == 0, 1).otherwise(0)).alias("received"), F.when(F.col("partkey") % 6 == 0, "2026-03-05").otherwise("2026-02-01").cast("date").alias("posted"))
    return matching.goods_receipts(invoice, got)


@query("AG-02_match_summary")
def match_summary(s, d):
    out = matching.summary(view(s, d, "inv_docs"), lines(s, d), scalars(s, d))
    return out.select("doc_id", "matched", "unmatched_po", "unmatched_inv", "critical", "warnings", "match_rate_bp", "overall_status")


# ---- findings and decisions


def po_findings(s, d):
    return decision.from_discrepancies(matching.discrepancies(lines(s, d))).unionByName(decision.from_scalars(scalars(s, d)))


def all_findings(s, d):
    dup = ledger.to_findings(matched(s, d))
    return decision.from_verification(found(s, d)).unionByName(po_findings(s, d)).unionByName(dup)


MONEY = ("doc_id", "kind", "severity", "field", "amount_k")
QUERIES["FD-07_rule_findings"] = lambda s, d: decision.from_verification(found(s, d)).select(*MONEY)
QUERIES["FD-08_po_findings"] = lambda s, d: decision.from_discrepancies(discrepancies(s, d)).select(*MONEY, "line")
QUERIES["FD-09_scalar_findings"] = lambda s, d: decision.from_scalars(scalars(s, d)).select(*MONEY)
QUERIES["FD-10_unmatched_findings"] = lambda s, d: decision.from_discrepancies(matching.discrepancies(lines(s, d))).where("field = 'items'").select("doc_id", "kind", "severity", "expected", "actual", "amount_k")
QUERIES["FD-12_failed"] = lambda s, d: decision.extraction_failed(view(s, d, "inv_docs"), view(s, d, "inv_docs").where("n_items > 0")).select("doc_id", "kind", "severity")
QUERIES["FD-13_flags"] = lambda s, d: decision.with_flags(all_findings(s, d)).groupBy("kind", "is_priced", "is_financial", "holds_payment").agg(F.count("*").alias("n"))
QUERIES["FD-14_priced"] = lambda s, d: decision.with_flags(all_findings(s, d)).where("is_priced").groupBy("doc_id").agg(F.count("*").alias("n_priced"))
QUERIES["AG-04_net_impact"] = lambda s, d: decision.net_impact(po_findings(s, d), "cross_source")
QUERIES["AG-05_decide"] = lambda s, d: decision.decide(view(s, d, "inv_docs"), all_findings(s, d))
QUERIES["SE-01_findings"] = lambda s, d: all_findings(s, d).groupBy("source", "severity").agg(F.count("*").alias("n"))
QUERIES["AG-01_severities"] = lambda s, d: found(s, d).groupBy("doc_id").agg(*[F.count_if(F.col("severity") == x).alias(x) for x in ("critical", "warning", "info")])
QUERIES["AG-06_coverage"] = lambda s, d: decision.coverage(_flat(s, d, "predicted")).select("doc_id", "checked", "unverifiable", "coverage_pm")
QUERIES["AG-17_portfolio"] = lambda s, d: decision.portfolio(decision.decide(view(s, d, "inv_docs"), all_findings(s, d)))
QUERIES["AG-17_members"] = lambda s, d: decision.decide(view(s, d, "inv_docs"), all_findings(s, d)).select("verdict", "doc_id")
QUERIES["AG-05_coverage"] = lambda s, d: decision.with_coverage(decision.decide(view(s, d, "inv_docs"), all_findings(s, d)), decision.coverage(_flat(s, d, "predicted"))).select("doc_id", "verdict", "checked", "coverage_pm", F.array_join("blind", ",").alias("blind"))
QUERIES["JN-14_optional_po"] = lambda s, d: decision.decide(view(s, d, "inv_docs"), po_findings(s, d).where("doc_id % 2 = 0")).select("doc_id", "verdict", "financial_k")


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Incoming documents against the ledger: matches, risks, findings, decision."""
    new = incoming(s, d)
    return decision.decide(new, ledger.to_findings(ledger.damped(matched(s, d), new, memory(s, d)))).select("doc_id", "verdict", "n_findings")


QUERIES["PIPE-01_duplicate_decision"] = flagship

# ---- scoring


def truth(s, d):
    return view(s, d, "fields").select("doc_id", "path", "truth")


def predicted(s, d):
    return view(s, d, "fields").where("predicted is not null").select("doc_id", "path", "predicted")


def scored(s, d, similarity: bool = False):
    return scoring.field_scores(scoring.joined_fields(truth(s, d), predicted(s, d)), similarity)


def runs(s, d, similarity: bool = False):
    v = view(s, d, "inv_docs").select("doc_id", "doc_type")
    verdict = F.when(F.col("doc_id") % 4 == 0, "REVIEW").otherwise("OK")
    out = v.join(scoring.document_scores(scored(s, d, similarity)), "doc_id", "left").withColumn("verdict", verdict)
    return out.withColumns({c: F.when(F.col("doc_id") % 13 != 0, F.col(c)) for c in ("em", "f1", "sim") if c in out.columns})


QUERIES["JN-12_fields"] = lambda s, d: scoring.joined_fields(truth(s, d), predicted(s, d))
QUERIES["SC-01_exact"] = lambda s, d: scoring.joined_fields(truth(s, d), predicted(s, d)).select("doc_id", "path", scoring.exact_match(F.col("predicted"), F.col("truth")).alias("em"))
QUERIES["SC-02_relative"] = lambda s, d: view(s, d, "fields").where("path in ('total_amount', 'tax_rate')").select("doc_id", "path", scoring.relative_accuracy(F.col("predicted"), F.col("truth")).alias("score"))
QUERIES["SC-03_absolute"] = lambda s, d: view(s, d, "fields").where("path in ('total_amount', 'tax_rate')").select("doc_id", "path", scoring.absolute_accuracy(F.col("predicted"), F.col("truth"), 0.001).alias("score"))
QUERIES["SC-04_dispatch"] = lambda s, d: view(s, d, "fields").select("doc_id", "path", scoring.numeric_score(F.concat(F.lit("items[0]."), F.col("path")), F.col("predicted"), F.col("truth")).alias("score"))
QUERIES["SC-05_override"] = lambda s, d: scored(s, d).select("doc_id", "path", "em")


@query("SC-06_available")
def _(s, d):
    some = view(s, d, "fields").where("(doc_id + length(path)) % 2 = 0").select("doc_id", "path")
    return scoring.joined_fields(truth(s, d), predicted(s, d), some).select("doc_id", "path")


def _item_pairs(s, d):
    side = lambda df, p, i: _described(df, s, d).select("doc_id", F.col("pos").alias(i), F.col("text").alias(f"{p}_description"), *[F.col(c).alias(f"{p}_{c}") for c in ("qty", "price_k", "total_k")])
    return side(po(s, d), "a", "i").join(side(inv(s, d), "b", "j"), "doc_id")


QUERIES["SC-07_item_similarity"] = lambda s, d: scoring.item_similarity(_item_pairs(s, d)).withColumn("sim", F.round("sim", 6))


def numeric_scores(s, d):
    """Line pairs by numbers alone, in tenths of agreement."""
    a = po(s, d).select("doc_id", F.col("pos").alias("i"), F.col("qty").alias("aq"), F.col("price_k").alias("ap"))
    b = inv(s, d).select("doc_id", F.col("pos").alias("j"), F.col("qty").alias("bq"), F.col("price_k").alias("bp"))
    close = lambda x, y: F.when(F.abs(F.col(x) - F.col(y)) * 50 <= F.abs(F.col(y)), 1).otherwise(0)
    return a.join(b, "doc_id").select("doc_id", "i", "j", (close("aq", "bq") + close("ap", "bp")).alias("sim"))


QUERIES["JN-11_align"] = lambda s, d: scoring.align_items(numeric_scores(s, d))


@query("SC-08_reindex")
def _(s, d):
    aligned = pairs(s, d).select("doc_id", F.col("inv_pos").alias("j"), (F.row_number().over(_by_po()) - 1).cast("long").alias("ord"))
    return scoring.reindex(aligned, inv(s, d).select("doc_id", F.col("pos").alias("j")))


def _by_po():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("po_pos")


QUERIES["WN-06_alignment_rank"] = lambda s, d: QUERIES["SC-08_reindex"](s, d).groupBy("new_pos").agg(F.count("*").alias("n"))
QUERIES["SE-02_key_union"] = lambda s, d: repair.changed_fields(_flat(s, d, "truth").where("doc_id % 2 = 0"), _flat(s, d, "predicted").where("doc_id % 3 = 0")).groupBy("path").agg(F.count("*").alias("n"))


def _token_pairs(s, d):
    from pyspark.sql import Window

    t = view(s, d, "documents").select("doc_id", F.col("text").alias("truth"))
    return t.withColumn("predicted", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.substring(F.col("truth"), F.lit(1), (F.length("truth") * 3 / 4).cast("int"))))


@query("AG-07_token_f1")
def _(s, d):
    p, r, f = fn.token_scores(F.col("predicted"), F.col("truth"))
    return _token_pairs(s, d).select("doc_id", p.alias("precision"), r.alias("recall"), f.alias("f1"))


@query("SE-03_common_words")
def _(s, d):
    w = lambda c: F.array_remove(F.array_distinct(F.split(fn.normalise_text(F.col(c)), " ")), "")
    return _token_pairs(s, d).select("doc_id", F.size(F.array_intersect(w("predicted"), w("truth"))).cast("long").alias("common"))


QUERIES["AG-08_document_scores"] = lambda s, d: scoring.document_scores(scored(s, d))
QUERIES["AG-09_batch_scores"] = lambda s, d: scoring.batch_scores(scoring.document_scores(scored(s, d)))
QUERIES["AG-10_run"] = lambda s, d: scoring.aggregate_run(runs(s, d))
# The same with the likeness of texts, which SQL doesn't have; tested against a plain version.
QUERIES["SC-05_similarity"] = lambda s, d: scored(s, d, True).select("doc_id", "path", "em", "f1", "sim")
QUERIES["AG-08_similarity"] = lambda s, d: scoring.document_scores(scored(s, d, True))
QUERIES["AG-09_similarity"] = lambda s, d: scoring.batch_scores(scoring.document_scores(scored(s, d, True)))
QUERIES["AG-10_similarity"] = lambda s, d: scoring.aggregate_run(runs(s, d, True))
QUERIES["AG-11_raw_delta"] = lambda s, d: scoring.document_scores(scored(s, d)).alias("a").join(scoring.document_scores(scored(s, d).where("path <> 'tax_rate'")).alias("b"), "doc_id").agg(F.round(F.avg("a.em"), 4).alias("em"), F.round(F.avg("b.em"), 4).alias("raw_em"))
QUERIES["AG-16_pilot"] = lambda s, d: scored(s, d).agg(F.round(F.avg("em"), 4).alias("em"), F.count("*").alias("fields_scored"), F.count_if(F.col("em") == 0).alias("misses"))
QUERIES["AG-20_misses"] = lambda s, d: scoring.misses(scored(s, d))
QUERIES["AG-21_moved"] = lambda s, d: scoring.moved(scoring.document_scores(scored(s, d).where("path <> 'tax_rate'")), scoring.document_scores(scored(s, d)))
QUERIES["AG-22_score_or_zero"] = lambda s, d: runs(s, d).select("doc_id", F.coalesce("em", F.lit(0.0)).alias("em"))


@query("JN-13_rescore")
def _(s, d):
    pinned, manifest = scoring.document_scores(scored(s, d)).where("doc_id % 3 <> 0"), view(s, d, "inv_docs").where("doc_id % 5 <> 0")
    return manifest.select("doc_id").join(pinned.select("doc_id", "em"), "doc_id").unionByName(pinned.join(manifest, "doc_id", "left_anti").select("doc_id", F.lit(-1.0).alias("em")))


# ---- voting and calls


def passes(s, d):
    return view(s, d, "passes").drop("n")


QUERIES["AG-14_vote"] = lambda s, d: voting.majority_vote(passes(s, d), ["doc_id", "pos"], "description", "pass").join(voting.median_vote(passes(s, d), ["doc_id", "pos"], "qty"), ["doc_id", "pos"])
QUERIES["AG-15_vote_items"] = lambda s, d: voting.vote_items(passes(s, d))

#: Dollars per 1000 tokens in and out, in ten-millionths.
RATES = {"gpt-5-nano": (500, 4000), "gpt-5-mini": (2500, 20000), "gpt-4.1-nano": (1000, 4000), "gpt-4.1-mini": (4000, 16000), "gpt-4o-mini": (1500, 6000)}


def costed(s, d):
    part = lambda i: reporting.named({k: str(v[i]) for k, v in RATES.items()}, F.col("model"), F.lit(str(RATES["gpt-5-nano"][i]))).cast("long")
    return view(s, d, "calls").withColumn("cost", F.col("tokens_in") * part(0) + F.col("tokens_out") * part(1))


QUERIES["AG-13_cost"] = lambda s, d: costed(s, d).select("event_id", "cost")
QUERIES["AG-12_calls"] = lambda s, d: costed(s, d).groupBy("model").agg(F.count("*").alias("calls"), F.count_if("success").alias("successes"), F.floor(F.sum(F.when(F.col("success"), F.col("elapsed_c"))) / F.greatest(F.count_if("success"), F.lit(1))).alias("avg_elapsed_c"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), F.sum("cost").alias("cost"))
QUERIES["AG-23_usage"] = lambda s, d: costed(s, d).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost"))

# ---- splits, sources, sinks


def splits(s, d):
    return src.split(view(s, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"])


QUERIES["WN-05_split"] = lambda s, d: splits(s, d).select("doc_id", "split")
QUERIES["AG-18_split_counts"] = lambda s, d: splits(s, d).groupBy("split", "lang").agg(F.count("*").alias("n"))
QUERIES["SRC-04_manifest"] = lambda s, d: view(s, d, "inv_docs").groupBy("doc_type").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("SRC-05_missing_truth")
def _(s, d):
    have, lack = src.ground_truth(view(s, d, "documents").select("doc_id"), view(s, d, "labels").select("doc_id", "quality"))
    return have.select("doc_id", F.lit(True).alias("scored")).unionByName(lack.select("doc_id", F.lit(False).alias("scored")))


@query("SNK-03_resume")
def _(s, d):
    done = view(s, d, "labels").select("doc_id", (F.col("doc_id") % 3).cast("int").alias("version"))
    return src.open_work(view(s, d, "documents").select("doc_id"), done, 1)


QUERIES["SO-05_limit"] = lambda s, d: view(s, d, "inv_docs").orderBy("doc_id").limit(25).select("doc_id", "doc_type")


@query("SRC-08_batch_extract")
def _(s, d):
    def client():
        def ask(kind: str, prompt: str) -> str:
            if kind == "receipt":
                raise ValueError("unreadable")
            return '{"doc_type": "' + kind + '"}'

        return ask

    return src.extract(src.with_prompt(view(s, d, "inv_docs").select("doc_id", "doc_type")), client)


QUERIES["SRC-09_prompts"] = lambda s, d: src.with_prompt(view(s, d, "inv_docs").select("doc_id", "doc_type"), "structured")


@query("SRC-14_generate")
def _(s, d):
    from veriledger.sources.synthetic import generate

    return rules.verify(generate(s, 500)).select("doc_id", "doc_type", "language", "valid", "critical", "warning")


# ---- reports


#: Places of problems: lines of pairs by line and field, then the header, then lone lines by pos.
FIELD_ORD = ("quantity", "unit_price", "total", "description")
HEAD_ORD, EXTRA_ORD, MISSING_ORD = 10**9, 2 * 10**9, 3 * 10**9


def problems(s, d):
    place = F.array_position(F.array(*map(F.lit, FIELD_ORD)), F.col("field")) - 1
    by_line = F.when(F.col("field") == "_extra_invoice_line", EXTRA_ORD + F.col("pos")).when(F.col("field") == "_missing_po_line", MISSING_ORD + F.col("pos")).otherwise(F.col("line") * 10 + place)
    said = F.when(F.col("line").isNull(), reporting.lone_line(F.col("field"), F.col("lone_description"))).otherwise("")
    found = matching.discrepancies(lines(s, d)).select("doc_id", by_line.alias("ord"), "field", "severity", said.alias("message"))
    head = scalars(s, d).where("severity <> 'ok'").select("doc_id", (HEAD_ORD + F.length("field")).cast("long").alias("ord"), "field", "severity", F.lit("").alias("message"))
    return reporting.match_problems(found.unionByName(head))


def with_order(s, d):
    """Findings of orders, in an order that follows from their values."""
    f = decision.with_flags(po_findings(s, d))
    return f.withColumn("ord", F.struct(F.coalesce("line", F.lit(HEAD_ORD)), "kind", "field", F.coalesce("expected", F.lit("")), F.coalesce("actual", F.lit(""))))


def verdicts(s, d):
    return reporting.match_verdict(match_summary(s, d))


QUERIES["RP-01_match_problems"] = problems
QUERIES["RP-01_match_verdict"] = verdicts
QUERIES["RP-03_chat"] = lambda s, d: reporting.chat_message(verdicts(s, d), problems(s, d))
QUERIES["SO-04_top_problems"] = lambda s, d: reporting.top_problems(problems(s, d)).select("doc_id", F.col("n").cast("long").alias("n"), "code", "level", "ord")
QUERIES["SO-02_problem_order"] = lambda s, d: reporting.ordered_problems(with_order(s, d)).select("doc_id", F.col("place").cast("long").alias("place"), "kind", "field", "severity", "amount_k", "line")


@query("RP-02_decision_text")
def _(s, d):
    f = with_order(s, d)
    return reporting.decision_texts(decision.decide(view(s, d, "inv_docs"), f.select(*decision.FINDING)), f, decision.coverage(_flat(s, d, "predicted")))


QUERIES["RP-04_json"] = lambda s, d: reporting.as_json(decision.decide(view(s, d, "inv_docs"), po_findings(s, d)).select("doc_id", "verdict", "financial_k"))
