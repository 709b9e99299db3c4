"""Orders against invoices, line by line and header by header."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriledger.functions.numbers import numeric_close
from veriledger.functions.similarity import similar_pairs, text_similarity
from veriledger.functions.text import normalise_currency, normalise_vendor

PRICE, QUANTITY, FUZZY, SAME_TEXT, SAME_PARTY = 0.02, 0.001, 0.65, 0.80, 0.70


def pair_by_sku(po: DataFrame, inv: DataFrame) -> DataFrame:
    """doc_id, po_pos, inv_pos: the k-th line of a SKU with the k-th of the same SKU."""

    def ranked(df: DataFrame, name: str) -> DataFrame:
        sku = F.lower(F.trim("sku"))
        k = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("pos"))
        return df.where(sku != "").withColumn("key", sku).select("doc_id", "key", k.alias("k"), F.col("pos").alias(name))

    return ranked(po, "po_pos").join(ranked(inv, "inv_pos"), ["doc_id", "key", "k"]).select("doc_id", "po_pos", "inv_pos")


def candidate_scores(po: DataFrame, inv: DataFrame) -> DataFrame:
    """Every pair of an order's and its invoice's lines with same_sku and sim; texts are compared
    once each."""
    text = lambda: F.lower(F.trim(F.coalesce("description", F.lit(""))))
    sku = lambda: F.lower(F.trim(F.coalesce("sku", F.lit(""))))
    a = po.select("doc_id", F.col("pos").alias("po_pos"), sku().alias("a_sku"), text().alias("a"))
    b = inv.select("doc_id", F.col("pos").alias("inv_pos"), sku().alias("b_sku"), text().alias("b"))
    pairs = similar_pairs(a.join(b, "doc_id"), "a", "b", "sim")
    sim = F.when((F.col("a") == "") | (F.col("b") == ""), 0.0).otherwise(F.col("sim"))
    return pairs.select("doc_id", "po_pos", "inv_pos", ((F.col("a_sku") == F.col("b_sku")) & (F.col("a_sku") != "")).alias("same_sku"), sim.alias("sim"))


def greedy_pairs(scores: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """doc_id, po_pos, inv_pos: each order line in turn takes the first unused line of its SKU, else
    the most similar unused one over the threshold (the first of equals). The order matters, so it
    is a fold over the lines of one document."""
    c = F.struct("po_pos", "inv_pos", "same_sku", "sim")
    lines = scores.groupBy("doc_id").agg(F.array_sort(F.collect_list(c)).alias("c"))
    lines = lines.withColumn("pos", F.array_sort(F.array_distinct(F.transform("c", lambda x: x["po_pos"]))))

    def step(done: Column, pos: Column) -> Column:
        free = F.filter("c", lambda x: (x["po_pos"] == pos) & ~F.exists(done, lambda d: d["inv_pos"] == x["inv_pos"]) & (x["same_sku"] | (x["sim"] > threshold)))
        rated = F.transform(free, lambda x: F.struct((~x["same_sku"]).alias("s"), F.when(x["same_sku"], 0.0).otherwise(-x["sim"]).alias("r"), x["inv_pos"].alias("inv_pos")))
        best = F.array_min(rated)
        return F.when(F.size(free) == 0, done).otherwise(F.concat(done, F.array(F.struct(pos.alias("po_pos"), best["inv_pos"].alias("inv_pos")))))

    none = F.array().cast("array<struct<po_pos:bigint,inv_pos:bigint>>")
    return lines.select("doc_id", F.explode(F.aggregate("pos", none, step)).alias("m")).select("doc_id", "m.*")


def first_fit(po: list[dict], inv: list[dict], threshold: float = FUZZY) -> list[tuple[int, int]]:
    """(order line, invoice line) in order of the order's lines: each takes the first unused line of
    its SKU, else the unused line whose description is most like its own, if over the threshold."""
    free, by_sku, out = dict.fromkeys(range(len(inv))), defaultdict(list), []
    key = lambda x: (x["sku"] or "").strip().lower()
    text = lambda x: (x["description"] or "").strip().lower()
    for j, x in reversed(list(enumerate(inv))):
        by_sku[key(x)].append(j)
    for i, x in enumerate(po):
        best, at = threshold, None
        same = by_sku[key(x)] if key(x) else []
        while same and same[-1] not in free:
            same.pop()
        if same:
            at = same.pop()
        elif a := text(x):
            matcher = SequenceMatcher(None, a, "")
            for j in free:
                if not (b := text(inv[j])) or 2 * min(len(a), len(b)) <= best * (len(a) + len(b)):
                    continue
                if a == b:
                    ratio = 1.0
                else:
                    matcher = SequenceMatcher(None, a, b)
                    ratio = matcher.ratio() if matcher.quick_ratio() > best else 0.0
                if ratio > best:
                    best, at = ratio, j
                    if ratio == 1.0:
                        break
        if at is not None:
            del free[at]
            out.append((i, at))
    return out


LINE = ("pos", "sku", "qty", "price_k", "total_k", "description")


def match_lines(po: DataFrame, inv: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """One row per pair or lone line of each document: doc_id, side ('pair', 'po' or 'inv'), line
    (number of the pair from 0), po_ and inv_ pos, sku, qty, price_k, total_k, description, and sim,
    the likeness of a pair's descriptions. Lines of both sides meet in one row of their document, the
    only shuffle; a document has as many rows as it has lines."""
    side = lambda df, s: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*LINE))).alias(s))
    docs = side(po, "po").join(side(inv, "inv"), "doc_id", "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for k, (a, b) in enumerate(zip(batch.column("po").to_pylist(), batch.column("inv").to_pylist(), strict=True)):
                a, b = a or [], b or []
                pairs = first_fit(a, b, threshold)
                x, y = {i for i, _ in pairs}, {j for _, j in pairs}
                rows = [("pair", n, i, j, _alike(a[i]["description"], b[j]["description"])) for n, (i, j) in enumerate(pairs)]
                rows += [("po", None, i, None, None) for i in range(len(a)) if i not in x] + [("inv", None, None, j, None) for j in range(len(b)) if j not in y]
                ids += [k] * len(rows)
                found += rows
            made = [pa.array([r[c] for r in found], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))]
            taken = batch.take(pa.array(ids, pa.int64()))
            lines = [_rows_at(taken.column(s), made[c]) for s, c in (("po", 2), ("inv", 3))]
            yield pa.RecordBatch.from_arrays([taken.column("doc_id"), made[0], made[1], *lines, made[4]], ["doc_id", "side", "line", "po", "inv", "sim"])

    item = lambda df, s: df.schema[s].dataType.elementType.simpleString()
    out = docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, side string, line long, po {item(docs, 'po')}, inv {item(docs, 'inv')}, sim double")
    return out.select("doc_id", "side", "line", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("po", "inv") for c in LINE], "sim")


def _rows_at(lists: pa.Array, place: pa.Array) -> pa.Array:
    """The element at a place of each list, null where there is none."""
    values = lists.values
    first = pa.array(lists.offsets.to_numpy()[:-1], pa.int64())
    return values.take(pa.compute.add(first, place.cast(pa.int64())))


def _alike(a: str | None, b: str | None) -> float:
    x, y = (str(t).strip().lower() for t in (a, b))  # a missing text reads `none`
    return 0.0 if not x or not y else 1.0 if x == y else SequenceMatcher(None, x, y).ratio()


def unmatched(lines: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """lines of one side ('po' or 'inv') that no pair has."""
    return lines.join(pairs.select("doc_id", F.col(f"{side}_pos").alias("pos")), ["doc_id", "pos"], "left_anti")


def paired(po: DataFrame, inv: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, line (order of the pairs, from 0) and both sides' values, po_ and inv_."""
    side = lambda df, s: df.select("doc_id", F.col("pos").alias(f"{s}_pos"), *[F.col(c).alias(f"{s}_{c}") for c in ("sku", "qty", "price_k", "total_k")])
    line = F.row_number().over(Window.partitionBy("doc_id").orderBy("po_pos")) - 1
    return pairs.join(side(po, "po"), ["doc_id", "po_pos"]).join(side(inv, "inv"), ["doc_id", "inv_pos"]).withColumn("line", line.cast("long"))


def discrepancies(both: DataFrame) -> DataFrame:
    """doc_id, line, field, po_value, inv_value, severity, diff_bp (hundredths of a per cent of the
    order's value): quantities, prices and totals that aren't close, or that one side lacks, and,
    where pairs have sim, descriptions under 80 % alike. Rows of match_lines that are lone become one
    row, _extra_invoice_line or _missing_po_line, with its pos and lone_description."""

    def of(field: str, column: str, tolerance: float, severity: str) -> Column:
        a, b = F.col(f"po_{column}"), F.col(f"inv_{column}")
        lone = a.isNull() != b.isNull()
        far = a.isNotNull() & b.isNotNull() & ~numeric_close(a.cast("double"), b.cast("double"), tolerance)
        bp = F.floor((F.abs(a - b) * 20000 + F.greatest(F.abs(a), F.lit(1))) / (2 * F.greatest(F.abs(a), F.lit(1))))
        return F.when(lone | far, F.struct(F.lit(field).alias("field"), a.alias("po_value"), b.alias("inv_value"), F.when(lone, "warning").otherwise(severity).alias("severity"), F.when(far, bp).alias("diff_bp")))

    found = F.array(of("quantity", "qty", QUANTITY, "critical"), of("unit_price", "price_k", PRICE, "critical"), of("total", "total_k", PRICE, "warning"))
    carried = ["doc_id", "line", "po_qty", "inv_qty", "po_price_k", "inv_price_k"]
    if "side" in both.columns:
        null, like = F.lit(None).cast("long"), found[0]
        one = lambda field, severity, value: F.struct(F.lit(field).alias("field"), F.when(F.col("side") == "po", value).alias("po_value"), F.when(F.col("side") == "inv", value).alias("inv_value"), F.lit(severity).alias("severity"), null.alias("diff_bp")).cast(_type_of(both, like))
        text = F.when(F.col("sim") < SAME_TEXT, one("description", "warning", null))
        lone = F.when(F.col("side") == "po", one("_missing_po_line", "warning", F.col("po_total_k"))).otherwise(one("_extra_invoice_line", "critical", F.col("inv_total_k")))
        found = F.when(F.col("side") == "pair", F.concat(found, F.array(text))).otherwise(F.array(lone))
        carried += ["po_sku", "inv_sku", F.coalesce("po_pos", "inv_pos").alias("pos"), F.when(F.col("side") == "po", F.col("po_description")).when(F.col("side") == "inv", F.col("inv_description")).alias("lone_description")]
    return both.select(*carried, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("d")).select("*", "d.*").drop("d")


def _type_of(df: DataFrame, c: Column):
    return df.select(c.alias("x")).schema["x"].dataType


def description_issues(pairs: DataFrame) -> DataFrame:
    """Pairs (doc_id, line, a, b) whose texts are less than 80 % alike; a missing text reads `none`."""
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("None"))))
    scored = pairs.withColumn("sim", F.when((text("a") == "") | (text("b") == ""), 0.0).otherwise(text_similarity(text("a"), text("b"))))
    return scored.where(F.col("sim") < SAME_TEXT).select("doc_id", "line", F.lit("description").alias("field"), F.lit("warning").alias("severity"), F.round("sim", 3).alias("similarity"))


def match_score(sim: Column, po_qty: Column, inv_qty: Column) -> Column:
    """Text and quantity, half each; a quantity that is off still counts half."""
    return F.round((sim + F.when(numeric_close(po_qty, inv_qty, QUANTITY), 1.0).otherwise(0.5)) / 2, 4)


def scalar_checks(po: DataFrame, inv: DataFrame) -> DataFrame:
    """doc_id, field, matched, severity: totals (net or gross within 2 %, never critical),
    currencies under their aliases and, where both sides have a column party, the names of supplier
    and vendor. Checks need both sides."""
    named = "party" in po.columns and "party" in inv.columns
    party = lambda s: [normalise_vendor(F.nullif("party", F.lit(""))).alias(s)] if named else []
    a = po.select("doc_id", F.col("amount_k").alias("a_total"), F.upper(F.trim("currency")).alias("a_cur"), *party("a_party"))
    b = inv.select("doc_id", F.col("amount_k").alias("b_total"), F.col("sub_k").alias("b_sub"), F.upper(F.trim("currency")).alias("b_cur"), *party("b_party"))
    near = lambda x: numeric_close(F.col("a_total").cast("double"), F.col(x).cast("double"), PRICE)
    total, cur = near("b_total") | near("b_sub"), normalise_currency(F.col("a_cur")) == normalise_currency(F.col("b_cur"))
    check = lambda f, ok, bad: F.struct(F.lit(f).alias("field"), ok.alias("matched"), F.when(ok, "ok").otherwise(bad).alias("severity"))
    found = [F.when(F.col("a_total").isNotNull() & F.col("b_total").isNotNull(), check("total_amount", total, "warning")), F.when((F.col("a_cur") != "") & (F.col("b_cur") != ""), check("currency", cur, "critical"))]
    both = a.join(b, "doc_id")
    if named:
        both = both.withColumn("alike", text_similarity(F.col("a_party"), F.col("b_party")))
        found.append(F.when(F.col("alike").isNotNull(), check("supplier_vendor", F.col("alike") >= SAME_PARTY, "warning")))
    return both.select("doc_id", "a_total", "b_total", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("c")).select("doc_id", "c.*", "a_total", "b_total")


def supplier_check(pairs: DataFrame) -> DataFrame:
    """doc_id, similarity, matched of two parties' names (a, b) under the vendor's normal form."""
    named = pairs.where("a <> '' and b <> ''").withColumns({"x": normalise_vendor(F.col("a")), "y": normalise_vendor(F.col("b"))})
    scored = similar_pairs(named, "x", "y", "sim")
    return scored.select("doc_id", F.round("sim", 3).alias("similarity"), (F.col("sim") >= SAME_PARTY).alias("matched"))


def summary(docs: DataFrame, lines: DataFrame, scalars: DataFrame) -> DataFrame:
    """doc_id, counts, match_rate in hundredths of a per cent, overall_status, from match_lines()
    and scalar_checks()."""
    found = discrepancies(lines).where(~F.col("field").startswith("_")).groupBy("doc_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    n = lines.groupBy("doc_id").agg(*[F.count_if(F.col("side") == s).alias(c) for s, c in (("pair", "matched"), ("po", "unmatched_po"), ("inv", "unmatched_inv"))])
    head = scalars.groupBy("doc_id").agg(F.count_if(F.col("severity") == "critical").alias("sc"), F.count_if(F.col("severity") == "warning").alias("sw"))
    out = docs.select("doc_id").join(n, "doc_id", "left").join(found, "doc_id", "left").join(head, "doc_id", "left").fillna(0)
    out = out.withColumns({"critical": F.col("critical") + F.col("sc"), "warnings": F.col("warnings") + F.col("sw")}).drop("sc", "sw")
    of = F.greatest(F.col("matched") + F.col("unmatched_po"), F.lit(1))
    status = F.when(F.col("critical") > 0, "REJECT").when(F.col("warnings") + F.col("unmatched_po") + F.col("unmatched_inv") > 0, "REVIEW").otherwise("APPROVE")
    return out.withColumns({"match_rate_bp": F.floor((F.col("matched") * 20000 + of) / (2 * of)), "overall_status": status})


def goods_receipts(invoice: DataFrame, receipts: DataFrame) -> DataFrame:
    """Third leg, an extension: doc_id, sku, rule where more is invoiced than received (critical),
    less was received than ordered (warning), or goods came after the invoice (warning). Lines
    without a receipt count as received 0."""
    got = receipts.groupBy("doc_id", "sku").agg(F.sum("received").alias("received"), F.max("posted").alias("posted"))
    both = invoice.join(got, ["doc_id", "sku"], "left").withColumn("received", F.coalesce("received", F.lit(0)))
    rule = lambda r, s: F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))
    found = F.array(F.when(F.col("qty") > F.col("received"), rule("invoiced_over_received", "critical")), F.when(F.col("received") < F.col("ordered"), rule("received_under_ordered", "warning")), F.when(F.col("posted") > F.col("invoice_date"), rule("received_after_invoice", "warning")))
    return both.select("doc_id", "sku", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("r")).select("doc_id", "sku", "r.*")
