"""Fractions of quantities, figures that aren't numbers, all tax numbers, and lines paired in order."""

import json
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from veriledger.operators import matching, repair, rules
from veriledger.sources import documents as src


def read(spark, tmp_path, *docs):
    for i, d in enumerate(docs):
        (tmp_path / f"d{i}.json").write_text(json.dumps({"doc_id": f"d{i}", "language": "tr", "invoice_number": "A1", "date": "2026-01-02", "vendor_name": "V", "currency": "USD"} | d))
    return src.typed(src.read_documents(spark, str(tmp_path)))


def found(df):
    return {(r["doc_id"], r["rule"], r["field"]) for r in rules.issues(rules.verify(df)).collect()}


def test_fractional_quantity_is_kept(spark, tmp_path):
    item = {"sku": "S", "description": "x", "quantity": 2.5, "unit_price": 10.00, "total": 25.00}
    docs = read(spark, tmp_path, {"doc_type": "invoice", "items": [item], "subtotal": 25, "tax_amount": 5, "total_amount": 30}, {"doc_type": "invoice", "items": [item | {"total": 24}], "subtotal": 24, "tax_amount": 5, "total_amount": 29})
    assert found(docs) == {("d1", "item_total_mismatch", "items[0].total")}


def test_what_is_not_a_number_is_told_and_kept(spark, tmp_path):
    item = {"quantity": 1, "unit_price": 10, "total": 10}
    docs = read(spark, tmp_path, {"doc_type": "invoice", "items": [item], "subtotal": 10, "tax_amount": "n/a", "total_amount": "oops"}, {"doc_type": "receipt", "receipt_number": "R", "store_name": "S", "items": [item], "subtotal": 10, "tax_amount": 0, "total_amount": 10, "change_amount": -1})
    assert found(docs) == {("d0", "numeric_invalid", "tax_amount"), ("d0", "numeric_invalid", "total_amount"), ("d1", "negative_amount", "change_amount")}
    repaired = {r["doc_id"]: r["amount_k"] for r in repair.repair_arithmetic(docs).collect()}
    assert repaired == {"d0": None, "d1": 1000}


def test_every_date_and_tax_number_is_judged(spark, tmp_path):
    item = {"quantity": 1, "unit_price": 10, "total": 10}
    whole = {"items": [item], "subtotal": 10, "tax_amount": 2, "total_amount": 12}
    docs = read(spark, tmp_path, whole | {"doc_type": "invoice", "due_date": "31/12/2026", "delivery_date": "2026-02-30", "vendor_tax_id": "1234567890", "buyer_tax_id": "1234567891", "tax_id": "DE1"}, whole | {"doc_type": "po", "po_number": "P", "supplier_name": "S", "supplier_tax_id": "1234567891", "total_amount": 10})
    assert found(docs) == {
        ("d0", "date_format_invalid", "due_date"), ("d0", "date_invalid", "delivery_date"), ("d0", "tax_id_checksum_invalid", "buyer_tax_id"), ("d0", "tax_id_unverifiable", "tax_id"), ("d1", "tax_id_checksum_invalid", "supplier_tax_id"),
    }


LINE = st.tuples(st.sampled_from([None, "", "a1", "A1 ", "b2"]), st.sampled_from([None, "", "blue paint 5 l", "Blue Paint 5l", "red paint 5 l", "nails"]))


@settings(max_examples=200, deadline=None)
@given(st.lists(LINE, max_size=6), st.lists(LINE, max_size=6))
def test_lines_pair_in_the_orders_order(a, b):
    po, inv = ([{"sku": s, "description": d} for s, d in x] for x in (a, b))
    tidy, used, want = (lambda t: (t or "").strip().lower()), set(), []
    for i, x in enumerate(po):
        free = [j for j in range(len(inv)) if j not in used]
        at = next((j for j in free if tidy(x["sku"]) and tidy(inv[j]["sku"]) == tidy(x["sku"])), None)
        if at is None:
            like = [(SequenceMatcher(None, tidy(x["description"]), tidy(inv[j]["description"])).ratio() if tidy(x["description"]) and tidy(inv[j]["description"]) else 0.0, -j) for j in free]
            if like and max(like)[0] > 0.65:
                at = -max(like)[1]
        if at is not None:
            used.add(at)
            want.append((i, at))
    assert matching.first_fit(po, inv) == want


def test_lone_lines_and_pairs(spark):
    schema = "doc_id long, pos long, sku string, qty long, price_k long, total_k long, description string"
    po = spark.createDataFrame([(1, 0, "a", 1, 100, 100, "paint"), (1, 1, None, 2, 100, 200, "long nails"), (2, 0, "x", 1, 1, 1, None)], schema)
    inv = spark.createDataFrame([(1, 0, None, 2, 100, 200, "long nail"), (1, 1, "A", 1, 150, 150, "brush"), (3, 0, "y", 1, 1, 1, None)], schema)
    rows = matching.match_lines(po, inv).collect()
    assert {(r["doc_id"], r["side"], r["line"], r["po_pos"], r["inv_pos"]) for r in rows} == {(1, "pair", 0, 0, 1), (1, "pair", 1, 1, 0), (2, "po", None, 0, None), (3, "inv", None, None, 0)}
    fields = {(r["doc_id"], r["line"], r["field"]) for r in matching.discrepancies(matching.match_lines(po, inv)).collect()}
    assert fields == {(1, 0, "unit_price"), (1, 0, "total"), (1, 0, "description"), (2, None, "_missing_po_line"), (3, None, "_extra_invoice_line")}
    assert matching.match_lines(po.where("false"), inv.where("false")).collect() == []


def test_an_answer_without_an_object_is_asked_again(spark):
    def clients():
        return [lambda kind, prompt: "no idea", lambda kind, prompt: '{"doc_type": "' + kind + '"}']

    docs = spark.createDataFrame([(1, "po", "p")], "doc_id long, doc_type string, prompt string")
    assert [(r["response"], r["error"]) for r in src.extract(docs, clients).collect()] == [('{"doc_type": "po"}', None)]


def test_files_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i, "po" if i % 2 else "invoice", "en") for i in range(20)], "doc_id long, doc_type string, language string")
    split = src.split(docs, ["doc_type"])
    src.write_splits(split, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s/documents")).count() == 20
    assert {(r["split"], r["doc_type"]): r["n"] for r in spark.read.json(str(tmp_path / "s/summary")).collect()} == {(r["split"], r["doc_type"]): r["count"] for r in split.groupBy("split", "doc_type").count().collect()}
    src.write_dataset(docs, docs.groupBy("language").count(), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d/dataset")).count() == 20 and spark.read.json(str(tmp_path / "d/quality")).count() == 1
    (tmp_path / "m.json").write_text(json.dumps([{"doc_id": "a", "doc_type": "po", "pdf": "a.pdf", "json": "a.json"}]))
    assert [r["doc_id"] for r in src.read_manifest(spark, str(tmp_path / "m.json")).collect()] == ["a"]
    src.write_results(docs, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 20
    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.pdf").write_bytes(b"x")
    assert [bytes(r["image"]) for r in src.read_images(spark, str(tmp_path / "img"), lambda b: b + b"!").collect()] == [b"x!"]
