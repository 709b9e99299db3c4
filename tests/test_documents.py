"""Rules, repair, matching, ledger, decision, scoring and voting on small documents."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veriledger.operators import decision, ledger, matching, repair, reporting, rules, scoring, validate, voting

ITEM = "struct<pos:bigint,sku:string,qty:bigint,price_k:bigint,disc_k:bigint,total_k:bigint>"
DOC = f"doc_id long, doc_type string, number string, date_text string, party string, tax_id string, currency string, sub_k long, tax_k long, amount_k long, items array<{ITEM}>"


def doc(i=1, kind="invoice", items=((0, "A", 2, 10000, None, 20000), (1, "B", 1, 5000, None, 5000)), sub=25000, tax=4500, total=29500, tax_id="1234567890", currency="TRY", date="2026-08-15", number="N1", party="P"):
    return (i, kind, number, date, party, tax_id, currency, sub, tax, total, list(items))


def found(spark, *docs):
    return {(r["doc_id"], r["rule"], r["field"]) for r in rules.issues(rules.verify(spark.createDataFrame(docs, DOC))).collect()}


def test_clean_documents_have_no_issue(spark):
    po = doc(2, "po", sub=None, tax=None, total=25000, tax_id=None)
    assert found(spark, doc(), po, doc(3, "receipt")) == set()
    report = rules.verify(spark.createDataFrame([doc()], DOC)).first()
    assert report["valid"] and report["score"] == 1.0


def test_broken_arithmetic(spark):
    bad = doc(1, items=[(0, "A", 2, 10000, None, 20003), (1, "B", 1, 5000, 500, 4500)], sub=25000, total=29600)
    assert found(spark, bad) == {(1, "item_total_mismatch", "items[0].total"), (1, "subtotal_mismatch", "subtotal"), (1, "total_mismatch", "total_amount")}
    po = doc(2, "po", items=[(0, "A", 1, 1000, 100, 900)], sub=None, tax=None, total=1000, tax_id=None)
    assert found(spark, po) == {(2, "item_total_mismatch", "items[0].total"), (2, "total_mismatch", "total_amount")}
    assert found(spark, doc(3, items=[(0, "A", 1, 1000, -5, 1005)], sub=1005, tax=0, total=1005)) == {(3, "negative_discount", "items[0].discount")}


def test_fields_dates_and_tax_numbers(spark):
    assert found(spark, doc(1, items=[], number="", party=None, sub=None, tax=None, total=None)) == {(1, "required_field_missing", f) for f in ("invoice_number", "vendor_name", "items", "total_amount")}
    assert found(spark, doc(1, date="15.08.2026"), doc(2, date="2026-02-30"), doc(3, date="1999-01-01")) == {(1, "date_format_invalid", "date"), (2, "date_invalid", "date"), (3, "date_implausible", "date")}
    assert found(spark, doc(1, tax_id="1234576890"), doc(2, tax_id="TR TIN 12345678950"), doc(3, tax_id="701236788"), doc(4, tax_id=" "), doc(5, tax_id=None, currency="USD")) == {
        (1, "tax_id_checksum_invalid", "vendor_tax_id"), (2, "tax_id_label_captured", "vendor_tax_id"), (3, "tax_id_unverifiable", "vendor_tax_id"), (4, "seller_tax_id_missing", "vendor_tax_id"),
    }
    assert found(spark, doc(1, tax=20000, total=45000), doc(2, sub=25000, tax=-1, total=24999)) == {(1, "tax_rate_implausible", "tax_amount"), (2, "negative_amount", "tax_amount")}


def test_validation_stops_at_missing_fields(spark):
    df = spark.createDataFrame([doc(1, number="", date="x"), doc(2, currency="CHF"), doc(3)], DOC).withColumn("language", F.lit("tr"))
    out = {r["doc_id"]: r["errors"] for r in validate.validate(df).collect()}
    assert out == {1: ["missing:invoice_number"], 2: ["currency:unknown"], 3: []}


def test_repair_fills_only_what_is_missing(spark):
    gaps = doc(1, items=[(0, "A", 2, 10000, 500, None), (1, "B", 1, 1, None, 77)], sub=None, tax=100, total=None)
    out = repair.repair_arithmetic(spark.createDataFrame([gaps, doc(2, total=1)], DOC)).orderBy("doc_id").collect()
    assert [i["total_k"] for i in out[0]["items"]] == [19500, 77] and (out[0]["sub_k"], out[0]["amount_k"]) == (19577, 19677)
    assert out[1]["amount_k"] == 1


def test_corrections_need_permission(spark):
    flat = spark.createDataFrame([(1, "a", "1"), (1, "b", "2")], "doc_id long, path string, value string")
    new = spark.createDataFrame([(1, "a", "9"), (1, "b", "8"), (1, "c", None)], "doc_id long, path string, value string")
    merged, refused = repair.merge_allowed(flat, new, spark.createDataFrame([(1, "a"), (1, "c")], "doc_id long, path string"))
    assert {(r["path"], r["value"]) for r in merged.collect()} == {("a", "9"), ("b", "2")} and [r["path"] for r in refused.collect()] == ["b"]
    assert [r["path"] for r in repair.changed_fields(flat, merged).collect()] == ["a"]


LEDGER = "row_id long, supplier string, doc_number string, issue_date date, amount_key long, channel string"
INCOMING = "doc_id long, supplier string, doc_number string, issue_date date, amount_key long, channel string"
DAY = dt.date


def verdict(spark, old, new):
    docs, mem = spark.createDataFrame([(1, *new)], INCOMING), spark.createDataFrame([(i, *o) for i, o in enumerate(old)], LEDGER)
    hits = ledger.damped(ledger.matches(docs, mem), docs, mem)
    return ledger.document_risk(docs, hits).first()["risk"], decision.decide(docs, ledger.to_findings(hits)).first()["verdict"]


def test_retyped_numbers_hold_payment(spark):
    old = ("s", "GIB2026000012345", DAY(2026, 8, 1), 4200000, "efatura")
    assert verdict(spark, [old], ("s", "GIB-12345", DAY(2026, 12, 1), 4200000, "email_pdf")) == ("HIGH", "HOLD")
    assert verdict(spark, [old], ("s", " gib-2026/000012345 ", DAY(2026, 12, 1), 1, "email_pdf")) == ("HIGH", "HOLD")
    assert verdict(spark, [old], ("s", "GIB-12345", DAY(2026, 12, 1), 7, "email_pdf")) == ("LOW", "PAY")
    assert verdict(spark, [old], ("t", "GIB-12345", DAY(2026, 8, 1), 4200000, "email_pdf")) == ("LOW", "PAY")
    assert verdict(spark, [old], ("s", "A-9", DAY(2026, 8, 9), 4200000, "email_pdf")) == ("MEDIUM", "PAY")
    assert verdict(spark, [old], ("s", "A-9", DAY(2026, 9, 9), 4200000, "email_pdf")) == ("LOW", "PAY")


def test_subscriptions_are_expected(spark):
    months = [("s", f"M{i}", DAY(2026, 4 + i, 13), 2400, "photo") for i in range(3)]
    docs = spark.createDataFrame([(1, "s", "Z", DAY(2026, 7, 13), 2400, "photo")], INCOMING)
    for n, want in ((3, "LOW"), (2, "MEDIUM")):
        mem = spark.createDataFrame([(i, *m) for i, m in enumerate(months[3 - n :])], LEDGER)
        assert {r["risk"] for r in ledger.damped(ledger.matches(docs, mem, 35), docs, mem).collect()} == {want}


def test_recorded_rows_continue_the_numbering(spark):
    mem = spark.createDataFrame([(41, "s", "a", None, 1, "x")], LEDGER)
    docs = spark.createDataFrame([(i, "s", f"n{i}", None, i, "x") for i in range(50, 0, -1)], INCOMING)
    assert [(r["doc_id"], r["row_id"]) for r in ledger.record(docs, mem).orderBy("doc_id").collect()] == [(i, 41 + i) for i in range(1, 51)]


def test_numbering_does_not_depend_on_partitions(spark):
    # wide rows are dealt to more partitions than the ids alone, which lost rows
    docs = spark.range(0, 40_000, 1, 8).select(F.xxhash64("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 8).alias("supplier"))
    mem = spark.createDataFrame([(41, "s", "a", None, 1, "x")], LEDGER)
    tight = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k, None) for k in tight}
    try:
        for k, v in tight.items():
            spark.conf.set(k, v)
        out = [r["row_id"] for r in ledger.record(docs, mem).select("doc_id", "row_id").orderBy("doc_id").collect()]
        with_rows = [tuple(r) for r in ledger.record(docs, mem).select("doc_id", "row_id", F.length("supplier")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert out == list(range(42, 40_042)) and [x[1] for x in sorted(with_rows)] == out
    some = spark.createDataFrame([("b",), (None,), ("a",), ("é",)], "doc_id string")
    assert {r["doc_id"]: r["row_id"] for r in ledger.record(some, mem).collect()} == {"a": 42, "b": 43, "é": 44, None: 45}
    assert ledger.record(some.limit(0), mem).count() == 0


LINE = "doc_id long, pos long, sku string, qty long, price_k long, total_k long, description string"


def line(d, p, sku, qty=1, price=1000, total=None, text="thing"):
    return (d, p, sku, qty, price, total if total is not None else qty * price, text)


def test_lines_are_paired_in_order(spark):
    po = spark.createDataFrame([line(1, 0, None, text="blue pen box"), line(1, 1, "S2"), line(1, 2, "S2"), line(1, 3, "S9")], LINE)
    inv = spark.createDataFrame([line(1, 0, "s2", text="blue pen box"), line(1, 1, "S2"), line(1, 2, "S3", text="other goods entirely")], LINE)
    assert {(r["po_pos"], r["inv_pos"]) for r in matching.pair_by_sku(po, inv).collect()} == {(1, 0), (2, 1)}
    greedy = matching.greedy_pairs(matching.candidate_scores(po, inv)).collect()
    assert {(r["po_pos"], r["inv_pos"]) for r in greedy} == {(0, 0), (1, 1)}  # the text took the line of the SKU


def test_price_gap_counts_once(spark):
    po, inv = spark.createDataFrame([line(1, 0, "S", 100, 5000)], LINE), spark.createDataFrame([line(1, 0, "S", 100, 5340)], LINE)
    pairs = matching.pair_by_sku(po, inv)
    found = matching.discrepancies(matching.paired(po, inv, pairs))
    assert {(r["field"], r["severity"]) for r in found.collect()} == {("unit_price", "critical"), ("total", "warning")}
    docs = spark.createDataFrame([(1, 600000, "TRY", 600000)], "doc_id long, amount_k long, currency string, sub_k long")
    high = docs.withColumn("amount_k", F.lit(740800)).withColumn("sub_k", F.lit(740800))
    f = decision.from_discrepancies(found).unionByName(decision.from_scalars(matching.scalar_checks(docs, high)))
    out = decision.decide(docs, f).first()
    assert (out["verdict"], out["financial_k"]) == ("HOLD", 34000)
    text = reporting.decision_texts(decision.decide(docs, f), decision.with_flags(f).withColumn("ord", F.lit(0))).first()
    assert text["impact"] == "340,00 TL" and "Fiyat Farkı" in text["text"]


def test_one_page_never_holds(spark):
    bad = rules.issues(rules.verify(spark.createDataFrame([doc(1, sub=61543, tax=0, total=113200)], DOC)))
    out = decision.decide(spark.createDataFrame([(1,)], "doc_id long"), decision.from_verification(bad)).first()
    assert out["verdict"] == "REVIEW" and out["financial_k"] == 0 and out["internal_k"] != 0


def test_scores_money_to_the_kurus(spark):
    rows = [(1, "total_amount", "615.43", "615.50"), (1, "tax_rate", "0.2", "0.2005"), (1, "quantity", "100", "100.5"), (1, "vendor_name", "A  b", "a B"), (1, "receipt_number", "1", "2")]
    truth, pred = spark.createDataFrame([r[:3] for r in rows], "doc_id long, path string, truth string"), spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "doc_id long, path string, predicted string")
    out = {r["path"]: r["em"] for r in scoring.field_scores(scoring.joined_fields(truth, pred)).collect()}
    assert out == {"total_amount": 0.0, "tax_rate": 1.0, "quantity": 1.0, "vendor_name": 1.0}


def test_alignment_takes_the_best_pairs_first(spark):
    sims = [(1, 0, 0, 0.9), (1, 0, 1, 1.0), (1, 1, 0, 0.2), (1, 1, 1, 0.95)]
    out = scoring.align_items(spark.createDataFrame(sims, "doc_id long, i long, j long, sim double")).collect()
    assert {(r["i"], r["j"], r["ord"]) for r in out} == {(0, 1, 0), (1, 0, 1)}


def test_votes(spark):
    rows = [(1, 0, 0, 5, 10, "b"), (1, 0, 1, 7, 10, "A "), (1, 0, 2, 6, 12, "a")]
    df = spark.createDataFrame(rows, "doc_id long, pos long, pass int, qty long, price_k long, description string")
    assert tuple(voting.vote_items(df).first()) == (1, 0, 6, 10, "b")
    assert voting.majority_vote(df, ["doc_id"], "description", "pass").first()["description"] == "A "


def test_failed_documents_stay_in_the_denominator(spark):
    rows = spark.createDataFrame([(1, "invoice", "OK", 1.0, 1.0), (2, "invoice", "REVIEW", None, None)], "doc_id long, doc_type string, verdict string, em double, f1 double")
    out = {r["block"]: (r["documents"], r["em"]) for r in scoring.aggregate_run(rows).collect()}
    assert out == {"overall": (2, 0.5), "ok_only": (1, 1.0), "type:invoice": (2, 0.5)}


def test_sources(spark, tmp_path):
    import json

    from veriledger.sources import documents as src
    from veriledger.sources.synthetic import generate

    body = {"doc_id": "d1", "doc_type": "invoice", "invoice_number": "N", "date": "2026-01-02", "vendor_name": "V", "items": [{"description": "x", "quantity": "2", "unit_price": "1,000.5", "total": "2001"}], "total_amount": "oops"}
    (tmp_path / "a.json").write_text(json.dumps(body))
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "b.json").write_text("{}")
    paired, alone = src.paired_files(spark, str(tmp_path))
    assert [r[0] for r in paired.collect()] == ["a"] and [r[0] for r in alone.collect()] == ["b"]
    got = src.typed(src.read_documents(spark, f"{tmp_path}/a.json")).first()
    assert got["amount_k"] is None and got["items"][0]["price_k"] == 100050
    assert rules.verify(generate(spark, 200)).where("not valid").count() == 0
    with pytest.raises(ValueError):
        src.with_prompt(generate(spark, 1), "unknown")


def test_stream_checks_each_batch_against_those_before(spark, tmp_path):
    from veriledger.streaming.ledger import check_stream

    led, inc, out = (f"{tmp_path}/{x}" for x in ("ledger", "in", "out"))
    spark.createDataFrame([(1, "s", "GIB2026000012345", DAY(2026, 8, 1), 4200000, "efatura", -1)], LEDGER + ", batch int").write.parquet(f"{led}/b0start")
    spark.createDataFrame([(7, "s", "GIB-12345", DAY(2026, 9, 1), 4200000, "photo"), (8, "s", "Q-1", DAY(2026, 9, 1), 5, "photo")], INCOMING).write.parquet(inc)
    check_stream(spark.readStream.schema(INCOMING).parquet(inc), led, out, f"{tmp_path}/cp").awaitTermination()
    assert {(r["doc_id"], r["risk"]) for r in spark.read.parquet(out).collect()} == {(7, "HIGH"), (8, "LOW")}
    assert spark.read.parquet(f"{led}/*").count() == 3
