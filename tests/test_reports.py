"""Texts of reports and decisions, likeness in scores, composed letters, and files written and read."""

import json
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from veriledger.functions.text import compose, normalise_doc_number, normalise_name
from veriledger.operators import decision, reporting, rules, scoring
from veriledger.sources import documents as src


def column(spark, c, texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(c).collect()]


def test_decomposed_letters_give_the_same_keys(spark):
    texts = ["ŞİŞECAM A.Ş.", "Öz Çığır Gıda", "Müller Straße", "Ελλάδος ύψος", "Ǟ ǟ ế", "plain 1", "", "🙂é", "a\nb́"]
    apart = [unicodedata.normalize("NFD", t) for t in texts]
    want = [unicodedata.normalize("NFC", t) for t in texts]
    assert column(spark, compose(F.col("x")), [*apart, None]) == [*want, None]
    assert column(spark, compose(F.col("x")), want) == want
    assert column(spark, normalise_name(F.col("x")), apart) == column(spark, normalise_name(F.col("x")), texts)
    assert column(spark, normalise_doc_number(F.col("x")), apart) == column(spark, normalise_doc_number(F.col("x")), texts)


def ratio(p, g):
    p, g = (" ".join((t or "").lower().split()) for t in (p, g))
    return (1.0 if not p else 0.0) if not g else SequenceMatcher(None, p, g).ratio()


def test_scores_with_likeness_against_a_plain_version(spark):
    rows = [(d, f, t, p) for d in (1, 2, 3) for f, t, p in (("vendor_name", "Acme Tools", f"Acme Tool{d}"), ("vendor_address", "12 Long Street, Izmir", ["12 Long Street Izmir", "Other Road", "12 LONG street,  izmir"][d - 1]), ("notes", "", "x" * (d - 1)), ("total_amount", "10.00", "10"))]
    fields = spark.createDataFrame(rows, "doc_id long, path string, truth string, predicted string")
    got = {(r["doc_id"], r["path"]): (r["em"], r["sim"]) for r in scoring.field_scores(fields).collect()}
    for d, f, t, p in rows:
        em, sim = got[d, f]
        assert sim == pytest.approx(ratio(p, t))
        same = " ".join(p.lower().split()) == " ".join(t.lower().split())
        assert em == float(same or (f == "vendor_address" and ratio(p, t) >= 0.8) or f == "total_amount")
    docs = scoring.document_scores(scoring.field_scores(fields))
    want = {d: round(sum(ratio(p, t) for i, _, t, p in rows if i == d) / 4, 4) for d in (1, 2, 3)}
    assert {r["doc_id"]: r["sim"] for r in docs.collect()} == pytest.approx(want, abs=1e-4)
    assert scoring.batch_scores(docs).first()["sim"] == pytest.approx(sum(want.values()) / 3, abs=1e-4)
    run = docs.withColumns({"doc_type": F.lit("invoice"), "verdict": F.lit("OK"), "sim": F.when(F.col("doc_id") < 3, F.col("sim"))})
    assert [r["sim"] for r in scoring.aggregate_run(run).collect()] == [pytest.approx((want[1] + want[2]) / 3, abs=1e-4)] * 3


FINDING = "doc_id long, kind string, severity string, field string, source string, message string, basis string, expected string, actual string, amount_k long, line long, blocks_payment boolean"


def test_decision_text_is_whole(spark):
    rows = [
        (1, "POSSIBLE_DUPLICATE", "critical", "_document", "ledger", "same supplier", "cross_source", "A-1", "A1", None, None, True),
        (1, "PRICE_MISMATCH", "critical", "unit_price", "po_match", "", "cross_source", "5000", "5340", 34000, 0, False),
        (1, "TOTAL_MISMATCH", "critical", "total_amount", "document", "parts", "single_document", None, None, -150, None, False),
        (1, "UNKNOWN_KIND", "info", "x", "document", "", "single_document", None, None, None, None, False),
    ]
    found = spark.createDataFrame(rows, FINDING)
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    fields = spark.createDataFrame([(1, "vendor_name", "V"), (1, "date", "d"), (1, "total_amount", "1"), (1, "notes", "")], "doc_id long, path string, value string")
    covered = decision.coverage(fields)
    made = decision.decide(docs, found)
    texts = {r["doc_id"]: r for r in reporting.decision_texts(made, decision.with_flags(found).withColumn("ord", F.monotonically_increasing_id()), covered).collect()}
    t = texts[1]["text"]
    assert t.startswith("🚫 ÖDEMEYİ BEKLETİN\nBu belge daha önce işlenmiş olabilir.\n\nFazla faturalanan tutar: 340,00 TL\n\nBelge içi tutarsızlık: -1,50 TL\n(")
    assert "• Fiyat Farkı  (340,00 TL)\n    Beklenen: 50,00 TL    Faturada: 53,40 TL\n    → Tedarikçiyle" in t
    assert "• Mükerrer Olabilir\n    Önceki: A-1    Bu belge: A1\n    same supplier\n    → " in t
    assert "• UNKNOWN_KIND\n\nDenetlenemeyen alanlar (2): date, vendor_name\n" in t
    assert t.index("Fiyat Farkı") < t.index("Mükerrer") < t.index("Genel Toplam")
    assert texts[2]["text"] == "✅ KONTROLLERDEN GEÇTİ\nÖdemeyi durduracak bir bulgu çıkmadı. Ödeme kararı sizde."
    with_c = {r["doc_id"]: (r["checked"], r["coverage_pm"], r["blind"]) for r in decision.with_coverage(made, covered).collect()}
    assert with_c == {1: (1, 333, ["date", "vendor_name"]), 2: (0, 0, [])}


def test_chat_message_holds_six_and_is_cut(spark):
    problems = spark.createDataFrame([(1, i, ["quantity", "unit_price", "_missing_po_line"][i % 3], "critical" if i % 2 else "warning", "x_" * 80) for i in range(9)], "doc_id long, ord long, field string, severity string, message string")
    verdicts = reporting.match_verdict(spark.createDataFrame([(1, "REJECT"), (2, "APPROVE"), (3, "odd")], "doc_id long, overall_status string"))
    out = {r["doc_id"]: r["message"] for r in reporting.chat_message(verdicts, reporting.match_problems(problems)).collect()}
    assert out[1].count("→") == 6 and out[1].count("🔴") == 4 and "x\\_" in out[1] and out[1].endswith("Sorunlar çözülene kadar ödeme yapmayın.\n")
    assert out[2] == "✅ *ÖDEMEYİ ONAYLAYABİLİRSİNİZ*\n_Fatura ve sipariş kayıtlarıyla tam uyuşuyor._\n\n💡 *Yapmanız Gereken*\nÖdemeyi onaylayabilirsiniz.\n"
    assert "İNCELEME" in out[3]
    long = verdicts.where("doc_id = 1").withColumn("action", F.expr("repeat('y', 5000)"))
    assert reporting.chat_message(long, reporting.match_problems(problems)).first()["message"].endswith("mesaj kısaltıldı_")


def test_lone_lines_and_issue_messages(spark):
    assert column(spark, reporting.lone_line(F.lit("_missing_po_line"), F.col("x")), ["pen", " ", None]) == ["Siparişte olup faturada olmayan kalem: pen", *["Siparişte olup faturada olmayan kalem"] * 2]
    rows = [("total_mismatch", 100, 250, None), ("numeric_invalid", None, None, "oops"), ("odd_rule", None, None, None), ("negative_amount", None, -1, None)]
    df = spark.createDataFrame(rows, "rule string, expected_k long, actual_k long, detail string")
    assert [r[0] for r in df.select(rules.issue_message()).collect()] == ["parts don't add up to the total: expected 1.00, found 2.50", "not a number: oops", "odd_rule", "amount is negative"]


def test_manifests_results_splits_and_images(spark, tmp_path):
    rows = [{"doc_id": f"d{i:03d}", "doc_type": ["invoice", "po"][i % 2], "language": "tr", "pdf": f"{i}.pdf", "json": f"{i}.json"} for i in range(40)]
    (tmp_path / "m.json").write_text(json.dumps(rows))
    manifest = src.read_manifest(spark, str(tmp_path / "m.json"))
    assert sorted(r["doc_id"] for r in manifest.collect()) == [r["doc_id"] for r in rows]
    src.write_results(manifest, str(tmp_path / "results"))
    assert spark.read.json(str(tmp_path / "results")).count() == 40
    cut = src.split(manifest, ["doc_type"])
    src.write_splits(cut, str(tmp_path / "splits"))
    counts = {(r["split"], r["doc_type"]): r["n"] for r in spark.read.json(str(tmp_path / "splits/summary")).collect()}
    assert counts == {(s, t): n for t in ("invoice", "po") for s, n in (("train", 12), ("val", 4), ("test", 4))}
    ids = [r["doc_id"] for r in spark.read.json(str(tmp_path / "splits/manifests")).collect()]
    assert sorted(ids) == [r["doc_id"] for r in rows]
    assert spark.read.json(str(tmp_path / "splits/documents")).where("split = 'train'").count() == 24
    src.write_dataset(manifest, manifest.groupBy("doc_type").count(), str(tmp_path / "data"))
    assert spark.read.json(str(tmp_path / "data/dataset")).where("doc_type = 'po'").count() == 20 and spark.read.json(str(tmp_path / "data/quality")).count() == 2
    (tmp_path / "scans").mkdir()
    (tmp_path / "scans/a.pdf").write_bytes(b"abc")
    assert bytes(src.read_images(spark, str(tmp_path / "scans"), lambda b: b[::-1]).first()["image"]) == b"cba"


def test_extraction_tries_again_and_falls_back(spark):
    docs = spark.createDataFrame([(i, "invoice", "p") for i in range(3)], "doc_id long, doc_type string, prompt string")

    def clients():
        def broken(kind, prompt):
            raise RuntimeError("quota")

        return [broken, lambda kind, prompt: "no object here", lambda kind, prompt: '```{"a": 1}```']

    assert {(r["response"], r["error"]) for r in src.extract(docs, clients).collect()} == {('```{"a": 1}```', None)}
    last = src.extract(docs, lambda: lambda kind, prompt: "nothing").first()
    assert (last["response"], last["error"]) == ("nothing", "no JSON object in the answer")
