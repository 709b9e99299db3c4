"""Queries cover whole texts and whole tables."""

import hashlib
import os
import re
from difflib import SequenceMatcher

import pytest

from veriledger.plans.queries import QUERIES
from veriledger.plans.views import view


def test_text_is_normalised_beyond_a_prefix(spark, tmp_path):
    texts = {1: "A" * 199 + "  b", 2: "A" * 199 + "  c", 3: "word\t" * 100, 4: "", 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["normal"] for r in QUERIES["FN-15_text"](spark, str(tmp_path)).collect()}
    md5 = lambda t: hashlib.md5(re.sub(r"\s+", " ", (t or "").lower()).strip().encode()).hexdigest()
    assert found == {k: md5(t) for k, t in texts.items()} and found[1] != found[2]


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """The smallest tables with some documents of every remainder of 40."""
    d = tmp_path_factory.mktemp("few")
    for t in ("orders", "lineitem", "part", "supplier"):
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        key = {"orders": "o_orderkey", "lineitem": "l_orderkey"}.get(t)
        (rows.where(f"{key} <= 60") if key else rows).write.parquet(str(d / f"{t}.parquet"))
    return str(d)


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
def test_every_document_is_matched(spark, few):
    words = {r["p_partkey"]: r for r in view(spark, few, "part").collect()}
    po, inv = view(spark, few, "po_items").collect(), view(spark, few, "inv_items").collect()
    text = lambda r: f"{words[r['partkey']]['p_name']} {words[r['partkey']]['p_brand']}"
    tidy = lambda t: t.strip().lower()
    pairs = {}
    for a in po:
        for b in inv:
            if a["doc_id"] == b["doc_id"]:
                other = text(b) + (" " + words[b["partkey"]]["p_type"] if b["partkey"] % 3 == 0 else "")
                x, y = tidy(text(a)), tidy(other)
                same = a["partkey"] % 2 == 0 and tidy(a["sku"]) == tidy(b["sku"])
                pairs[a["doc_id"], a["pos"], b["pos"]] = (same, round(SequenceMatcher(None, x, y).ratio(), 9))
    rows = QUERIES["JN-07_fuzzy_scores"](spark, few).collect()
    assert len(rows) == len(pairs) and {(r["doc_id"], r["po_pos"], r["inv_pos"]): (r["same_sku"], round(r["sim"], 9)) for r in rows} == pairs
    assert any(k[0] % 10 for k in pairs)
    taken = {}
    for i, k in sorted({(d, p) for d, p, _ in pairs}):
        free = [(not v[0], 0 if v[0] else -v[1], j) for (d, p, j), v in pairs.items() if (d, p) == (i, k) and (v[0] or v[1] > 0.65) and (i, j) not in taken]
        if free:
            taken[i, min(free)[2]] = k
    assert {(r["doc_id"], r["inv_pos"]): r["po_pos"] for r in QUERIES["JN-08_greedy"](spark, few).collect()} == taken
    assert {(r["doc_id"], r["i"], r["j"]) for r in QUERIES["SC-07_item_similarity"](spark, few).collect()} == set(pairs)


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
def test_every_number_and_document_is_canonical(spark, few):
    held = {(r["row_id"], r["doc_number"], r["supplier"]) for r in view(spark, few, "ledger").collect()}
    new = [(r["doc_id"], r["doc_number"], r["supplier"]) for r in view(spark, few, "incoming").collect()]
    every = sorted([*held, *new])
    key = lambda t: re.sub(r"[^0-9a-zçğıöşü]+", "", t.lower())
    assert sorted(map(tuple, QUERIES["FN-02_doc_number"](spark, few).collect())) == sorted((i, key(n)) for i, n, _ in every)
    assert sorted(map(tuple, QUERIES["FN-03_number_core"](spark, few).collect())) == sorted((i, re.sub(r"\D", "", n).lstrip("0")) for i, n, _ in every)
    assert sorted(map(tuple, QUERIES["FN-05_identity_key"](spark, few).collect())) == sorted((i, f"{s}|{key(n)}") for i, n, s in every)
    docs = {r["doc_id"] for r in view(spark, few, "inv_docs").collect()}
    rows = QUERIES["TR-09_efatura"](spark, few).collect()
    assert len(rows) == len(docs) and {r["doc_id"] for r in rows} == docs
    assert sum(r["n"] for r in QUERIES["SE-05_channels"](spark, few).collect()) == 2 * len(docs)


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
def test_every_line_is_voted_on(spark, few, tmp_path):
    lines = spark.read.parquet(f"{few}/lineitem.parquet").limit(1).selectExpr("* except (l_orderkey)", "explode(array(1L, 2L, 3L)) as l_orderkey")
    lines.selectExpr("*", "explode(sequence(1L, 4 * l_orderkey)) as k").selectExpr("* except (l_linenumber, l_partkey, k)", "cast(k as int) as l_linenumber", "l_partkey + k as l_partkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = {(r["doc_id"], r["pos"]): r for r in view(spark, str(tmp_path), "inv_items").collect()}
    rows = QUERIES["AG-15_vote_items"](spark, str(tmp_path)).collect()
    assert len(rows) == len(want) == 4 + 8 + 12 and {(r["doc_id"], r["pos"]) for r in rows} == set(want)
    for r in rows:
        line, n = want[r["doc_id"], r["pos"]], 4 * r["doc_id"]
        seen = sorted(line["qty"] + (line["partkey"] % 3 == p) for p in range(3) if r["pos"] < max(n, 8) - p)
        assert r["qty"] == seen[len(seen) // 2]
    assert {(r["doc_id"], r["pos"]) for r in QUERIES["AG-14_vote"](spark, str(tmp_path)).collect()} == set(want)


def test_syncmers_keep_every_anchor(spark):
    from veriledger.llm import syncmers

    shared = " ".join(f"s{i}" for i in range(50))
    long = lambda p: " ".join(f"{p}{i}" for i in range(3000))
    rows = [(1, f"{long('a')} {shared} {long('b')}"), (2, f"{long('c')} {shared} {long('d')}"), (3, "two words"), (4, "字" * 50 + "漢語文字本日中国" * 20), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in syncmers.compare_with_edit(df).collect()}
    full = {r["doc_id"]: {x["hash"] for x in r["a"]} for r in df.select("doc_id", syncmers.anchors("text").alias("a")).collect()}
    assert len(out[1]["fingerprint"]) == 16 * len(full[1]) and len(full[1]) > 3000
    assert out[1]["near_next"] == len(full[1] & full[2]) / len(full[1] | full[2]) > 0
    assert 0 < out[3]["near_edited"] < 1 and out[4]["near_edited"] > 0
    assert out[5]["fingerprint"] == "" and out[5]["near_edited"] == 1.0


def test_documents_with_a_language_stay_whatever_the_score(spark):
    from veriledger.llm import langid

    same = "the same words in every language"
    rows = [(i, f"{same} {i % 7}", f"l{i % 5}") for i in range(200)] + [(900, "q", None), (901, None, "l1"), (902, "123", "l1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs).collect()
    named = {r["doc_id"] for r in found if r["lang_pred"] != "und"}
    assert min(r["score"] for r in found if r["doc_id"] in named) < 0.5
    assert {r["doc_id"] for r in langid.keep_identified(docs).collect()} == named == {*range(200), 900}
