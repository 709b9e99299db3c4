"""Every operator on nulls, empty and very long texts, repeated rows, clashing columns, no rows."""

import pytest
from pyspark.sql import functions as F

from veriledger.llm import decontam, golay, htmltext, langid, linededup, mixing, mixlm, sharding, syncmers, warc

CLASH = ["fp", "h", "key", "size", "source_size", "words", "bucket", "place", "row", "held_out", "n", "__kept", "copies"]
LONG = " ".join(f"w{i * 7919 % 5003} the" for i in range(30_000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three four five six seven", "en", "a"), (1, "one two three four five six seven", "en", "a"), (2, None, "en", None), (3, "", None, "a"), (4, LONG, "fr", "b"), (None, "a text without an id", "fr", "b"), (5, " \n \t", "fr", ""), (6, "123 456 ...", None, "b"), (7, "ÉTÉ à la plage\n\nune ligne", "fr", "c")]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return out.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "two three four five"), (1, "two three four five"), (2, None), (3, ""), (None, "à la plage"), (4, " ".join(f"w{i * 7919 % 5003} the" for i in range(40)))], "item_id long, text string").withColumn("words", F.lit(1))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a.b/x/1", "<p>One &amp; <b>two</b><p>three"), (1, "http://a.b/x/1", "<p>One &amp; <b>two</b><p>three"), (2, None, None), (3, "http://a.b/x/2", ""), (None, "not a url", "<article>text</article>" * 200), (5, "http://a.b", "<article><p>" + "word " * 60_000 + "</article>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("rid", "host", "path", "hashes", "digest", "keeper", "part")})


OPS = {
    "lines": lambda d, b, p: linededup.dedup_lines(d), "mix_counts": lambda d, b, p: mixing.mix_counts(d), "mix": lambda d, b, p: mixing.mix(d), "near": lambda d, b, p: golay.near_duplicates(d), "keep_one": lambda d, b, p: golay.keep_one(d),
    "syncmers": lambda d, b, p: syncmers.compare_with_edit(d), "shards": lambda d, b, p: sharding.placements(d, 1000, 5000), "contamination": lambda d, b, p: decontam.contamination(d, b), "keep_clean": lambda d, b, p: decontam.keep_clean(d, b),
    "mixlm": lambda d, b, p: mixlm.score(d), "langid": lambda d, b, p: langid.identify(d), "keep_identified": lambda d, b, p: langid.keep_identified(d), "html": lambda d, b, p: htmltext.extract(p), "warc": lambda d, b, p: warc.archive_round_trip(p),
}
PER_ROW = {"mix_counts": 9, "near": 9, "syncmers": 9, "shards": 9, "contamination": 9, "mixlm": 9, "langid": 9, "html": 6, "warc": 6}
SAME_COLUMNS = ("mix", "keep_one", "keep_clean", "keep_identified")


@pytest.mark.parametrize("name", OPS)
def test_awkward_rows(name, docs, bench, pages):
    out = OPS[name](docs, bench, pages)
    rows = out.collect()
    if name in PER_ROW:
        assert len(rows) == PER_ROW[name]
    if name in SAME_COLUMNS:
        assert out.columns == docs.columns


@pytest.mark.parametrize("name", OPS)
def test_no_rows(name, docs, bench, pages):
    out = OPS[name](docs.where("false"), bench.where("false"), pages.where("false"))
    assert out.collect() == []


def test_results_of_awkward_rows(docs, bench):
    near = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in golay.near_duplicates(docs).collect()}
    assert {x for x in near if x[1] == "0" * 16} == {(2, "0" * 16, 2), (3, "0" * 16, 2), (5, "0" * 16, 2)}
    lang = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert all(lang[i]["lang_pred"] == "und" and lang[i]["score"] == 0 for i in (2, 3, 5, 6))
    hit = {r["doc_id"]: r for r in decontam.contamination(docs, bench).collect()}
    assert (hit[1]["n_hit"], hit[1]["n_items"], hit[1]["contaminated"]) == (4, 1, True)
    assert (hit[2]["n_words"], hit[2]["n_hit"], hit[2]["contaminated"]) == (0, 0, False)
    lm = {r["doc_id"]: r for r in mixlm.score(docs).collect()}
    assert lm[2]["n_tokens"] == lm[3]["n_tokens"] == 1 and lm[1]["n_tokens"] == 8
    assert all(r["score"] < 0 and r["base_score"] <= 0 for r in lm.values())
