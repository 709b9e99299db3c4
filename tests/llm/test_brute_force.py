"""Operators and the pipeline against plain versions that look at everything."""

import hashlib
import itertools
import os
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from veriledger.llm import decontam, golay, htmltext, langid, linededup, mixing, mixlm, queries, sharding, syncmers

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.exists(SF), reason="no tables")


def components(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# ---- 1


def noisy_lines(rng, groups, size, length=60):
    out = []
    for _ in range(groups):
        base = "".join(rng.choices("abcdefghij klmnop", k=length))
        for _ in range(size):
            line = list(base)
            for _ in range(rng.randint(0, 5)):
                line[rng.randrange(length)] = rng.choice("xyzuvw")
            out.append("".join(line).strip())
    return out


def by_brute_force(lines):
    sets = [linededup.shingles(x) for x in lines]
    close = [(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return close, components(len(lines), close)


def test_lines_recall(spark):
    lines = sorted(set(noisy_lines(random.Random(5), 40, 8, 200)))
    close, root = by_brute_force(lines)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in linededup.dedup_lines(docs).collect()}
    joined = sum(got[i] == got[j] for i, j in close)
    assert len(close) > 100 and joined >= 0.99 * len(close)
    assert all(root[i] == root[j] for i, j in itertools.combinations(got, 2) if got[i] == got[j])


def test_lines_on_both_sides_of_a_border_meet(spark):
    """Lines of many shingles are signed by another method than lines of few; repeats aren't counted."""
    rng = random.Random(1)
    letters, pairs = "abcdefghij klmnop", []
    for length, more in ((150, 15), (160, 6), (160, 12), (165, 3), (140, 28)):
        for _ in range(8):
            a = "q" + "".join(rng.choices(letters, k=length)) + "q"
            pairs.append((a, a + "".join(rng.choices("xyzuvw", k=more))))
    for _ in range(8):
        a = "q" + "".join(rng.choices(letters, k=60)) + "q"
        pairs.append((a + a, a * 6))
    a = "abcdefghi" * 20
    pairs.append((a[:40], a * (17 * linededup.CHUNK // len(a))))  # a very long line of nine shingles
    assert all(linededup.jaccard(*p) >= 0.82 for p in pairs)
    docs = spark.createDataFrame([(2 * i + j, x) for i, p in enumerate(pairs) for j, x in enumerate(p)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in linededup.dedup_lines(docs).collect()}
    assert [i for i in range(len(pairs)) if got[2 * i] != got[2 * i + 1]] == []


@pytest.mark.parametrize("members,characters", [(4, 1 << 22), (4, 400), (1 << 12, 300)])
def test_large_buckets_lose_no_pair(spark, monkeypatch, members, characters):
    """The same components whichever way a bucket is compared."""
    lines = sorted(set(noisy_lines(random.Random(9), 4, 25)))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").repartition(3)
    want = {r["doc_id"]: r["component_id"] for r in linededup.dedup_lines(docs).collect()}
    monkeypatch.setattr(linededup, "MEMBERS", members)
    monkeypatch.setattr(linededup, "CHARACTERS", characters)
    assert {r["doc_id"]: r["component_id"] for r in linededup.dedup_lines(docs).collect()} == want


def test_very_long_lines():
    rng = random.Random(3)
    a = "".join(rng.choices("abcdefgh ", k=3_000_000))
    b = a[:1_400_000] + "#" + a[1_400_000:]
    assert linededup.long_similarity(a, b) == pytest.approx(1, abs=1e-4) and linededup.long_similarity(a, b) < 1
    keys = linededup.band_keys(np.concatenate([linededup.signatures([x]) for x in (a, b)]))
    assert set(keys[0]) & set(keys[1])


@needs_tables
def test_lines_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = sorted({x.strip(linededup.SPACE) for r in docs.collect() for x in (r["text"] or "").split("\n")} - {""})
    close, root = by_brute_force(lines)
    rows = linededup.dedup_lines(docs).collect()
    assert len({r["component_id"] for r in rows}) <= len(set(root)) + max(1, len(close) // 100) and len({r["component_id"] for r in rows}) >= len(set(root))
    assert sum(r["keep"] for r in rows) == len({r["component_id"] for r in rows})


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    docs = spark.createDataFrame([(1, "one line here\nand another one"), (1, "and another one\na third line, new"), (None, "a third line, new\nlast of all lines")], "doc_id long, text string").coalesce(1)
    # the row without an id is first, then the two of id 1 in the order read or the other way round
    kept = [line for r in linededup.keep_first_lines(docs).collect() for line in r["text"].split("\n") if line]
    assert sorted(kept) == sorted(["one line here", "and another one", "a third line, new", "last of all lines"])


# ---- 2


def test_rows_without_an_id_draw_apart(spark):
    docs = spark.createDataFrame([(None, f"word{i}", "a") for i in range(400)] + [(i, "x " * 100, "b") for i in range(40)], "doc_id long, text string, source string")
    taken = [r["copies"] for r in mixing.mix_counts(docs).collect() if r["source"] == "b"]
    rows = mixing.mix_counts(docs).where("source = 'a'").collect()
    assert len({r["copies"] for r in rows}) <= 2 and sum(r["taken"] for r in rows) == pytest.approx(rows[0]["target"], rel=0.15) and taken


# ---- 3


def page(menu, body, tail):
    return f"<body><article><h1>{body[0]}</h1><p>{menu}</p>" + "".join(f"<p>{x}</p>" for x in body[1:]) + f"<p>{tail}</p></article></body>"


def pages_of_hosts():
    rng, rows = random.Random(2), []
    words = [f"w{i}" for i in range(500)]
    for h in range(3):
        for i in range(12):
            body = [" ".join(rng.choices(words, k=12)) for _ in range(4)]
            if i % 5 == 4:
                body[2] = "a sentence that a few articles share"
            rows.append((len(rows), f"http://h{h}.example/{'ab'[i % 2]}/{i}", page(f"Read our newsletter of {h}", body, f"More from host {h}")))
        twin = rows[-1]
        rows.append((len(rows), twin[1] + "-copy", twin[2]))
    rows += [(900, "http://two.example/x", "<div>Top</div><div>One</div>"), (901, "http://two.example/y", "<div>Top</div><div>Two</div>"), (902, "http://lone.example/", page("m", ["t", "b"], "e"))]
    return rows


def extracted_by_brute_force(rows):
    lines = {i: htmltext.lines_of(h) for i, _, h in rows}
    parts = {i: u.split("//")[1].split("/", 1) for i, u, _ in rows}
    out = {}
    for i in lines:
        peers = sorted((j for j in lines if parts[j][0] == parts[i][0]), key=lambda j: (("/" + parts[j][1]).replace("/", "\x01"), j))
        distinct = {tuple(t for t, _ in lines[j]) for j in peers}
        near = [j for j in (peers[k] for k in (peers.index(i) - 1, peers.index(i) + 1) if 0 <= k < len(peers))]
        path = lambda j: ("/" + parts[j][1]).replace("/", "\x01")
        shared = set()
        if near:
            best = max(near, key=lambda j: (htmltext.nearness(path(i), path(j)), peers.index(j) < peers.index(i)))
            shared = {k for k, hit in enumerate(htmltext.common([hash(t) for t, _ in lines[i]], [hash(t) for t, _ in lines[best]])) if hit}
        on = Counter(t for d in distinct for t in set(d))
        cut = {k for k in shared for t, kind in [lines[i][k]] if on[t] >= max(2, min(3, len(distinct))) and (kind != htmltext.NORMAL or on[t] >= max(3, len(distinct) / 2))}
        out[i] = "\n".join(htmltext.main_lines(lines[i], cut))
    return out


def test_pages_against_brute_force_and_in_two_layouts(spark):
    rows = pages_of_hosts()
    schema = "page_id long, url string, html string"
    texts = lambda df, **k: {r["page_id"]: r["text"] for r in htmltext.extract(df, **k).collect()}
    one = texts(spark.createDataFrame(rows, schema).coalesce(1))
    assert one == extracted_by_brute_force(rows)
    mixed = list(rows)
    random.Random(4).shuffle(mixed)
    assert texts(spark.createDataFrame(mixed, schema).repartition(5)) == one
    # differencing decides about pages with an article: the template goes, shared sentences and twins stay
    without = texts(spark.createDataFrame(rows, schema), differencing=False)
    assert all("newsletter" in without[i] and "newsletter" not in one[i] and "More from" not in one[i] for i in range(39))
    assert sum("a sentence that a few" in t for t in one.values()) == sum("a sentence that a few" in t for t in without.values()) > 3
    assert one[12] == one[11] != "" and one[900] == "One" and one[901] == "Two" and one[902] == "t\nm\nb\ne"


def test_marks_are_whole_names():
    lines = htmltext.lines_of('<article><section class="social-security"><p>benefits</p></section><div id="share-price"><p>rises</p></div><div class="comment-list"><p>first!</p></div><div class="ad-box">buy</div></article>')
    assert [t for t, _ in lines] == ["benefits", "rises"]
    deep = "<div>" * 20_000 + "x" + "</span></p>" * 20_000
    assert [t for t, _ in htmltext.lines_of(deep)] == ["x"]


# ---- 5


def test_large_keys_and_rows_without_an_id(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ np.array([sum(1 << int(x) for x in rng.choice(64, int(rng.integers(0, 6)), False)) for _ in range(150)], np.uint64) for b in base]))
    close = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if int(fps[i] ^ fps[j]).bit_count() <= 4]
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for block in (8192, 40):
        place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
        found = [(place[r["src"]], place[r["dst"]]) for r in golay.links(df, 4, block).collect()]
        assert components(len(fps), found) == components(len(fps), close)
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, text), (None, text + " "), (None, "other words stand in this one, all by itself"), (7, text), (7, "a text under the same id but of its own, long enough"), (7, text)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"][:5]) for r in golay.keep_one(docs).collect()) == [(0, "other"), (7, "a tex"), (7, "one t")]


# ---- 6


def chained(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return seed - (seed >> 63 << 64)


def anchors_of(units):
    if len(units) < syncmers.K:
        return {tuple(units)} if units else set()
    inner = [chained(a, b) for a, b in itertools.pairwise(units)]
    last = syncmers.K - syncmers.S
    return {chained(*[inner[j + i] for i in range(0, last + 1, syncmers.S)]) for j in range(len(inner) - last) if min(inner[j], inner[j + last]) == min(inner[j : j + last + 1])}


def test_likeness_against_brute_force(spark):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "ei", "f"], k=rng.randint(0, 60))) for i in range(30)} | {30: "", 31: "無空白文章也有錨點" * 6, 32: "無空白文章也有錨點" * 5 + "不同的結尾在這裡", 33: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    rows = {r["doc_id"]: r for r in syncmers.compare_with_edit(docs).collect()}
    few = lambda t: len(t.split()) < syncmers.FEW or len(t) > len(t.split()) * syncmers.WIDE

    def likeness(a, b):
        chars = few(a) or few(b)
        x, y = (anchors_of((list(t) if t.split() else []) if chars else t.split()) for t in (a, b))
        return len(x & y) / len(x | y) if x | y else 1.0

    for i in range(34):
        own, after = texts[i] or "", texts[(i + 1) % 34] or ""
        n = len(own)
        edited = own[: n - n // 4] + after[: n // 4]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[i]["n_chars"] == n
        assert rows[i]["near_edited"] == pytest.approx(likeness(own, edited)) and rows[i]["near_next"] == pytest.approx(likeness(own, after))
    assert rows[31]["near_edited"] > 0.3


def test_one_id_in_several_buckets(spark, monkeypatch):
    rows = [(None, f"text number {i} without an id") for i in range(20)] + [(5, f"text number {i} of id five") for i in range(20)] + [(6, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(map(str, syncmers.compare_with_edit(docs).collect()))
    monkeypatch.setattr(syncmers, "BUCKET", 100)
    assert sorted(map(str, syncmers.compare_with_edit(docs).collect())) == want and len(want) == 41


# ---- 7


def test_vacuum_spares_files_of_a_running_writer(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit("s").alias("source"))
    table = sharding.shard(docs, f"file://{tmp_path}/t", 300, 2000)
    (tmp_path / "t/data/a-running").mkdir()
    (tmp_path / "t/data/a-running/part-00000-x.parquet").write_bytes(b"not yet committed")
    table.vacuum()
    assert (tmp_path / "t/data/a-running/part-00000-x.parquet").exists() and table.read().count() == 100
    table.vacuum(spare_ms=-1)
    assert not (tmp_path / "t/data/a-running/part-00000-x.parquet").exists() and table.read().count() == 100


# ---- 8


def test_near_quotations_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"term{i}" for i in range(300)]
    items = {str(i): rng.sample(words, rng.choice([6, 13, 30])) for i in range(12)} | {"one": ["term1"], "none": []}
    docs = {}
    for i in range(60):
        text = rng.choices(words, k=80)
        if i % 2:
            quoted = list(items[str(i % 12)])
            quoted.insert(len(quoted) // 2, "inserted")
            quoted[1] = "changed"
            text[20:20] = quoted
        docs[i] = text
    seen = Counter(w for t in docs.values() for w in t)
    want = {}
    for name, item in items.items():
        rare = sorted({w for w in item if seen[w]}, key=lambda w: (seen[w], w))[: decontam.NEAR_TERMS]
        for d, text in docs.items():
            shifts = [(p - q, w) for p, w in enumerate(text) for q, x in enumerate(item) if x == w and w in rare]
            best = max((len({w for s, w in shifts if lo <= s <= lo + decontam.SLOP}) for lo, _ in shifts), default=0)
            if best >= 2 and best >= decontam.NEAR_SHARE * len(rare):
                want[d, name] = best
    rows = decontam.proximity(spark.createDataFrame([(i, ". ".join(t).upper()) for i, t in docs.items()], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id string, text string"))
    got = {(r["doc_id"], r["item_id"]): r["n_terms"] for r in rows.collect()}
    assert got == want and sum(d % 2 for d, _ in got) >= 25


# ---- 9


def small_model(texts):
    data, starts = mixlm.stream(texts)
    code = mixlm.Code(*np.unique(mixlm.before(data, starts) << 8 | data, return_counts=True))
    bits = (12, 12, 12, 12)
    counts = [np.zeros((2 << b) + 2 * mixlm.NODES, np.uint32) for b in bits]
    for which in mixlm.TOGETHER:
        mixlm.count(texts, code, bits, which, [counts[k] for k in which])
    n, s = zip(*[mixlm.Model.quantise(*c.reshape(-1, 2).T.astype(float)) for c in counts])
    return mixlm.Model(bits, code, list(n), list(s))


def test_probabilities_of_the_next_byte_sum_to_one():
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma"], k=200)).encode() for _ in range(20)]
    model = small_model(texts)
    model.costs(texts[:5], True)
    for known in (b"", texts[0][:300], "bêta".encode()):
        def price(more, known=known):
            data = known + more
            real = mixlm.stream  # without the end mark
            mixlm.stream = lambda some: (np.frombuffer(data, np.uint8), np.zeros(1, np.int64))
            try:
                return model._some([data], False)[0]
            finally:
                mixlm.stream = real

        before = price(b"") if known else 0.0
        assert sum(2 ** (price(bytes([b])) - before) for b in range(256)) == pytest.approx(1, abs=1e-3)


def test_left_out_counts_are_exact():
    rng = np.random.default_rng(5)
    n = rng.integers(0, 40, (300, 2)) * (rng.random((300, 2)) < 0.7)
    n[:4] = [(0, 0), (1, 0), (0, 1), (3000, 1)]

    def plain(n0, n1):
        x = np.clip(np.log((n1 + mixlm.PRIOR) / (n0 + mixlm.PRIOR)), -12, 12) * 2048
        return x, sum(n0 + n1 > s for s in (0.5, 2.5, 15.5))

    less, s = mixlm.Model.quantise(*n.T.astype(float))
    for (n0, n1), both, one in zip(n.tolist(), less.reshape(-1, 2).tolist(), s.tolist(), strict=True):
        for got, (x, seen) in ((one, plain(n0, n1)), (both[0], plain(max(n0 - 1, 0), n1)), (both[1], plain(n0, max(n1 - 1, 0)))):
            assert got & 3 == seen and abs((got & ~3) - x) <= 4


def test_sums_of_two_columns():
    rng = np.random.default_rng(6)
    at, x, y, by = rng.integers(0, 7, 500), *rng.normal(size=(3, 500)).astype(np.float32)
    for first, second in ((x, y), (x, 1.0), (0.0, y)):
        for got, v in zip(mixlm.added(at, 7, first, second, by), (first, second), strict=True):
            assert got == pytest.approx(np.bincount(at, v * by, 7), abs=1e-3)


def test_scores_adapt_and_read_across_tokens():
    rng = random.Random(2)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(50)], k=100)).encode() for _ in range(30)] + [b"the cat sat on the mat " * 4 + b"end"]
    model = small_model(texts)
    a, b = model.costs([b"the cat sat on the mat", b"mat the on sat cat the"])
    assert a > b  # the order of words counts
    once, twice = model.costs([b"qux zork " * 40, b"qux zork " * 80])
    assert twice - once > 0.8 * once  # what a text repeats gets cheaper
    assert model.costs([b"", b"x"]).tolist() == model.costs([b"x", b""])[::-1].tolist()


def test_counts_and_base_against_brute_force(spark):
    import zlib

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["Alpha", "beta", "gamma", f"rare{i}"], k=rng.randint(0, 30)))) for i in range(80)] + [(None, "alpha"), (81, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").lower().split(), "\n"]
    seen = Counter(w for i, t in rows if not fold(i) for w in tokens(t))
    n, v = seen.total(), len(seen)
    got = {r["doc_id"]: r for r in mixlm.score(docs).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i), len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(t))) and r["score"] < 0
        assert r["bits_per_byte"] == pytest.approx(-r["score"] / np.log10(2) / len(" ".join([*(t or "").split(), "\n"]) if t else "\n"), rel=1e-6)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no tables")
def test_held_out_texts_beat_the_base(spark):
    out = mixlm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    r = out.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r["s"] / r["n"] > r["b"] / r["n"] + 0.15


# ---- pipeline


def awkward(spark):
    rows = [(1, "one two three four five six seven", "en", "a"), (1, "one two three four five six seven", "en", "a"), (2, None, "en", None), (3, "", None, "a"), (None, "a text without an id, in words", "fr", "b"), (None, "another text without an id", "fr", None), (5, " \n \t", "fr", ""), (6, "123 456", None, "b"), (7, "ÉTÉ à la plage\n\nune ligne " * 500, "fr", "c"), (9, "zwei drei vier fünf sechs sieben acht", "de", "c")]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return out.withColumns({c: F.lit("x") for c in ("fp", "h", "key", "size", "words", "bucket", "place", "row", "held_out", "n", "copies", "rate", "shard", "tier")})


def test_stages_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([(1, "one two three four five six seven"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = awkward(spark), {}
    for name, stage in c.STAGES:
        out = c.store(stage(spark, docs, str(tmp_path)), f"test-{name}")
        empty = stage(spark, awkward(spark).where("false"), str(tmp_path))
        assert empty.collect() == []
        if name != "shards":
            assert out.columns == docs.columns
            docs, left[name] = out, sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in out.collect())
    assert left["language"] == [(0, "a tex"), (0, "anoth"), (1, "one t"), (1, "one t"), (7, "ÉTÉ à"), (9, "zwei ")]
    assert left["near_duplicates"] == [(0, "a tex"), (0, "anoth"), (1, "one t"), (7, "ÉTÉ à"), (9, "zwei ")]
    assert left["decontamination"] == [(0, "a tex"), (0, "anoth"), (7, "ÉTÉ à"), (9, "zwei ")]
    assert set(left["mixture"]) <= set(left["decontamination"])
    assert out.count() == len(left["mixture"]) and set(out.columns) == {"doc_id", "text_bytes", "shard", "tier", "shard_rows", "shard_bytes"}


@needs_tables
def test_pipeline_against_brute_force(spark):
    import duckdb

    import corpus_pipeline as c

    con = duckdb.connect()
    docs = con.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()
    items = con.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()
    docs = [d for d in docs if d[1] and regex.search(r"\p{L}", d[1])]  # a language is found for any letter
    fps = [golay.fingerprint(d[1]) for d in docs]
    roots = components(len(docs), [(i, j) for i, j in itertools.combinations(range(len(docs)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    first = defaultdict(list)
    for d, r in zip(docs, roots):
        first[r].append(d)
    docs = [min(g, key=lambda d: d[0]) for g in first.values()]
    cut = lambda t: [w for w in regex.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")) if w]
    windows = {tuple(w[i : i + 13]) for (t,) in items for w in [cut(t)] if w for i in range(max(1, len(w) - 12))}
    sizes = {len(w) for w in windows}

    def clean(text):
        w = cut(text)
        hit = {k for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(i, i + n)}
        return not hit or 20 * len(hit) < len(w)

    docs = [d for d in docs if clean(d[1])]
    size = Counter()
    for d in docs:
        size[d[3]] += len(regex.findall(r"[^\x20\x09-\x0D]+", d[1]))
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight, target, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, set(names)
    while open_:  # one after the other, the excess shared anew
        room = sum(size.values()) - sum(target.values())
        share = {s: room * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * size[s]
            open_.discard(s)
    mixed = []
    for i, text, _, s in docs:
        rate = target[s] / size[s] if size[s] else 0.0
        draw = int(hashlib.md5(f"mix-1:{i}:{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
        mixed += [(i, text, s)] * (int(rate + 1e-9) + (draw < rate - int(rate + 1e-9)))
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", mixed)
    want = sorted(con.sql("SELECT doc_id, text_bytes, shard, tier, shard_rows, shard_bytes FROM (" + queries.OP7_SQL + ")").fetchall())
    got = sorted(tuple(r) for r in c.run(spark, SF).select("doc_id", "text_bytes", "shard", "tier", "shard_rows", "shard_bytes").collect())
    assert got == want and len(got) > 100


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.exists(sf):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.identify(docs).where("held_out and lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id")
    r = out.agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("lang_pred")).alias("right")).first()
    assert r["right"] >= 0.98 * r["n"] > 100


def test_all_training_rows_teach_the_mixer(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words of text {i} and {i * i}") for i in range(40)], "doc_id long, text string")
    told, taught = [], mixlm.taught
    monkeypatch.setattr(mixlm, "taught", lambda texts, model: told.append(texts.count()) or taught(texts, model))
    rows = mixlm.score(docs).collect()
    assert told == [sum(not r["held_out"] for r in rows)] and len(rows) == 40
