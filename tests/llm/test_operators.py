"""Operators against brute force, round trips and held-out data."""

import gzip
import hashlib
import io
import itertools
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from veriledger.llm import components, decontam, golay, htmltext, langid, linededup, mixing, mixlm, sharding, syncmers, warc


def groups(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# ---- 1 lines


def test_line_dedup_finds_near_lines(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(400)]
    base = [" ".join(rng.choices(words, k=25)) for _ in range(40)]
    lines = base + [b[:80] + "X" + b[81:] for b in base[:20]] + base[:5]
    docs = spark.createDataFrame([(i, "\n".join(lines[i::8])) for i in range(8)], "doc_id long, text string")
    out = {(r["doc_id"], r["line_no"]): r for r in linededup.dedup_lines(docs).collect()}
    text = {(i, n): t for i in range(8) for n, t in enumerate(lines[i::8])}
    want = groups([(a, b) for a, b in itertools.combinations(sorted(text), 2) if linededup.jaccard(text[a], text[b]) >= 0.8], sorted(text))
    assert out.keys() == text.keys()
    for a, b in itertools.combinations(sorted(text), 2):
        assert (out[a]["component_id"] == out[b]["component_id"]) == (want[a] == want[b])
    assert {k for k, r in out.items() if r["keep"]} == set(want.values())
    kept = linededup.keep_first_lines(docs).collect()
    assert sum(len(r["text"].split("\n")) for r in kept if r["text"]) == len(set(want.values()))


def test_band_keys_collide_for_alike_lines_only():
    line = "the quick brown fox jumps over the lazy dog and then runs far away from everyone here"
    keys = linededup.band_keys(linededup.signatures([line, line[:-1] + "!", "something else entirely, with other words in a different order altogether"]))
    assert len(set(keys[0]) & set(keys[1])) > 5 and not set(keys[0]) & set(keys[2])


# ---- 2 mixing


def test_mix_shares_and_caps(spark):
    rows = [(i, "w " * 10, s) for s, n, start in (("a", 10, 0), ("b", 100, 100), (None, 300, 1000)) for i in range(start, start + n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r["source"]: r for r in mixing.source_plan(docs.selectExpr("source", "10L as size")).collect()}
    assert plan["a"]["target"] == 300 and plan["a"]["rate"] == 3.0  # capped
    assert plan["b"]["target"] == pytest.approx((4100 - 300) * 2 / 3) and plan[None]["target"] == pytest.approx((4100 - 300) / 3)
    counts = mixing.mix_counts(docs).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in counts)
    taken = sum(r["taken"] for r in counts if r["source"] == "b")
    assert abs(taken - plan["b"]["target"]) < 0.15 * plan["b"]["target"]
    assert mixing.mix(docs).count() == sum(r["copies"] for r in counts)
    assert sorted(r["copies"] for r in mixing.mix_counts(docs).collect()) == sorted(r["copies"] for r in counts)


# ---- 3 html


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_alignment_is_a_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    kept = [x for x, hit in zip(a, htmltext.common(a, b)) if hit]
    rest = iter(b)
    assert all(x in rest for x in kept) and len(kept) == table[-1][-1]


def test_page_markup():
    page = '<head><title>T</title><style>p{}</style><script>"</p>"</script></head><nav><a>Menu</a></nav><div class="cookie-notice">We use</div><main><article><header><h1>Head</h1><span>by me</span></header><p>One &amp; two&nbsp;x<br>three</p><p>soup <b>bold<p>next</p><section class="comments"><p>hey</p></section><aside>x</aside></article></main><form>f</form><footer>z</footer>'
    assert [t for t, _ in htmltext.lines_of(page)] == ["Head", "One & two x three", "soup bold", "next"]


def test_differencing_deletes_lines_shared_with_the_nearest_url(spark):
    page = lambda body: f"<div>Shop of things</div><div>Call us</div><div>{body}</div><div>All rights kept</div>"
    rows = [(i, f"http://h.example/{p}", page(b)) for i, (p, b) in enumerate([("a/1", "First text of its own"), ("a/2", "Second text, other words"), ("b/1", "Third")])] + [(9, "http://alone.example/", "<div>Only one</div>")]
    out = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {0: "First text of its own", 1: "Second text, other words", 2: "Third", 9: "Only one"}


# ---- 4 warc


def test_normaliser_rewrites_any_gzip(tmp_path):
    records = [warc.record(i, f"http://x/{i}", b"p" * (i * 50), hashlib.sha1(b"p" * (i * 50)).hexdigest(), None) for i in range(40)]
    whole = gzip.compress(b"".join(records[:20])) + gzip.compress(b"".join(records[20:]))
    (tmp_path / "in.gz").write_bytes(whole)
    target = f"{tmp_path}/out.gz"
    index = list(warc.normalise(f"{tmp_path}/in.gz", target))
    with open(target, "rb") as f:
        for i in random.Random(3).sample(range(40), 40):
            _, offset, length, *_ = index[i]
            f.seek(offset)
            assert gzip.decompress(f.read(length)) == records[i]
    assert gzip.decompress(open(target, "rb").read()) == b"".join(records)
    assert sum(1 for _ in open(target + ".idx")) == 40
    with pytest.raises(ValueError):
        list(warc.split_records(iter([records[0][:-5]])))
    assert b"".join(warc.inflate(io.BytesIO(whole))) == b"".join(records)


def test_warc_revisits(spark):
    big, small = "x" * 1200, "y" * 10
    rows = [(1, big), (2, big), (3, small), (4, small), (5, big + "é"), (None, big)]
    out = {r["page_id"]: r for r in warc.archive_round_trip(spark.createDataFrame([(i, "http://u", h) for i, h in rows], "page_id long, url string, html string")).collect()}
    assert (out[1]["record_type"], out[1]["refers_to"]) == ("revisit", 2) and out[None]["refers_to"] == 2
    assert all(out[i]["record_type"] == "response" and out[i]["refers_to"] is None for i in (2, 3, 4, 5))
    assert out[5]["payload_bytes"] == 1202 and out[1]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()


# ---- 5 simhash


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_keys_of_fingerprints_within_four_bits_meet(fp, flips):
    other = fp
    for b in flips:
        other ^= 1 << b
    key, at = golay.keys(np.array([fp, other], np.uint64))
    assert set(key[at == 0]) & set(key[at == 1])
    assert len(key) <= 2 * 72


def test_fingerprint_counts_repeats():
    words = "a b c d e a b c d e a b c d".split()
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    assert golay.fingerprint("A b\tC d e a b c d e a b c  D") == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert golay.fingerprint("one two") == xxhash.xxh64_intdigest("one two", 42) and golay.fingerprint(None) == golay.fingerprint(" ") == 0


@pytest.mark.parametrize("block", [8192, 40])
def test_links_join_what_brute_force_joins(spark, block):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(30)]
    fps = {c ^ sum(1 << b for b in set(rng.choices(range(64), k=rng.randint(0, 5)))) for c in centres for _ in range(8)} | {centres[0] ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = golay.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), block=block).collect()
    assert all(((r["src"] ^ r["dst"]) & (2**64 - 1)).bit_count() <= 4 for r in found)
    nodes = sorted(map(signed, fps))
    near = [(a, b) for a, b in itertools.combinations(nodes, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    assert groups([(r["src"], r["dst"]) for r in found], nodes) == groups(near, nodes)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(100, 140)] + [(7, 7), (500, 501), (501, 502), (502, 500), (1, 0)]
    out = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    nodes = {x for e in edges for x in e}
    assert out == groups(edges, nodes)


# ---- 6 syncmers


def test_syncmers_are_context_free(spark):
    text = " ".join(f"w{i % 37}x{i % 11}" for i in range(300))
    moved = "some other words first " + text
    df = spark.createDataFrame([(text, moved)], "a string, b string").select(syncmers.anchors("a").alias("x"), syncmers.anchors("b").alias("y"), syncmers.positional_matches(syncmers.anchors("a"), syncmers.anchors("b")).alias("m")).first()
    a, b = {(x["hash"], x["pos"]) for x in df["x"]}, {(x["hash"], x["pos"] - 4) for x in df["y"]}
    assert a <= b and len(df["m"]) == len(df["x"])
    words = text.split()
    h = [xxhash.xxh64_intdigest(words[i + 1], xxhash.xxh64_intdigest(words[i], 42)) for i in range(len(words) - 1)]
    picked = [j for j in range(len(words) - syncmers.K + 1) if min(_s(h[j]), _s(h[j + 2])) <= _s(h[j + 1])]
    assert [x["pos"] for x in df["x"]] == picked


def _s(x):
    return x - (1 << 64) if x >> 63 else x


def test_edit_takes_the_next_row(spark):
    rows = [(5, "abcdefgh"), (1, "éé1234567890"), (3, "x"), (None, "null first " * 9)]
    out = {r["doc_id"]: r for r in syncmers.compare_with_edit(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1]["edited_sha256"] == sha("éé1234567" + "x") and out[3]["edited_sha256"] == sha("x")
    assert out[5]["edited_sha256"] == sha("abcdef" + "nu") and out[1]["n_chars"] == 12


def test_next_row_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET", 50)
    docs = spark.createDataFrame([(i * 3, f"text {i} " * 3) for i in range(200)], "doc_id long, text string")
    out = {r["doc_id"]: r["next_text"] for r in syncmers.with_next(docs, {}).collect()}
    assert out == {i * 3: f"text {(i + 1) % 200} " * 3 for i in range(200)}


# ---- 7 sharding


def test_shards_commit_compact_and_conflict(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * 100, f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    table = sharding.shard(docs, f"file://{tmp_path}/t", arrival=2000, target=9000)
    assert table.version() == 2
    out = table.read().collect()
    assert sorted(r["doc_id"] for r in out) == list(range(300))
    live = table.manifest().collect()
    assert sum(r["rows"] for r in live) == 300 and all(r["bytes"] <= 9000 + 4000 for r in live) and len(live) < 10
    table.append(docs.limit(5).selectExpr("*", "0 as __place"), "__place", 1)
    assert table.version() == 3 and table.read().count() == 305 and table.read(2).count() == 300
    with pytest.raises(sharding.CommitConflict):
        table.commit(table.manifest(3), 2)


# ---- 8 decontamination


def test_contamination_against_brute_force(spark):
    import re

    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(40)] + ["The", "été", "Été"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([5, 12, 13, 14, 40])))) for i in range(25)] + [(99, items_text := "The a b"), (98, items_text)]
    docs = []
    for i in range(60):
        words = rng.choices(vocab, k=rng.randint(0, 120))
        if i % 3 == 0:
            src = items[rng.randrange(25)][1].split()
            lo = rng.randrange(max(1, len(src) - 13))
            words[10:10] = src[lo : lo + rng.choice([12, 13, 20])]
        docs.append((i, " -- ".join(words).upper() if i % 2 else " ".join(words)))
    found = {r["doc_id"]: r for r in decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate(low))
    for i, text in docs:
        words, hit, named = cut(text), set(), set()
        for name, item in items:
            w = cut(item)
            n = min(13, len(w))
            for s in range(len(w) - n + 1):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == w[s : s + n]:
                        hit |= set(range(p, p + n))
                        named.add(str(name))
        r = found[i]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(words), len(hit), len(named))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(words))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y y gamma"), (2, "gamma " + "z " * 50 + "alpha")], "doc_id long, text string")
    found = decontam.proximity(docs, spark.createDataFrame([("i", "alpha beta gamma")], "item_id string, text string"), slop=4, share=1.0).collect()
    assert [(r["doc_id"], r["item_id"], r["n_terms"]) for r in found] == [(1, "i", 3)]


# ---- 9 language model


def test_model_is_a_distribution_and_learns(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=80)), "en" if i % 2 else None) for i in range(120)], "doc_id long, text string, lang string")
    rows = mixlm.score(docs).collect()
    held = [r for r in rows if r["held_out"]]
    per = lambda c: sum(r[c] for r in held) / sum(r["n_tokens"] for r in held)
    assert held and per("score") > -2.2 and abs(per("score") - per("base_score")) < 0.3


def test_weights_move_down_the_cost():
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["the", "then", "them", "a"], k=120)).encode() for _ in range(40)]
    data, starts = mixlm.stream(texts)
    code = mixlm.Code(*np.unique(mixlm.before(data, starts) << 8 | data, return_counts=True))
    bits = (14,) * mixlm.N_CONTEXTS
    counts = [np.zeros(2 << b, np.uint32) for b in bits]
    for which in mixlm.TOGETHER:
        mixlm.count(texts, code, bits, which, [counts[k] for k in which])
    assert {int(c.sum()) for c in counts} == {int(code.depth[code.symbols(data, starts)].sum())}  # every decision once
    model = mixlm.Model(bits, code, *map(list, zip(*[mixlm.Model.quantise(*c.reshape(-1, 2).T.astype(float)) for c in counts], strict=True)))
    short = [t[:200] for t in texts]
    before = model.costs(short).sum()
    model.costs(texts, True)
    assert model.costs(short).sum() > before


# ---- 10 language identification


def test_language_of_held_out_texts(spark):
    rng = random.Random(10)
    parts = {"x": ["th", "er", "ing", "and"], "y": ["ou", "eau", "lle", "que"], "z": ["sch", "ung", "ich", "ein"]}
    text = lambda p: " ".join("".join(rng.choices(p, k=rng.randint(1, 3))) for _ in range(40))
    docs = spark.createDataFrame([(i, text(p), lang) for i, (lang, p) in enumerate(list(parts.items()) * 60)], "doc_id long, text string, lang string")
    rows = langid.identify(docs).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in rows) and any(r["held_out"] for r in rows)


def test_code_lengths_are_exact():
    tree = langid.ContextTree([b"abracadabra", b"abra"])
    text = b"abrxa"
    total = 0.0
    seen = [bytes([10] * 4) + t for t in (b"abracadabra", b"abra")]
    padded = bytes([10] * 4) + text
    for i in range(4, len(padded)):
        bits = None
        for k in range(4, -1, -1):
            context, follow = padded[i - k : i], []
            for s in seen:
                follow += [s[j] for j in range(4, len(s)) if s[j - k : j] == context]
            if not follow:
                continue
            n, d = len(follow), len(set(follow))
            if (c := follow.count(padded[i])) > 0:
                total += np.log2((n + d) / c)
                bits = True
                break
            total += np.log2((n + d) / d)
        total += 0 if bits else 8
    import pyarrow as pa

    got = langid.Scorer([tree]).lengths(pa.array([text.decode(), None, "abrxa"]))
    assert got[0, 0] == pytest.approx(total, rel=1e-5) and got[1, 0] == 0 and got[2, 0] == got[0, 0]
