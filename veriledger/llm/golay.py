"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Fingerprints are cut into segments of 23, 23 and 18 bits (the last padded with zeros). The binary
Golay code of length 23 is perfect: each word lies within 3 bits of one codeword. A segment's fuzzy
keys are the codewords within 4 bits of it, 6 at most, and two words within 2 bits of each other
always have one in common, since a word halfway between them lies within 3 bits of some codeword.

Two fingerprints with at most 4 differing bits differ in their segments by e1 + e2 + e3 <= 4, so
- if some segment agrees, another differs by 2 bits at most: one exact segment beside the fuzzy
  keys of another, 6 ordered pairs of segments with up to 6 keys each;
- else the errors are 1, 1, 1 or 1, 1, 2 in some order: fuzzy keys of the two long segments, 36.
Up to 72 keys a fingerprint thus find every link. Rows are grouped by key in one shuffle and each
group is verified bit by bit where it arrives; only the links of a spanning forest leave a group,
so rows stay in proportion to keys however dense a group is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriledger.llm.common import bounded_broadcast, store
from veriledger.llm.components import connected_components

SHINGLE, SEED, BITS = 4, 42, 4
#: Bits of the three segments: first bit and length.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fixed value: the generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
#: Distinct fingerprints of a key that one task verifies; more are dealt out in blocks of this size.
BLOCK = 8192


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each 23-bit word, error patterns by syndrome: the nearest codeword's first,
    then those of weight 4; unused places repeat the first)."""
    syndrome = np.arange(1 << 23, dtype=np.uint32)
    for bit in range(22, 10, -1):
        syndrome = np.where(syndrome >> bit & 1, syndrome ^ (GENERATOR << (bit - 11)), syndrome)
    patterns: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            error = sum(1 << p for p in places)
            patterns[int(syndrome[error])].append(error)
    table = np.array([p + p[:1] * (6 - len(p)) for p in patterns], np.uint32)
    return syndrome.astype(np.uint16), table


def fuzzy(words: np.ndarray) -> np.ndarray:
    """Indices (upper 12 bits of the codeword) of the codewords within 4 bits: rows of 6."""
    syndrome, table = golay()
    return (words[:, None] ^ table[syndrome[words]]) >> 11


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the fingerprint) of all keys, without repeats of one fingerprint."""
    seg = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in SEGMENTS]
    near = [fuzzy(s).astype(np.uint64) for s in seg]
    parts = []
    for kind, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        parts.append(np.uint64(kind) << np.uint64(40) | seg[i].astype(np.uint64)[:, None] << np.uint64(12) | near[j])
    parts.append((np.uint64(6) << np.uint64(40) | near[0][:, :, None] << np.uint64(12) | near[1][:, None, :]).reshape(len(fps), 36))
    every = np.sort(np.concatenate(parts, 1), 1)
    fresh = np.ones(every.shape, bool)
    fresh[:, 1:] = every[:, 1:] != every[:, :-1]
    return every[fresh], np.repeat(np.arange(len(fps)), fresh.sum(1))


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of word shingles, repeats included; 0 if there is no word."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        h, s = xxhash.xxh64_intdigest, SEED
        hashes = np.array([h(line[a:b], s) for a, b in zip(begins[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((ones * 2 > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row of docs, over the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


class Forest:
    """Union-find over positions 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def forest_links(fps: np.ndarray, other: np.ndarray | None = None, bits: int = BITS) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints within `bits` of each other; with other,
    of the links between the two arrays. Every pair is compared, none is kept that joins nothing."""
    b = fps if other is None else other
    base = 0 if other is None else len(fps)
    tree, out = Forest(len(fps) + (0 if other is None else len(b))), []
    for lo in range(0, len(fps), 512):
        x, y = np.nonzero(np.bitwise_count(fps[lo : lo + 512, None] ^ b[None, :]) <= bits)
        x = x + lo
        if other is None:
            x, y = x[x < y], y[x < y]
        for i, j in zip(x.tolist(), y.tolist()):
            if tree.join(i, base + j):
                out.append((int(fps[i]), int(b[j])))
    return out


def links(distinct: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """src, dst: links between the distinct fingerprints of column fp whose components are those
    of all pairs that differ by at most `bits` (4 or less) bits."""
    assert 0 <= bits <= 4

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for lo in range(0, len(fps), 8192):
                part = fps[lo : lo + 8192]
                key, at = keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part[at].view(np.int64))], ["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key. Yields links (key null), or the key of a group over `block`."""
        held_key, held_fp, large, passed = np.zeros(0, np.int64), np.zeros(0, np.uint64), None, 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            k, a, b = zip(*rows) if rows else ((), (), ())
            wrap = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), wrap(a), wrap(b)], ["key", "src", "dst"])

        def work(key: np.ndarray, fp: np.ndarray) -> list[tuple]:
            rows: list[tuple] = []
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            size = np.diff(edge)
            small = np.repeat((size > 1) & (size <= 16), size)
            k, f = key[small], fp[small]
            for shift in range(1, min(16, len(f))):
                hit = np.flatnonzero((k[shift:] == k[:-shift]) & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= bits))
                rows += [(None, a, b) for a, b in zip(f[hit].tolist(), f[hit + shift].tolist())]
            for g in np.flatnonzero(size > 16).tolist():
                group = np.unique(fp[edge[g] : edge[g + 1]])
                if len(group) > block:
                    rows.append((int(key[edge[g]]), 0, len(group)))
                else:
                    rows += [(None, a, b) for a, b in forest_links(group, None, bits)]
            return rows

        for batch in batches:
            key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if large is not None:  # the rest of a large group is only counted
                past = int(np.searchsorted(key, large, "right"))
                passed, key, fp = passed + past, key[past:], fp[past:]
                if not len(key):
                    continue
                yield out([(large, 0, passed)])
                large = None
            key, fp = np.concatenate([held_key, key]), np.concatenate([held_fp, fp])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield out(work(key[:cut], fp[:cut]))
            held_key, held_fp = key[cut:], fp[cut:]
            if len(held_key) > block:
                large, passed = int(held_key[0]), len(held_key)
                held_key, held_fp = held_key[:0], held_fp[:0]
        if large is not None:
            yield out([(large, 0, passed)])
        if len(held_key):
            yield out(work(held_key, held_fp))

    keyed = distinct.select("fp").mapInArrow(expand, "key long, fp long")
    found = store(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "key long, src long, dst long"), "golay-links")
    within = found.where("key is null").select("src", "dst").distinct()
    heavy = found.where("key is not null").select("key", (F.ceil(F.col("dst") / block)).cast("int").alias("blocks"))
    if heavy.isEmpty():
        return within

    # each pair of blocks of a large group is a task of its own; a heavy key has over `block` rows
    def across(pdf):
        import pandas as pd

        half = [pdf["fp"][pdf["half"] == h].to_numpy().view(np.uint64) for h in (0, 1)]
        rows = forest_links(half[0], None, bits) if pdf["a"].iloc[0] == pdf["b"].iloc[0] else forest_links(half[0], half[1], bits)
        return pd.DataFrame(np.array(rows, np.uint64).reshape(-1, 2).view(np.int64), columns=["src", "dst"])

    dealt = keyed.join(bounded_broadcast(heavy), "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "fp", F.least("own", "peer").alias("a"), F.greatest("own", "peer").alias("b"), (F.col("own") > F.col("peer")).cast("int").alias("half"))
    return within.union(dealt.groupBy("key", "a", "b").applyInPandas(across, "src long, dst long")).distinct()


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id for every row of docs.

    Rows whose fingerprints differ by at most `bits` bits are linked; component_id is the smallest
    doc_id reachable, the row's own included. Null and empty texts have fingerprint 0 and link as
    any other. Null ids never are a component's smallest; repeated rows stay repeated. Extra
    columns are ignored.
    """
    rows = store(fingerprints(docs), "simhash")
    first = store(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    comp = connected_components(links(first, bits))
    # only fingerprints with links: (fp, root)
    tagged = first.join(comp, first["fp"] == comp["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = tagged.groupBy("root").agg(F.min("first").alias("component_id"))
    label = tagged.select("fp", "root").join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(label, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """docs with one row of each near-duplicate group, that of the smallest doc_id; columns stay.

    Rows are told apart by doc_id and text: rows without an id come after all others and are compared
    like any other, rows that share an id are rows of their own, repeated rows are one. Null and
    empty texts have fingerprint 0 and are one group.
    """
    kind = docs.schema["doc_id"].dataType
    blank = F.lit("" if kind.simpleString() == "string" else 0).cast(kind)
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", blank).alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    pairs = near_duplicates(docs.select(key.alias("doc_id"), "text"), bits)
    kept = pairs.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__kept")).distinct()
    named = docs.withColumn("__key", key)
    return named.join(kept, named["__key"] == kept["__kept"], "left_semi").dropDuplicates(["__key"]).drop("__key")
