"""Language identification by prediction by partial matching.

One byte context tree per language, of variable order up to ORDER, is counted on a bounded sample
of labelled rows and then frozen. A byte costs the escapes from the longest context that the tree
knows plus its code there (escape method C: a context with n occurrences of d different bytes
gives a byte seen k times k/(n+d) and the escape d/(n+d)); under order 0 every byte costs 8 bits.
The cost depends on the last ORDER bytes and the byte only, so each distinct (ORDER+1)-gram of a
batch is looked up once and every position of every text then takes its exact code length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriledger.llm.common import bounded_broadcast, store

ORDER = 4
FOLDS = 5
#: Bounds of the fitting sample: rows of a language, bytes of a row, bytes of all languages.
SAMPLE_ROWS, ROW_BYTES, SAMPLE_BYTES = 400, 65_536, 16_000_000
#: Bytes of text from which one language is learned.
LANGUAGE_BYTES = 1_500_000
UNDETERMINED = "und"
START = 10  # the byte that stands before a text
WINDOW = 1 << 21  # positions worked on at once


def grams(data: np.ndarray) -> np.ndarray:
    """The (ORDER+1)-gram that ends at each byte of data from index ORDER on, packed."""
    code = np.zeros(len(data) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        code = (code << np.uint64(8)) | data[k : len(data) - ORDER + k].astype(np.uint64)
    return code


class ContextTree:
    """Frozen counts of one language."""

    def __init__(self, texts: list[bytes]):
        start = bytes([START]) * ORDER
        codes = np.concatenate([grams(np.frombuffer(start + t, np.uint8)) for t in texts if t] or [np.zeros(0, np.uint64)])
        self.tables = []
        for k in range(ORDER + 1):
            gram, count = np.unique(codes & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
            context, first, distinct = np.unique(gram >> np.uint64(8), return_index=True, return_counts=True)
            total = np.add.reduceat(count, first) if len(gram) else count
            self.tables.append((gram, count, context, total, distinct))

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram after the bytes before it."""
        out, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
        for k in range(ORDER, -1, -1):
            gram, count, context, total, distinct = self.tables[k]
            code = codes & np.uint64((1 << 8 * (k + 1)) - 1)
            c, known = self.find(context, code >> np.uint64(8))
            s, seen = self.find(gram, code)
            if not len(gram):
                continue
            weight = np.log2(total[c] + distinct[c])
            out += np.where(open_ & seen, weight - np.log2(count[s]), 0) + np.where(open_ & known & ~seen, weight - np.log2(distinct[c]), 0)
            open_ &= ~seen
        return out + 8.0 * open_


def fit(rows: list[tuple[str, str]], order_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[ContextTree]]:
    """Trees from (lang, text) rows; each language gets an equal part of order_bytes, LANGUAGE_BYTES
    at most."""
    by: dict[str, list[bytes]] = {}
    for lang, text in rows:
        by.setdefault(lang, []).append(text.encode("utf-8", "replace"))
    langs, trees = sorted(by), []
    for lang in langs:
        kept, room = [], min(LANGUAGE_BYTES, order_bytes // max(1, len(langs)))
        for t in by[lang]:
            kept.append(t[:room])
            room -= len(t)
            if room <= 0:
                break
        trees.append(ContextTree(kept))
    return langs, trees


def held_out(doc_id, folds: int = FOLDS):
    """crc32 of the id's text is a multiple of folds. A null id reads as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """At most `rows` labelled training rows of each language, those of least hash, each cut to
    ROW_BYTES characters, and of these only as many as give LANGUAGE_BYTES. The limits are applied
    before texts move, so no more than that reaches the driver."""
    train = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.octet_length("text"))
    train = train.select("lang", F.md5(name.cast("binary")).alias("h"), F.substring("text", 1, ROW_BYTES).alias("head")).withColumn("size", F.octet_length("head"))
    # ranked in 256 parts of a language first, so that one with most rows doesn't meet in one task
    part = Window.partitionBy("lang", F.substring("h", 1, 2)).orderBy("h")
    some = train.select("lang", "h", "size").withColumn("r", F.row_number().over(part)).where(F.col("r") <= max(2, rows // 32))
    whole = Window.partitionBy("lang").orderBy("h")
    first = some.groupBy("lang", "h").agg(F.max("size").alias("size"))
    before = F.coalesce(F.sum("size").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    best = first.withColumn("before", before).withColumn("r", F.row_number().over(whole)).where((F.col("r") <= rows) & (F.col("before") < LANGUAGE_BYTES)).select("lang", "h")
    taken = train.join(bounded_broadcast(store(best, "language-sample")), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("head").alias("head"))
    return [(x["lang"], x["head"]) for x in sorted(taken.collect(), key=lambda x: (x["lang"], x["h"]))]


class Scorer:
    """Code lengths of whole texts under every tree; remembers grams it has priced."""

    def __init__(self, trees: list[ContextTree], keep: int = 2_000_000):
        self.trees, self.keep = trees, keep
        self.known, self.price = np.zeros(0, np.uint64), np.zeros((0, len(trees)), np.float32)

    def prices(self, codes: np.ndarray) -> np.ndarray:
        at, hit = ContextTree.find(self.known, codes)
        if len(new := np.unique(codes[~hit])):
            price = np.stack([t.bits(new) for t in self.trees], 1).astype(np.float32)
            if len(self.known) > self.keep:
                self.known, self.price = self.known[:0], self.price[:0]
                new = np.unique(codes)
                price = np.stack([t.bits(new) for t in self.trees], 1).astype(np.float32)
            keys = np.concatenate([self.known, new])
            order = np.argsort(keys, kind="stable")
            self.known, self.price = keys[order], np.concatenate([self.price, price])[order]
            at, _ = ContextTree.find(self.known, codes)
        return self.price[at]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of each text under each tree."""
        a = texts.cast(pa.large_string()).fill_null("")
        buffers = a.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[a.offset : a.offset + len(a) + 1]
        data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        n, sizes = len(a), np.diff(offsets)
        padded = np.full(len(data) + ORDER * (n + 1), START, np.uint8)
        begin = offsets[:-1] - offsets[0] + ORDER * np.arange(1, n + 1)
        for i in range(n):  # one copy a text
            o = offsets[i] - offsets[0]
            padded[begin[i] : begin[i] + sizes[i]] = data[o : o + sizes[i]]
        out, end = np.zeros((n, len(self.trees))), begin + sizes
        for lo in range(ORDER, len(padded), WINDOW):
            hi = min(lo + WINDOW, len(padded))
            ids, distinct = pd.factorize(grams(padded[lo - ORDER : hi]))
            price = self.prices(distinct)
            first, last = np.searchsorted(end, lo, "right"), np.searchsorted(begin, hi, "left")
            x, y = np.clip(begin[first:last], lo, hi) - lo, np.clip(end[first:last], lo, hi) - lo
            for k in range(len(self.trees)):
                run = np.concatenate([[0.0], np.cumsum(price[:, k][ids], dtype=np.float64)])
                out[first:last, k] += run[y] - run[x]
        return out


def verdict(scorer: Scorer, names: list[str], texts: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, posterior and bits a byte of each text; `und` and 0 where `letters` is false."""
    bits = scorer.lengths(texts)
    best = bits.argmin(1)
    least = bits[np.arange(len(bits)), best]
    share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
    size = np.array([len(x) for x in texts.cast(pa.binary()).fill_null(b"").to_pylist()])
    return np.where(letters, np.array(names, object)[best], UNDETERMINED), np.where(letters, share, 0.0), least / np.maximum(size, 1)


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte for every row of docs.

    Fitted on the labelled rows of docs outside the held-out fold. lang_pred is the language with
    the shortest code of the whole text (ties: the first by name), or `und`, score 0, if the text
    is null or has no letter or if there was nothing to learn from. score is the posterior of the
    choice under equal priors. Repeated rows are scored alike; extra columns are ignored.
    """
    langs, trees = fit(training_sample(docs, sample_rows))
    model = docs.sparkSession.sparkContext.broadcast((langs, trees))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, scorer = model.value[0], None
        for batch in batches:
            scorer = scorer or Scorer(model.value[1])
            texts, letters, n = batch.column("text"), batch.column("letters").to_numpy(zero_copy_only=False), batch.num_rows
            pred, conf, rate = np.full(n, UNDETERMINED, object), np.zeros(n), np.zeros(n)
            if names and n:
                pred, conf, rate = verdict(scorer, names, texts, letters)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(conf, pa.float64()), pa.array(rate, pa.float64())], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits_per_byte double")


def keep_identified(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that identify() gives a language, whatever its score; columns stay.

    The text rides along in the same pass, so rows are neither joined nor shuffled. Null texts
    and texts without letters go, and all rows if there was nothing to learn from.
    """
    langs, trees = fit(training_sample(docs, sample_rows))
    model = docs.sparkSession.sparkContext.broadcast((langs, trees))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(model.value[1])
            if not model.value[0] or not batch.num_rows:
                continue
            pred = verdict(scorer, model.value[0], batch.column("text"), np.ones(batch.num_rows, bool))[0]
            yield batch.filter(pa.array(pred != UNDETERMINED))

    return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(keep, docs.schema)
