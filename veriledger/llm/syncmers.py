"""Document fingerprints from closed syncmers of words.

A K-word run is an anchor if the least hash among its S-word inner runs is that of the first or the
last one. Whether a run is an anchor depends on its own words only, so equal passages have equal
anchors wherever they stand, and of any K - S + 1 runs in a row one at least is an anchor: anchors
match by position. A fingerprint is all distinct anchor hashes of a text, so it grows with the text,
and likeness is the exact Jaccard likeness of two such sets. A text of few words has runs of
characters in place of words; two texts are compared in characters if one of them is such a text.
All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriledger.llm.common import store


K, S = 4, 2
#: Texts of fewer words, or of longer ones on average, have anchors of characters.
FEW, WIDE = 16, 16
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of text that a bucket of neighbours holds, the most buckets, the ids sampled to cut them.
BUCKET, MOST_BUCKETS, SAMPLE = 4 << 20, 4096, 100_000


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def anchors(text: Column) -> Column:
    """array<struct<hash, pos>> of the closed syncmers in word order; pos counts words from 0. A
    text of fewer than K words, but not none, is one anchor. Null and empty texts have none."""
    return _chosen(_words(text))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def _chosen(units: Column) -> Column:
    inner = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda x, y: F.xxhash64(x, y))
    last = K - S

    def chosen(h: Column) -> Column:
        at = lambda j, i: F.get(h, j + i)
        edge = lambda j: F.least(at(j, 0), at(j, last)) == F.least(*[at(j, i) for i in range(last + 1)])
        starts = F.filter(F.sequence(F.lit(0), F.size(h) - last - 1), edge)
        return F.transform(starts, lambda j: F.struct(F.xxhash64(*[at(j, i) for i in range(0, last + 1, S)]).alias("hash"), j.alias("pos")))

    short = lambda w: F.array(F.struct(F.xxhash64(w).alias("hash"), F.lit(0).alias("pos")))
    none = F.array().cast("array<struct<hash:bigint,pos:int>>")
    return _let(units, lambda w: F.when(F.size(w) == 0, none).when(F.size(w) < K, short(w)).otherwise(_let(inner(w), chosen)))


def _letters(text: Column) -> Column:
    """The code points of a text, for anchors; of a text without words none."""
    return F.when(F.size(_words(text)) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def few_words(text: Column) -> Column:
    """Whether words are too few, or too long as in scripts without spaces, to be the units."""
    return _let(F.size(_words(text)), lambda n: (n < FEW) | (F.length(text) > n * WIDE))


def hashes(found: Column) -> Column:
    """The distinct hashes of all anchors, in order."""
    return F.array_sort(F.array_distinct(F.transform(found, lambda a: a["hash"])))


def fingerprint(own: Column) -> Column:
    """Hashes as text: 16 hex digits an anchor; empty for a text without words."""
    return F.lower(F.array_join(F.transform(own, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes; two empty ones are alike."""
    return _let(F.size(F.array_union(a, b)), lambda n: F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / n))


def positional_matches(a: Column, b: Column) -> Column:
    """array<struct<hash, pos, other>>: anchors of array a whose hash b has, with the first place."""
    places = F.map_from_entries(F.transform(F.array_distinct(F.transform(b, lambda x: x["hash"])), lambda h: F.struct(h, F.get(F.filter(b, lambda y: y["hash"] == h), 0)["pos"])))
    return _let(places, lambda m: F.filter(F.transform(a, lambda x: F.struct(x["hash"].alias("hash"), x["pos"].alias("pos"), F.element_at(m, x["hash"]).alias("other"))), lambda x: x["other"].isNotNull()))


def _bucket(key: Column, bounds: list[Column]) -> Column:
    """How many bounds are at most key, looked up in two steps of about a root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    upto = lambda xs: F.size(F.filter(xs, lambda b: b <= key))
    coarse = upto(F.array(*[c[0] for c in chunks]))
    fine = F.get(F.array(*[F.array(*c) for c in chunks]), coarse - 1)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + upto(fine)).cast("int")


def with_next(docs: DataFrame, value: dict[str, Column]) -> DataFrame:
    """docs' doc_id and text (null: empty) with `value`s, and next_text and next_ of each value:
    those of the row after it in ascending doc_id (null first; rows of one id in the order of a hash
    of their text), after the last the first. Rows are dealt into buckets of neighbours in that order
    that hold about BUCKET bytes, rows of one id too, and each bucket also gets the first row of the
    next: the text moves once, and no task sees all ids. Past MOST_BUCKETS buckets they grow; they
    are sorted outside memory, so only their time does."""
    kind = docs.schema["doc_id"].dataType
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = max(1, min(MOST_BUCKETS, -(-(size["bytes"] or 0) // BUCKET)))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    some = docs.sample(min(1.0, SAMPLE / max(size["n"], 1)), 7).select(key.alias("k")).select("k.*").collect() if buckets > 1 else []
    ids = sorted((tuple(r) for r in some), key=lambda r: (r[0], r[1] if r[0] else 0, r[2]))
    cuts = list(dict.fromkeys(ids[i * len(ids) // buckets] for i in range(1, buckets))) if ids else []
    bounds = [F.struct(F.lit(k).alias("known"), F.lit(i).cast(kind).alias("id"), F.lit(h).cast("long").alias("h")) for k, i, h in cuts if (k, i, h) != ids[0]]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"), _bucket(key, bounds).alias("bucket"))
    least = store(rows.groupBy("bucket").agg(F.min("key").alias("first")), "syncmer-buckets")  # MOST_BUCKETS rows at most
    heads = rows.join(F.broadcast(least.limit(MOST_BUCKETS + 1)), "bucket").where(F.col("key") == F.col("first")).groupBy("bucket").agg(F.min("text").alias("text"))
    order = Window.orderBy(F.desc("bucket"))
    # the bucket before gets this one's first text; the last bucket the first one's
    before = F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(order))
    halo = heads.select(F.lit(None).cast(kind).alias("doc_id"), "text", before.alias("bucket"), F.lit(1).alias("halo"))
    every = rows.drop("key").withColumn("halo", F.lit(0)).unionByName(halo).select("*", *[v.alias(k) for k, v in value.items()])
    near = Window.partitionBy("bucket").orderBy("halo", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    out = every.select("*", *[F.lead(c).over(near).alias(f"next_{c}") for c in ("text", *value)])
    return out.where("halo = 0").drop("halo", "bucket")


def compare_with_edit(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of
    every row: the text against itself with the last quarter (floor) of its code points replaced by
    as many from the start of the next row's text, or all of it, and against that text.

    Null texts are empty; repeated rows are rows of their own and may follow each other; a lone row
    follows itself; extra columns are ignored; an empty table gives no rows.
    """
    rows = with_next(docs, {})
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 4).cast("int")), F.substring(F.col("next_text"), F.lit(1), F.floor(n / 4).cast("int")))
    texts = {"own": F.col("text"), "changed": F.col("edited"), "next": F.col("next_text")}
    out = rows.withColumn("edited", edited).withColumns({f"few_{k}": few_words(v) for k, v in texts.items()})
    out = out.withColumns({k: hashes(anchors(v)) for k, v in texts.items()})
    letters = lambda k: hashes(_chosen(_letters(texts[k])))
    near = lambda k: F.when(F.col("few_own") | F.col(f"few_{k}"), likeness(letters("own"), letters(k))).otherwise(likeness(F.col("own"), F.col(k)))
    shown = lambda k: fingerprint(F.when(F.col(f"few_{k}"), letters(k)).otherwise(F.col(k)))
    return out.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), shown("own").alias("fingerprint"), shown("changed").alias("edited_fingerprint"), near("changed").alias("near_edited"), near("next").alias("near_next"))


__all__ = ["anchors", "compare_with_edit", "few_words", "fingerprint", "hashes", "likeness", "positional_matches", "with_next"]
