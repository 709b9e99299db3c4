"""Benchmark decontamination over a distributed positional inverted index.

The corpus is tokenised and the terms that the test items use are counted. Each window of an item
is looked up by its rarest term: postings (term, document, position, words on either side) are
stored for just those terms, a posting list is shifted by the term's place in the item, and the
lists meet word for word on both sides of the anchor, which gives the whole run of words that
document and item share there. A run as long as a window is an exact phrase match; a window whose
rarest term has no posting can't occur. For near matches the posting lists of each item's rarest
terms are shifted and intersected by position (proximity). Test terms are looked up in the corpus scan itself, so the
corpus is never shuffled. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriledger.llm.common import bounded_broadcast, lower_ascii, store

#: What stands between words: ASCII but letters and digits. Words of either case are cut alike.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: A document is contaminated if its hit words are 1 in this many or more.
SHARE = 20
#: Near matches: rare terms of an item that are looked up, the share of them that must stand near
#: each other, and by how many words their distances may differ from the item's.
NEAR_TERMS, NEAR_SHARE, SLOP = 8, 0.75, 6


def tokens(text: Column) -> Column:
    """The words of a text in order, letter case kept; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def _side(words: Column, pos: Column, left: bool) -> Column:
    """Up to WINDOW - 1 words before (nearest first) or after position pos (from 0)."""
    n = WINDOW - 1
    if left:
        return F.reverse(F.slice(words, F.greatest(pos - n, F.lit(0)) + 1, F.least(pos, F.lit(n))))
    return F.slice(words, pos + 2, n)


def _same(a: Column, b: Column) -> Column:
    """How many leading words two arrays share."""
    n = F.least(F.size(a), F.size(b))
    first = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x != y), True)
    return F.when(first == 0, n).otherwise(first - 1).cast("int")


def item_classes(benchmark: DataFrame) -> DataFrame:
    """cls, words, n, ids: the test items that have words, those of equal words together."""
    words = tokens(lower_ascii(F.col("text")))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), words.alias("words"))
    out = items.where(F.size("words") > 0).groupBy("words").agg(F.collect_set("id").alias("ids"))
    return out.select(F.monotonically_increasing_id().alias("cls"), "words", F.size("words").alias("n"), "ids")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """folded, count: occurrences in the corpus of the terms, under full case folding. That joins
    a few terms that the index tells apart, which is safe for choosing and for ruling out."""
    words = docs.select(F.explode_outer(tokens(F.col("text"))).alias("w")).select(F.lower("w").alias("folded"))
    return words.join(bounded_broadcast(terms, 1_000_000), "folded").groupBy("folded").agg(F.count("*").alias("count"))


def anchors(classes: DataFrame, counts: DataFrame) -> DataFrame:
    """cls, n, q, term, left, right: for each window of each item its rarest term (then the first
    by name) and where it stands, once each. Windows with a term the corpus lacks have none."""
    spread = classes.select("cls", F.posexplode("words").alias("q", "term")).withColumn("folded", F.lower("term"))
    rated = spread.join(bounded_broadcast(counts, 1_000_000), "folded", "left").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("q", F.coalesce("count", F.lit(0)).alias("count"), "term"))).alias("rated"))
    by_rarity = F.transform("rated", lambda x: F.struct(x["count"].alias("count"), x["term"].alias("term"), x["q"].alias("q")))
    starts = F.sequence(F.lit(0), F.greatest(F.size("by") - WINDOW, F.lit(0)))
    picked = rated.select("cls", by_rarity.alias("by")).select("cls", F.explode(F.array_distinct(F.transform(starts, lambda s: F.array_min(F.slice("by", s + 1, WINDOW))))).alias("a")).where("a.count > 0")
    return picked.join(classes.select("cls", "words", "n"), "cls").select("cls", "n", F.col("a.q").alias("q"), F.col("a.term").alias("term"), _side(F.col("words"), F.col("a.q"), True).alias("left"), _side(F.col("words"), F.col("a.q"), False).alias("right"))


def positional_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored inverted index over the terms (column term): term, doc_id, text_hash, pos, left,
    right. Extra columns of docs are ignored; repeated rows repeat their postings."""
    wanted = bounded_broadcast(terms.select(F.lower("term").alias("folded")).distinct(), 1_000_000)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), tokens(F.col("text")).alias("words"))
    each = rows.select("doc_id", "text_hash", "words", F.posexplode_outer("words").alias("pos", "w")).withColumn("folded", F.lower("w"))
    low = lambda a: F.transform(a, lower_ascii)
    found = each.join(wanted, "folded")
    return store(found.select(lower_ascii(F.col("w")).alias("term"), "doc_id", "text_hash", "pos", low(_side(F.col("words"), F.col("pos"), True)).alias("left"), low(_side(F.col("words"), F.col("pos"), False)).alias("right")), "postings")


def phrase_matches(index: DataFrame, anchor: DataFrame) -> DataFrame:
    """doc_id, text_hash, cls, first, last: runs of document words that equal the item's words and
    are a window long or more (of a shorter item: all of it)."""
    a = bounded_broadcast(anchor.select("cls", "n", "term", F.col("left").alias("item_left"), F.col("right").alias("item_right")), 200_000)
    met = index.join(a, "term").withColumn("before", _same(F.col("left"), F.col("item_left"))).withColumn("after", _same(F.col("right"), F.col("item_right")))
    met = met.where(F.col("before") + F.col("after") + 1 >= F.least(F.col("n"), F.lit(WINDOW)))
    return met.select("doc_id", "text_hash", "cls", (F.col("pos") - F.col("before")).alias("first"), (F.col("pos") + F.col("after")).alias("last"))


def rare_terms(classes: DataFrame, counts: DataFrame, most: int = NEAR_TERMS) -> DataFrame:
    """cls, n_rare, q, term: the `most` rarest distinct terms of each item (then by name) that the
    corpus has, at every place where they stand in it. n_rare is how many terms they are."""
    spread = classes.select("cls", F.posexplode("words").alias("q", "term")).withColumn("folded", F.lower("term"))
    rated = spread.join(bounded_broadcast(counts, 1_000_000), "folded")
    order = Window.partitionBy("cls").orderBy("count", "term")
    kept = rated.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= most)
    return kept.select("cls", F.max("r").over(Window.partitionBy("cls")).alias("n_rare"), "q", "term")


def term_postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored posting lists of the terms (column term) by themselves: term, doc_id, text_hash,
    pos. Repeated rows share theirs."""
    wanted = bounded_broadcast(terms.select(F.lower("term").alias("folded")).distinct(), 1_000_000)
    each = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode_outer(tokens(F.col("text"))).alias("pos", "w")).withColumn("folded", F.lower("w"))
    return store(each.join(wanted, "folded").select(lower_ascii(F.col("w")).alias("term"), "doc_id", "text_hash", "pos").distinct(), "term-postings")


def proximity_matches(postings: DataFrame, rare: DataFrame, slop: int = SLOP, share: float = NEAR_SHARE) -> DataFrame:
    """doc_id, text_hash, cls, n_terms: items of whose rare terms (rare_terms) at least `share`, and
    two, stand in a document at the item's own distances, give or take `slop` words. Each list is
    shifted by its term's place in the item; shifted lists meet where the terms stand as in the item,
    and within a window of slop + 1 shifts where words were put in or left out."""
    a = bounded_broadcast(rare, 200_000)
    near = Window.partitionBy("doc_id", "text_hash", "cls").orderBy("shift").rangeBetween(0, slop)
    met = postings.join(a, "term").select("doc_id", "text_hash", "cls", "n_rare", "term", (F.col("pos") - F.col("q")).cast("long").alias("shift"))
    out = met.withColumn("k", F.size(F.collect_set("term").over(near))).groupBy("doc_id", "text_hash", "cls", "n_rare").agg(F.max("k").alias("n_terms"))
    return out.where((F.col("n_terms") >= 2) & (F.col("n_terms") >= F.ceil(share * F.col("n_rare")))).drop("n_rare")


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP, share: float = NEAR_SHARE) -> DataFrame:
    """doc_id, item_id, n_terms: the items that documents quote nearly, with words changed, put in or
    left out, one row for each document (rows of one id and text are one) and item.

    Items of one distinct term have no neighbours and no match. Null and empty texts match nothing;
    an empty benchmark or corpus gives no rows; a null item_id counts as an empty one.
    """
    classes = store(item_classes(benchmark), "bench-items")
    counts = store(term_counts(docs, store(classes.select(F.explode("words").alias("term")).select(F.lower("term").alias("folded")).distinct(), "bench-terms")), "bench-counts")
    rare = store(rare_terms(classes, counts), "bench-rare")
    found = proximity_matches(term_postings(docs, rare), rare, slop, share)
    named = found.join(bounded_broadcast(classes.select("cls", F.explode("ids").alias("item_id"))), "cls")
    return named.groupBy("doc_id", "text_hash", "item_id").agg(F.max("n_terms").cast("long").alias("n_terms")).drop("text_hash")


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_hit, ids (sorted array of item ids) of the documents with a match."""
    classes = store(item_classes(benchmark), "bench-items")
    terms = classes.select(F.explode("words").alias("term")).select(F.lower("term").alias("folded")).distinct()
    counts = store(term_counts(docs, store(terms, "bench-terms")), "bench-counts")
    anchor = store(anchors(classes, counts), "bench-anchors")
    runs = store(phrase_matches(positional_index(docs, anchor), anchor), "bench-runs")
    order = Window.partitionBy("doc_id", "text_hash").orderBy("first", "last")
    past = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(past, F.lit(-1))), F.lit(0))
    spans = runs.select("doc_id", "text_hash", "first", "last").distinct()
    counted = spans.withColumn("new", fresh).groupBy("doc_id", "text_hash").agg(F.sum("new").alias("n_hit"))
    named = runs.select("doc_id", "text_hash", "cls").distinct().join(bounded_broadcast(classes.select("cls", "ids")), "cls")
    named = named.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    same = counted["doc_id"].eqNullSafe(named["doc_id"]) & (counted["text_hash"] == named["text_hash"])
    return counted.join(named, same).select(counted["doc_id"], counted["text_hash"], "n_hit", "ids")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    Null and empty texts have no words and no hit; an empty benchmark hits nothing. Items of equal
    words all count; a null item_id counts as an empty one. Repeated rows get equal results. Extra
    columns are ignored.
    """
    found = store(hits(docs, benchmark), "bench-hits")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(tokens(F.col("text"))).cast("long").alias("n_words"))
    other = bounded_broadcast(found, 20_000).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "n_hit", "ids")
    out = rows.join(other, rows["doc_id"].eqNullSafe(other["hit_id"]) & (rows["text_hash"] == other["hit_hash"]), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    ids = F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * SHARE >= F.col("n_words"))).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated; columns stay. Null and empty texts are clean,
    repeated rows go or stay alike, an empty benchmark keeps all rows. Only the documents with a match,
    few beside the corpus, are told apart by a join."""
    found = hits(docs, benchmark)
    words = F.size(tokens(F.col("text")))
    other = store(found.select(F.col("doc_id").alias("__hit_id"), F.col("text_hash").alias("__hit_hash"), F.col("n_hit").alias("__n_hit")), "bench-hits")
    same = docs["doc_id"].eqNullSafe(other["__hit_id"]) & (F.xxhash64(docs["text"]) == other["__hit_hash"]) & (other["__n_hit"] * SHARE >= words)
    return docs.join(bounded_broadcast(other, 1_000_000), same, "left_anti")


__all__ = ["anchors", "contamination", "hits", "item_classes", "keep_clean", "phrase_matches", "positional_index", "proximity", "proximity_matches", "rare_terms", "term_counts", "term_postings", "tokens"]
