"""The memory of earlier documents: recording, and finding repeats in three tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriledger.functions.numbers import days_between
from veriledger.functions.text import normalise_doc_number, number_core

WINDOW_DAYS, SHORTEST_CORE, HISTORY = 10, 4, 200
#: Days between documents that come monthly, and how many make a rhythm.
RHYTHM, PRIOR = (25, 35), 3
#: Ranges of ids that are numbered apart.
RANGES = 128


def with_keys(docs: DataFrame) -> DataFrame:
    """docs (doc_number) with number_key and number_core."""
    return docs.withColumns({"number_key": normalise_doc_number(F.col("doc_number")), "number_core": number_core(F.col("doc_number"))})


def record(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """docs as ledger rows, numbered after the last; append them by a write. Numbers follow doc_id
    (null last), so that a retried write gives the same ones. A row's number is its place in its range
    of ids after the rows of the ranges before; ranges are cut at fixed ids, since partitions may
    differ each time they are made."""
    last = ledger.agg(F.coalesce(F.max("row_id"), F.lit(0)).alias("last"))
    cuts = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(16 * RANGES).distinct().orderBy("doc_id").collect()
    kind = docs.schema["doc_id"].dataType
    at = _place(F.col("doc_id"), [F.lit(r["doc_id"]).cast(kind) for r in cuts[8::16]], 0)
    size = docs.groupBy(at.alias("part")).agg(F.count("*").alias("n"))
    start = size.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("doc_id")))
    numbered = docs.withColumn("part", at).withColumn("place", place).join(F.broadcast(start), "part").crossJoin(F.broadcast(last))  # a row a range; one row
    return numbered.withColumn("row_id", F.col("last") + F.col("before") + F.col("place")).drop("part", "place", "before", "last")


def _place(c: Column, cuts: list[Column], first: int) -> Column:
    """first plus the number of cuts (ascending) that c isn't below, by bisection."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(c < cuts[mid], _place(c, cuts[:mid], first)).otherwise(_place(c, cuts[mid + 1 :], first + mid + 1))


def by_identity(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Tier 1: the same supplier and number."""
    a = docs.where("supplier <> '' and number_key <> ''")
    return _match(a, ledger, ["supplier", "number_key"], F.lit(True), 1)


def by_number_core(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Tier 2: the same supplier and amount, one number's digits end in the other's. The amount is
    part of the key, so that a supplier's documents don't all meet."""
    some = F.length("number_core") >= SHORTEST_CORE
    ends = F.col("d.number_core").endswith(F.col("l.number_core")) | F.col("l.number_core").endswith(F.col("d.number_core"))
    return _match(docs.where(some & (F.col("supplier") != "")), ledger.where(some), ["supplier", "amount_key"], ends, 2)


def by_amount_near_date(docs: DataFrame, ledger: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Tier 3: the same supplier and amount within `days`; no window for a document without date."""
    near = F.col("d.issue_date").isNull() | F.col("l.issue_date").between(F.date_sub("d.issue_date", days), F.date_add("d.issue_date", days))
    return _match(docs.where("supplier <> ''"), ledger, ["supplier", "amount_key"], near, 3)


def _match(docs: DataFrame, ledger: DataFrame, keys: list[str], rest: Column, tier: int) -> DataFrame:
    d, m = docs.alias("d"), ledger.alias("l")
    on = rest
    for k in keys:
        on = on & (F.col(f"d.{k}") == F.col(f"l.{k}"))
    return d.join(m, on).select(F.col("d.doc_id"), F.col("l.row_id"), F.lit(tier).alias("tier"), days_between(F.col("d.issue_date"), F.col("l.issue_date")).alias("days_apart"), (F.col("d.channel") == F.col("l.channel")).alias("same_channel"), F.col("d.supplier"), F.col("d.amount_key"), F.col("d.doc_number").alias("actual"), F.col("l.doc_number").alias("expected"), F.col("l.issue_date").alias("earlier"), F.col("l.channel").alias("earlier_channel"))


def strongest(*tiers: DataFrame) -> DataFrame:
    """Each ledger row once per document, by its strongest tier, with its risk."""
    every = tiers[0]
    for t in tiers[1:]:
        every = every.unionByName(t)
    best = every.groupBy("doc_id", "row_id").agg(F.min_by(F.struct(*[c for c in every.columns if c not in ("doc_id", "row_id")]), "tier").alias("m"))
    return best.select("doc_id", "row_id", "m.*", F.when(F.col("m.tier") == 3, "MEDIUM").otherwise("HIGH").alias("risk"))


def matches(docs: DataFrame, ledger: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    d, m = with_keys(docs), with_keys(ledger)
    return strongest(by_identity(d, m), by_number_core(d, m), by_amount_near_date(d, m, days))


def supplier_history(docs: DataFrame, ledger: DataFrame, limit: int = HISTORY) -> DataFrame:
    """supplier's newest rows (null dates last, ties by row_id), for the suppliers in docs."""
    newest = Window.partitionBy("supplier").orderBy(F.desc_nulls_last("issue_date"), F.desc("row_id"))
    wanted = docs.where("supplier <> ''").select("supplier").distinct()
    return ledger.join(wanted, "supplier", "left_semi").withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)


def recurring(history: DataFrame) -> DataFrame:
    """supplier, amount_key of amounts that come at a monthly rhythm, three times or more."""
    along = Window.partitionBy("supplier", "amount_key").orderBy("issue_date")
    gap = F.datediff("issue_date", F.lag("issue_date").over(along))
    dated = history.where("issue_date is not null and amount_key is not null").withColumn("gap", gap)
    return dated.groupBy("supplier", "amount_key").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("gap").between(*RHYTHM), F.lit(True))).alias("steady")).where((F.col("n") >= PRIOR) & F.col("steady")).select("supplier", "amount_key")


def damped(found: DataFrame, docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """found with MEDIUM risks lowered where the amount recurs. Only suppliers with such a match
    have their history read."""
    medium = found.where("risk = 'MEDIUM'").select("supplier").distinct()
    steady = recurring(supplier_history(medium, ledger)).withColumn("steady", F.lit(True))
    out = found.join(steady, ["supplier", "amount_key"], "left")
    return out.withColumn("risk", F.when((F.col("risk") == "MEDIUM") & F.col("steady"), "LOW").otherwise(F.col("risk"))).withColumn("recurring", F.coalesce("steady", F.lit(False))).drop("steady")


def document_risk(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, risk: the highest of its matches, LOW without any."""
    rank = F.when(F.col("risk") == "HIGH", 0).when(F.col("risk") == "MEDIUM", 1).otherwise(2)
    worst = found.groupBy("doc_id").agg(F.min(rank).alias("r"))
    out = docs.select("doc_id").join(worst, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("r") == 0, "HIGH").when(F.col("r") == 1, "MEDIUM").otherwise("LOW").alias("risk"))


def ordered(found: DataFrame) -> DataFrame:
    """found with place: high risks first, then by days apart (0 and unknown last), tier, row."""
    order = Window.partitionBy("doc_id").orderBy(F.col("risk") != "HIGH", F.coalesce(F.nullif("days_apart", F.lit(0)), F.lit(9999)), "tier", "row_id")
    return found.withColumn("place", F.row_number().over(order))


def to_findings(found: DataFrame) -> DataFrame:
    """Findings of the matches: high risks block payment, none is priced."""
    severity = F.when(F.col("risk") == "HIGH", "critical").when(F.col("risk") == "MEDIUM", "warning").otherwise("info")
    reason = F.when(F.col("tier") == 1, "same supplier, same number").when(F.col("tier") == 2, "same supplier and amount, numbers share digits").otherwise("same supplier and amount, close in time")
    when = F.when(F.col("earlier").isNull(), "").otherwise(F.concat(F.lit(" ("), F.col("earlier").cast("string"), F.lit(")")))
    channel = F.when(~F.col("same_channel"), "; also received by another channel").otherwise("")
    return found.select("doc_id", F.lit("POSSIBLE_DUPLICATE").alias("kind"), severity.alias("severity"), F.lit("_document").alias("field"), F.lit("ledger").alias("source"), F.concat(reason, F.lit("; earlier document: "), F.coalesce("expected", F.lit("?")), when, channel).alias("message"), F.lit("cross_source").alias("basis"), "expected", "actual", F.lit(None).cast("long").alias("amount_k"), F.lit(None).cast("long").alias("line"), (F.col("risk") == "HIGH").alias("blocks_payment"))
