"""Predicted fields against the truth, documents and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriledger.functions.similarity import similar_pairs
from veriledger.functions.text import normalise_text, token_scores

#: How fields are compared.
MONEY = ("unit_price", "total", "discount", "subtotal", "tax_amount", "total_amount", "amount_payable", "change_amount", "amount")
RATES, NUMERIC = ("tax_rate",), (*MONEY, "tax_rate", "quantity")
ADDRESSES = ("vendor_address", "buyer_address", "supplier_address", "store_address")
SKIPPED = ("doc_type", "language", "confidence_scores", "confidence", "source", "receipt_number", "available_fields", "scenario")
NOISE, RATE, RELATIVE, ITEM, ADDRESS = 1e-9, 0.001, 0.01, 0.02, 0.80


def number(c: Column) -> Column:
    text = F.trim(F.regexp_replace(c.cast("string"), ",", ""))
    return F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def exact_match(p: Column, g: Column) -> Column:
    return F.when(normalise_text(p) == normalise_text(g), 1.0).otherwise(0.0)


def relative_accuracy(p: Column, g: Column, tolerance: float = RELATIVE) -> Column:
    a, b = number(p), number(g)
    ok = F.when(b == 0, a == 0).otherwise(F.abs(a - b) / F.abs(b) <= tolerance)
    return F.when(F.coalesce(ok, F.lit(False)), 1.0).otherwise(0.0)


def absolute_accuracy(p: Column, g: Column, tolerance: float = 0.0) -> Column:
    return F.when(F.coalesce(F.abs(number(p) - number(g)) <= tolerance + NOISE, F.lit(False)), 1.0).otherwise(0.0)


def base_field(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def numeric_score(path: Column, p: Column, g: Column) -> Column:
    """Money to the kuruş, rates to a thousandth, other numbers to 1 %."""
    f = base_field(path)
    return F.when(f.isin(*MONEY), absolute_accuracy(p, g)).when(f.isin(*RATES), absolute_accuracy(p, g, RATE)).otherwise(relative_accuracy(p, g))


def joined_fields(truth: DataFrame, predicted: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """doc_id, path, truth, predicted: all fields of the truth that are scored; a field the
    prediction lacks is empty, extra ones are ignored. `available` (doc_id, path) restricts."""
    t = truth.where(~F.col("path").isin(*SKIPPED))
    t = t if available is None else t.join(available, ["doc_id", "path"], "left_semi")
    return t.join(predicted, ["doc_id", "path"], "left").select("doc_id", "path", F.coalesce("truth", F.lit("")).alias("truth"), F.coalesce("predicted", F.lit("")).alias("predicted"))


def field_scores(fields: DataFrame, similarity: bool = True) -> DataFrame:
    """fields with em, f1, num and, unless told not to, sim. A number that is close counts as a match; an
    address that is 80 % alike too."""
    f = base_field(F.col("path"))
    num = F.when(f.isin(*NUMERIC), numeric_score(F.col("path"), F.col("predicted"), F.col("truth")))
    em = exact_match(F.col("predicted"), F.col("truth"))
    out = fields.withColumns({"num": num, "f1": token_scores(F.col("predicted"), F.col("truth"))[2]})
    if similarity:
        normal = out.withColumns({"np": normalise_text(F.col("predicted")), "ng": normalise_text(F.col("truth"))})
        out = similar_pairs(normal, "np", "ng", "ratio").withColumn("sim", F.when(F.col("ng") == "", F.when(F.col("np") == "", 1.0).otherwise(0.0)).otherwise(F.col("ratio"))).drop("np", "ng", "ratio")
        em = F.when((em == 0) & f.isin(*ADDRESSES) & (F.col("sim") >= ADDRESS), 1.0).otherwise(em)
    return out.withColumn("em", F.when((em == 0) & F.col("num").isNotNull(), F.col("num")).otherwise(em))


def document_scores(fields: DataFrame) -> DataFrame:
    """doc_id, n_fields, em, f1 (4 places) and sim where there is one."""
    more = [F.round(F.avg("sim"), 4).alias("sim")] if "sim" in fields.columns else []
    return fields.groupBy("doc_id").agg(F.count("*").alias("n_fields"), F.round(F.avg("em"), 4).alias("em"), F.round(F.avg("f1"), 4).alias("f1"), *more)


def batch_scores(documents: DataFrame) -> DataFrame:
    more = [F.round(F.avg("sim"), 4).alias("sim")] if "sim" in documents.columns else []
    return documents.agg(F.count("*").alias("total_documents"), F.round(F.avg("em"), 4).alias("em"), F.round(F.avg("f1"), 4).alias("f1"), *more)


def aggregate_run(rows: DataFrame) -> DataFrame:
    """block, documents, em, f1 and, where there is one, sim of the whole run, its OK documents and each type, in one pass. A
    document without a score counts as 0 and stays in the denominator."""
    blocks = F.array(F.lit("overall"), F.when(F.col("verdict") == "OK", "ok_only"), F.concat(F.lit("type:"), F.col("doc_type")))
    spread = rows.withColumn("block", F.explode(F.filter(blocks, lambda x: x.isNotNull())))
    scores = [c for c in ("em", "f1", "sim") if c in rows.columns]
    return spread.groupBy("block").agg(F.count("*").alias("documents"), *[F.round(F.avg(F.coalesce(c, F.lit(0.0))), 4).alias(c) for c in scores])


def item_similarity(pairs: DataFrame) -> DataFrame:
    """pairs of lines (doc_id, i, j, a_ and b_ of sku, qty, price_k, total_k, description) with sim:
    the mean over fields, numbers within 2 %, texts by ratio; a field one side lacks scores 0."""
    text = lambda c: F.coalesce(normalise_text(F.col(c)), F.lit(""))
    scored = similar_pairs(pairs.withColumns({"x": text("a_description"), "y": text("b_description")}), "x", "y", "ratio")
    part = lambda c, s: F.when(F.col(f"a_{c}").isNull() & F.col(f"b_{c}").isNull(), 1.0).when(F.col(f"a_{c}").isNull() | F.col(f"b_{c}").isNull(), 0.0).otherwise(s)
    words = F.when(F.col("y") == "", F.when(F.col("x") == "", 1.0).otherwise(0.0)).otherwise(F.col("ratio"))
    cols = [part("description", words)] + [part(c, relative_accuracy(F.col(f"a_{c}"), F.col(f"b_{c}"), ITEM)) for c in ("qty", "price_k", "total_k")]
    return scored.select("doc_id", "i", "j", (sum(cols[1:], cols[0]) / len(cols)).alias("sim"))


def align_items(scores: DataFrame) -> DataFrame:
    """doc_id, i, j, ord: pairs taken from the most similar down (ties by i, then j), each line once,
    until a side is used up; a fold over the pairs of one document."""
    c = F.struct((-F.col("sim")).alias("s"), "i", "j")
    docs = scores.groupBy("doc_id").agg(F.array_sort(F.collect_list(c)).alias("c"))

    def step(done: Column, x: Column) -> Column:
        used = F.exists(done, lambda d: (d["i"] == x["i"]) | (d["j"] == x["j"]))
        return F.when(used, done).otherwise(F.concat(done, F.array(F.struct(x["i"].alias("i"), x["j"].alias("j")))))

    none = F.array().cast("array<struct<i:bigint,j:bigint>>")
    return docs.select("doc_id", F.posexplode(F.aggregate("c", none, step)).alias("ord", "m")).select("doc_id", "m.*", F.col("ord").cast("long").alias("ord"))


def reindex(aligned: DataFrame, truth_lines: DataFrame) -> DataFrame:
    """doc_id, j, new_pos: truth lines by their pair's place, those without a pair after them."""
    out = truth_lines.join(aligned.select("doc_id", "j", "ord"), ["doc_id", "j"], "left")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("ord").asc_nulls_last(), "j")) - 1
    return out.select("doc_id", "j", place.cast("long").alias("new_pos"))


def misses(fields: DataFrame) -> DataFrame:
    """doc_id, n_misses, paths of the fields scored 0, joined in order."""
    return fields.where("em = 0").groupBy("doc_id").agg(F.count("*").alias("n_misses"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, old, new of documents whose score changed between two runs."""
    a, b = before.select("doc_id", F.col("em").alias("old")), after.select("doc_id", F.col("em").alias("new"))
    return a.join(b, "doc_id").where("old <> new")
