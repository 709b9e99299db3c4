"""Reading manifests, documents and model responses; writing results, splits and checkpoints."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriledger.functions.jsontext import parse_json_response, strip_stray_escapes
from veriledger.functions.numbers import cents, is_numeric, to_number
from veriledger.operators.rules import AMOUNTS, TAX, TAX_FIELDS

ITEM = "struct<sku:string,description:string,quantity:string,unit_price:string,discount:string,total:string>"
#: Numbers are read as text, so that what isn't a number stays visible.
DOCUMENT = f"doc_id string, doc_type string, language string, invoice_number string, po_number string, receipt_number string, date string, due_date string, delivery_date string, vendor_name string, supplier_name string, store_name string, vendor_tax_id string, supplier_tax_id string, store_tax_id string, tax_id string, buyer_name string, buyer_tax_id string, items array<{ITEM}>, subtotal string, tax_rate string, tax_amount string, total_amount string, change_amount string, amount_payable string, currency string, notes string"
MANIFEST = "doc_id string, doc_type string, language string, pdf string, json string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {doc_id, doc_type, language?, pdf, json}."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one a file, with `stem`, their file's name without ending."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("stem", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))


def paired_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(paired, alone): stems of .json files that have a .pdf beside them, and those that don't.
    Only names are read, no content."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"([^/]+)\.(json|pdf)$", 1).alias("stem"), F.regexp_extract("path", r"\.(json|pdf)$", 1).alias("kind"))
    docs, pdfs = names.where("kind = 'json'").select("stem"), names.where("kind = 'pdf'").select("stem")
    return docs.join(pdfs, "stem", "left_semi"), docs.join(pdfs, "stem", "left_anti")


def ground_truth(manifest: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored, missing): manifest rows with and without a ground truth."""
    return manifest.join(truth, "doc_id"), manifest.join(truth.select("doc_id"), "doc_id", "left_anti")


def typed(documents: DataFrame) -> DataFrame:
    """Documents as read, with the columns the rules work on: money in kuruş, quantities to a
    millionth, lines with pos. What stands for an amount and isn't a number is kept beside it."""
    k = lambda c: cents(to_number(c))
    number, party = (F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs]) for cs in (("invoice_number", "receipt_number", "po_number"), ("vendor_name", "supplier_name", "store_name")))
    seller = F.when(F.col("doc_type") == "po", F.lit(TAX["po"])).when(F.col("doc_type") == "receipt", F.lit(TAX["receipt"])).otherwise(F.lit(TAX["invoice"]))
    ids = F.map_from_arrays(F.array(*map(F.lit, TAX_FIELDS)), F.array(*map(F.col, TAX_FIELDS)))
    qty = lambda c: F.regexp_replace(c, "[ ,]", "").try_cast("decimal(18,6)")
    line = lambda x, i: F.struct(i.cast("long").alias("pos"), x["sku"].alias("sku"), qty(x["quantity"]).alias("qty"), k(x["unit_price"]).alias("price_k"), k(x["discount"]).alias("disc_k"), k(x["total"]).alias("total_k"), x["description"].alias("description"))
    lines = F.transform(F.coalesce("items", F.array().cast(f"array<{ITEM}>")), line)
    amounts = [x for f, n in AMOUNTS.items() for x in (k(F.col(f)).alias(f"{n}_k"), F.when(~is_numeric(F.col(f)), F.col(f)).alias(f"{n}_text"))]
    out = documents.withColumn("__ids", ids).withColumn("__seller", seller)
    return out.select("doc_id", "doc_type", "language", number.alias("number"), F.col("date").alias("date_text"), F.col("due_date").alias("due_text"), F.col("delivery_date").alias("delivery_text"), party.alias("party"), F.try_element_at("__ids", F.col("__seller")).alias("tax_id"), F.map_filter("__ids", lambda key, value: key != F.col("__seller")).alias("other_tax_ids"), "currency", *amounts, lines.alias("items"))


def parse_responses(responses: DataFrame) -> DataFrame:
    """doc_id, data (VARIANT, null if nothing parses) of model responses (doc_id, response)."""
    return responses.select("doc_id", parse_json_response(strip_stray_escapes(F.col("response"))).alias("data"))


def _holds_object(answer: str | None) -> bool:
    try:
        return isinstance(json.loads((answer or "")[(answer or "").find("{") : (answer or "").rfind("}") + 1]), dict)
    except ValueError:
        return False


def extract(documents: DataFrame, client: Callable[[], Callable[[str, str], str]], retries: int = 1) -> DataFrame:
    """doc_id, response, error of a model asked about each document (doc_id, doc_type, prompt).
    `client` makes the caller once per task, or a list of callers; a call that fails, or answers with
    what holds no JSON object, is tried again, and from then on by the next caller; the last error
    stays. Rows never drop."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = client()
        callers = list(made) if isinstance(made, list | tuple) else [made]
        for batch in batches:
            rows = []
            for doc_id, kind, prompt in batch[["doc_id", "doc_type", "prompt"]].itertuples(index=False):
                answer = error = None
                for attempt in range(max(retries + 1, len(callers))):
                    try:
                        answer, error = callers[attempt % len(callers)](kind, prompt), None
                        if _holds_object(answer):
                            break
                        error = "no JSON object in the answer"
                    except Exception as e:  # the error is the row's result
                        error = str(e)
                rows.append((doc_id, answer, error))
            yield pd.DataFrame(rows, columns=["doc_id", "response", "error"])

    return documents.select("doc_id", "doc_type", "prompt").mapInPandas(run, f"doc_id {dict(documents.dtypes)['doc_id']}, response string, error string")


#: Names of document types in prompts, and the strategies.
TYPE_NAMES = {"invoice": "Invoice / Fatura", "po": "Purchase Order / Satın Alma Siparişi", "receipt": "Receipt / Fiş-Makbuz"}
STRATEGIES = {
    "direct": "Extract the fields of this {} as JSON.",
    "cot": "Read this {} step by step, then give its fields as JSON.",
    "structured": "Give the fields of this {} as JSON, null where absent.",
    "few_shot": "As in the example, give the fields of this {} as JSON.",
    "cot_enhanced": "Read language, header, parties, lines and totals of this {}, then give its fields as JSON.",
}


def with_prompt(documents: DataFrame, strategy: str = "direct") -> DataFrame:
    """documents with `prompt`, by type; orders also get a hint on the parties' roles."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    text = F.try_element_at(F.create_map(*[F.lit(x) for k, v in TYPE_NAMES.items() for x in (k, STRATEGIES[strategy].format(v))]), F.col("doc_type"))
    hint = F.when(F.col("doc_type") == "po", "Tell supplier and buyer by their labels, never by position. ").otherwise("")
    return documents.withColumn("prompt", F.concat(hint, text))


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def open_work(documents: DataFrame, done: DataFrame, version: int) -> DataFrame:
    """Documents that no checkpoint row of this format version names."""
    return documents.join(done.where(F.col("version") == version).select("doc_id"), "doc_id", "left_anti")


def split(documents: DataFrame, by: list[str], train: int = 60, val: int = 20) -> DataFrame:
    """documents with `split`: in each stratum, in the order of an id's hash, the first per cent
    are train, then val, at least one each, the rest test. Halves round to even."""
    order = Window.partitionBy(*by).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    n, r = F.count("*").over(Window.partitionBy(*by)), F.row_number().over(order)
    part = lambda pct: F.greatest(F.lit(1), F.floor((n * pct + 50) / 100) - F.when((n * pct % 100 == 50) & (F.floor(n * pct / 100) % 2 == 0), 1).otherwise(0))
    return documents.withColumn("split", F.when(r <= part(train), "train").when(r <= part(train) + part(val), "val").otherwise("test"))


def write_splits(documents: DataFrame, path: str, by: str = "doc_type") -> None:
    """Under path: documents (a folder a split), manifests (ids by split) and summary (counts by
    split and type)."""
    documents.write.mode("overwrite").partitionBy("split").json(f"{path}/documents")
    documents.select("doc_id", "split").write.mode("overwrite").partitionBy("split").json(f"{path}/manifests")
    documents.groupBy("split", by).agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def write_dataset(documents: DataFrame, quality: DataFrame, path: str) -> None:
    """Under path: dataset (a folder a type) and quality, the report on it."""
    documents.write.mode("overwrite").partitionBy("doc_type").json(f"{path}/dataset")
    quality.coalesce(1).write.mode("overwrite").json(f"{path}/quality")


def read_images(spark: SparkSession, path: str, render: Callable[[bytes], bytes]) -> DataFrame:
    """path, image: the files under path through a renderer that the caller brings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "image": [render(bytes(x)) for x in b["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, image binary")
