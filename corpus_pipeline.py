"""The corpus pipeline: language identification, near-duplicate removal, benchmark decontamination,
mixing, sharding. Counted as part of the training-data subpackage.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept and returns
a DataFrame, an empty one of an empty one; extra columns stay. run() writes each stage's rows to the shared folder and gives the reread table to the
next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriledger.llm import decontam, golay, langid, mixing, sharding
from veriledger.llm.common import discard, store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is determined (operator 10): null and empty texts and texts
    without a letter go, and every row if no labelled text is there to learn from. Repeated rows stay."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group (operator 5), that of the smallest doc_id. Rows
    without an id come last and are compared like others; repeated rows are one; null and empty
    texts are one group."""
    return golay.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages (operator 8). Null and empty texts stay, repeated
    rows go or stay alike, an empty benchmark drops nothing."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or thin documents to their source's target (operator 2). Null sources are a source of
    their own, texts without words stay as their source's rate has it, repeated rows draw alike."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the mix as compacted shards; each row's placement (operator 7): doc_id, text_bytes,
    shard, tier, shard_rows, shard_bytes. Nulls, repeated rows and extra columns are kept."""
    return sharding.placements(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

#: Language identification and the fingerprints can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            discard(last)
        last = docs
    return docs
