"""Continuous checking: each batch of new documents against the ledger, then into it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veriledger.operators.ledger import damped, document_risk, matches, record


def check_stream(stream: DataFrame, ledger_path: str, risks_path: str, checkpoint: str, keep: bool = True) -> StreamingQuery:
    """Writes doc_id, risk of every document to risks_path and, unless told not to, the documents to
    the ledger. A batch that is retried replaces its own files, named by the batch, and doesn't see
    rows it may have added itself."""

    def batch(docs: DataFrame, number: int) -> None:
        spark = docs.sparkSession
        before = spark.read.parquet(f"{ledger_path}/*").where(f"batch <> {number}").drop("batch")
        found = damped(matches(docs, before), docs, before)
        document_risk(docs, found).write.mode("overwrite").parquet(f"{risks_path}/batch={number}")
        if keep:
            from pyspark.sql import functions as F

            new = record(docs, before).select(*before.columns).withColumn("batch", F.lit(number))
            new.write.mode("overwrite").parquet(f"{ledger_path}/b{number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
