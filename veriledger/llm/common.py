"""Helpers that the training-data operators share: shared storage, checked broadcasts, names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes between words, as the contracts give them: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rows that a frame may have to be broadcast, unless the caller states another bound.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder every node can read. A cluster names it in spark.checkpoint.dir; only a local
    session that names none gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/veriledger-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/") + "/veriledger"


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's API, for whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def store(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = path or new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._veriledger_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by store() that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_veriledger_path", None):
            fs, p = hadoop(df.sparkSession, path)
            fs.delete(p, True)


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have max_rows rows at most; else df, to be
    joined by a shuffle. df should be stored or cheap, since it is counted first."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def as_text(c: Column) -> Column:
    """A key as text; null has a text of its own."""
    return F.coalesce(c.cast("string"), F.lit("\x00null"))


def quoted(names: list[str]) -> list[Column]:
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def unit_hash(c: Column, seed: str) -> Column:
    """A number in [0, 1) from the MD5 of seed and key: 52 bits, the same in any engine."""
    head = F.substring(F.md5(F.concat(F.lit(seed + ":"), as_text(c))), 1, 13)
    return F.conv(head, 16, 10).cast("long") / F.lit(4503599627370496.0)
