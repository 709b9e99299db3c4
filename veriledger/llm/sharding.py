"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards, one file each. Compaction takes the live shards by
size tier, packs shards of one tier in order into runs of about the target size and rewrites each
run as one file: a run is one task that reads its files in turn, so merging shuffles nothing. Every
change is a new manifest version, a table of the live shards, put in place by one rename; readers
see the version before or after and never a part. All of it is DataFrame functions; the rename is
one call to the file system, and needs a store on which renaming a folder is atomic.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veriledger.llm.common import bounded_broadcast, hadoop, new_path, quoted, store, unit_hash

#: Bytes of text: of an arrival, of a finished shard, of the lowest tier, and the tiers' factor.
ARRIVAL, TARGET, LOWEST, FACTOR, TIERS = 4 << 20, 64 << 20, 64 << 10, 4, 8
#: Age from which a file that no manifest names can't be one of a running writer: a day.
SPARE_MS = 24 * 3600 * 1000
#: Runs that one job rewrites.
RUNS_A_JOB = 128
UNION = "spark.sql.unionOutputPartitioning"
MANIFEST = "file string, shard string, tier int, rows long, bytes long"


class CommitConflict(RuntimeError):
    """Another writer has committed the same version."""


class ShardTable:
    """A folder with data files and versions of a manifest."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        fs, p = hadoop(self.spark, f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max([int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()], default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v{v}") if v else self.spark.createDataFrame([], MANIFEST)

    def commit(self, rows: DataFrame, base: int) -> int:
        """Write rows as version base + 1: first beside the manifest, then one rename."""
        fs, part = hadoop(self.spark, f"{self.path}/manifest/.new-{uuid.uuid4().hex}")
        rows.select("file", "shard", "tier", "rows", "bytes").coalesce(1).write.parquet(part.toString())
        _, final = hadoop(self.spark, f"{self.path}/manifest/v{base + 1}")
        if fs.exists(final) or not fs.rename(part, final) or fs.exists(hadoop(self.spark, f"{final.toString()}/{part.getName()}")[1]):
            raise CommitConflict(f"version {base + 1} of {self.path} exists")
        return base + 1

    def _files(self, folder: str) -> DataFrame:
        """place, file of the files that a write left in folder: a file's place is its task's."""
        fs, p = hadoop(self.spark, folder)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        rows = [(int(n.split("-")[1]), f"{folder[len(self.path) + 1:]}/{n}") for n in names if n.startswith("part-")]
        return self.spark.createDataFrame(rows, "place int, file string")

    def append(self, rows: DataFrame, place: str, n: int) -> int:
        """Add rows as n shards; column `place` (0 to n - 1, an int) says which and is not kept.
        rows are placed by that number itself, so shards don't meet in a task."""
        base, folder = self.version(), f"{self.path}/data/a{uuid.uuid4().hex}"
        sizes = store(rows.groupBy(F.col(place).alias("place")).agg(F.count("*").alias("rows"), F.sum(text_bytes()).alias("bytes")), "shard-sizes")
        rows.repartitionById(max(n, 1), F.col(place)).select(*quoted(self.schema.names)).write.option("compression", "zstd").parquet(folder)
        fresh = self._files(folder).join(sizes, "place").select("file", F.format_string("arrival-%d-%05d", F.lit(base), "place").alias("shard"), tier(F.col("bytes")).alias("tier"), "rows", "bytes")
        return self.commit(self.manifest(base).unionByName(fresh), base)

    def compact(self, target: int = TARGET) -> int:
        """Merge one round of runs; the version does not change if there is nothing to merge."""
        base = self.version()
        plan = store(compaction_plan(self.manifest(base), target), "shard-plan")
        runs = plan.where("merged").groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("member", "file"))).alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).orderBy("shard")
        live, done = plan.where("not merged").select("file", "shard", "tier", "rows", "bytes"), []
        batch = []

        def rewrite() -> None:
            folder = f"{self.path}/data/c{uuid.uuid4().hex}"
            # one task a run, in this order; its number is in the name of its file
            parts = [self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f['file']}" for f in r["files"]]).coalesce(1) for r in batch]
            # a union of single partitions would else be one partition
            kept = self.spark.conf.get(UNION, None)
            self.spark.conf.set(UNION, "false")
            try:
                reduce(DataFrame.union, parts).write.option("compression", "zstd").parquet(folder)
            finally:
                self.spark.conf.set(UNION, kept) if kept else self.spark.conf.unset(UNION)
            rows = [(i, r["shard"], r["rows"], r["bytes"]) for i, r in enumerate(batch)]
            if self._files(folder).count() != len(batch):
                raise RuntimeError(f"{folder} should have {len(batch)} files, one a run")
            sizes = self.spark.createDataFrame(rows, "place int, shard string, rows long, bytes long")
            done.append(self._files(folder).join(sizes, "place").select("file", "shard", tier(F.col("bytes")).alias("tier"), "rows", "bytes"))
            batch.clear()

        for r in runs.toLocalIterator():  # rows of the manifest, a run at a time
            batch.append(r)
            if len(batch) == RUNS_A_JOB:
                rewrite()
        if batch:
            rewrite()
        return self.commit(reduce(DataFrame.unionByName, done, live), base) if done else base

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with shard, tier, shard_rows and shard_bytes."""
        live = store(self.manifest(version), "shard-live")
        paths = [f"{self.path}/{r['file']}" for r in live.select("file").toLocalIterator()]
        if not paths:
            return self.spark.createDataFrame([], self.schema).select("*", F.lit("").alias("__shard"), F.lit(0).alias("__tier"), F.lit(0).cast("long").alias("__rows"), F.lit(0).cast("long").alias("__bytes"))
        rows = self.spark.read.schema(self.schema).parquet(*paths).select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("__name"))
        names = live.select(F.element_at(F.split("file", "/"), -1).alias("__name"), F.col("shard").alias("__shard"), F.col("tier").alias("__tier"), F.col("rows").alias("__rows"), F.col("bytes").alias("__bytes"))
        return rows.join(bounded_broadcast(names), "__name").drop("__name")

    def vacuum(self, keep: int = 1, spare_ms: int = SPARE_MS) -> None:
        """Delete manifests before the last `keep` versions and the files that only they name. Files
        that no manifest names may be another writer's that has not committed yet: they go only when
        they are older than spare_ms."""
        last = self.version()
        fs, data = hadoop(self.spark, f"{self.path}/data")
        named = lambda vs: {r["file"] for v in vs if fs.exists(hadoop(self.spark, f"{self.path}/manifest/v{v}")[1]) for r in self.manifest(v).select("file").toLocalIterator()}
        live, replaced = named(range(max(1, last - keep + 1), last + 1)), named(range(1, max(1, last - keep + 1)))
        now = time.time() * 1000
        for folder in fs.listStatus(data):
            for f in fs.listStatus(folder.getPath()):
                name = f"data/{folder.getPath().getName()}/{f.getPath().getName()}"
                if name not in live and (name in replaced or now - f.getModificationTime() > spare_ms):
                    fs.delete(f.getPath(), True)
        for v in range(1, last - keep + 1):
            fs.delete(hadoop(self.spark, f"{self.path}/manifest/v{v}")[1], True)


def text_bytes() -> F.Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")


def tier(size: F.Column) -> F.Column:
    """0 under LOWEST * FACTOR bytes, then one more for each further factor, TIERS at most."""
    return reduce(lambda a, b: a + b, [(size >= LOWEST * FACTOR**k).cast("int") for k in range(1, TIERS + 1)])


def compaction_plan(manifest: DataFrame, target: int = TARGET) -> DataFrame:
    """manifest with shard, tier and merged as they should become; member is the shard so far.

    Shards of a tier, by name, fill runs by the bytes before them; a shard of the target size or a
    run of one shard stays as it is. The windows see one row per shard."""
    order = Window.partitionBy("tier").orderBy("shard")
    small = F.col("bytes") < target
    before = F.sum(F.when(small, F.col("bytes")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = manifest.withColumn("run", F.floor(F.coalesce(before, F.lit(0)) / target).cast("long"))
    peers = F.sum(small.cast("int")).over(Window.partitionBy("tier", "run"))
    out = run.withColumn("merged", small & (peers > 1))
    return out.select("file", F.col("shard").alias("member"), F.when(F.col("merged"), F.format_string("run-%d-%05d", "tier", "run")).otherwise(F.col("shard")).alias("shard"), "tier", "rows", "bytes", "merged")


def arrivals(docs: DataFrame, arrival: int = ARRIVAL) -> tuple[DataFrame, int]:
    """docs with __place, the delivery that brings a row, and the number of deliveries: each source
    delivers its bytes in slices of about `arrival`, rows dealt by a hash of doc_id."""
    size = docs.groupBy("source").agg(F.sum(text_bytes()).alias("bytes"))
    size = size.withColumn("slices", F.greatest(F.ceil(F.col("bytes") / arrival), F.lit(1)).cast("long"))
    first = F.sum("slices").over(Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    plan = store(size.select(F.col("source").alias("__source"), F.col("slices").alias("__slices"), F.coalesce(first, F.lit(0)).alias("__first")), "arrivals")
    n = plan.agg(F.sum("__slices")).first()[0] or 0
    rows = docs.join(bounded_broadcast(plan), docs["source"].eqNullSafe(plan["__source"]))
    place = F.col("__first") + F.floor(unit_hash(F.col("doc_id"), "arrival") * F.col("__slices"))
    return rows.withColumn("__place", place.cast("int")).drop("__source", "__slices", "__first"), int(n)


def shard(docs: DataFrame, path: str | None = None, arrival: int = ARRIVAL, target: int = TARGET) -> ShardTable:
    """Append docs as arrivals, compact once, drop what the new version replaces.

    Null texts have no bytes, null sources deliver together, repeated rows and extra columns are
    kept as they are, an empty table commits a version without shards.
    """
    table = ShardTable(docs.sparkSession, path or new_path(docs.sparkSession, "shards"), docs.schema)
    rows, n = arrivals(docs, arrival)
    table.append(rows, "__place", n)
    table.compact(target)
    table.vacuum()
    return table


def placements(docs: DataFrame, arrival: int = ARRIVAL, target: int = TARGET) -> DataFrame:
    """doc_id, text_bytes, shard, tier, shard_rows, shard_bytes of every row, read from the shards."""
    rows = shard(docs, None, arrival, target).read()
    return rows.select("doc_id", text_bytes().alias("text_bytes"), F.col("__shard").alias("shard"), F.col("__tier").alias("tier"), F.col("__rows").alias("shard_rows"), F.col("__bytes").alias("shard_bytes"))
