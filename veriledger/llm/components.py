"""Connected components as DataFrames: large star and small star, in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriledger.llm.common import discard, store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. edges: src > dst, distinct. Hot nodes only take part in partial minima and a
    join that Spark may split, never in a list of neighbours."""
    if large:  # each node's larger neighbours get its least neighbour
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        out = edges.select(F.col("dst").alias("src"), F.col("src").alias("far")).join(least, "src").select(F.col("far").alias("src"), F.col("m").alias("dst"))
    else:  # each node's smaller neighbours and the node itself get its least neighbour
        least = edges.groupBy("src").agg(F.min("dst").alias("m"))
        out = edges.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(least.select("src", F.col("m").alias("dst")))
    return out.where("src <> dst").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of edges (src, dst): root is the least node reachable.

    Self links and repeats are allowed; nulls are not links. Rounds end when every edge is a star's,
    after a number that grows with the logarithm of the longest chain; each round is written to the
    shared folder.
    """
    e = edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    e, last = store(e, "cc"), None
    for _ in range(most_rounds):
        # unchanged by a round: a forest of stars
        now = e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            return e.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(e.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())
        after, last = store(_star(_star(e, True), False), "cc"), now
        discard(e)
        e = after
    raise RuntimeError(f"components still change after {most_rounds} rounds")
