"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raggedlake.plans.session import drop_materialized, materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every node in edges (a, b): label is the smallest id of its component.

    Rounds grow with the logarithm of the longest path; each is written, and the one before deleted. Each step joins edges to a node's smallest neighbour by equality; hubs are split by adaptive execution.
    Self-loops and repeated edges do no harm; null ends are dropped; no edges give an empty result.
    """
    now = edges.select("a", "b").where("a <> b").distinct()
    now = materialize(now, "edges")
    before = None
    while True:  # until a round changes nothing
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        nxt = materialize(small, "edges")
        drop_materialized(now)
        state = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = nxt
        if tuple(state) == before:
            break
        before = tuple(state)
    return now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("id"), "label").unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
