"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch, join_dealt


def _with_least(pairs: DataFrame) -> DataFrame:
    """Adds m, the least of each u and its partners. The least is aggregated (partially before the shuffle), and a hub's rows are
    dealt over copies of its least, so that no task gets all of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("lv")).select("u", F.least("u", "lv").alias("m"))
    return join_dealt(pairs, least, "u").select("u", "v", "m")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges(u, v); root is the least node it reaches. Nodes without edges don't occur.

    Rounds run until the edge set no longer changes, which is after O(log n) rounds in practice; every round is a
    written table. Empty edges give an empty result; loops and repeated edges are dropped.
    """
    now = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges0")
    mark, k = None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        met = _with_least(low)
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.where("u <> m").select("u", F.col("m").alias("v")))
        k += 1
        now = scratch.keep(small.distinct(), f"edges{k}")
        scratch.drop(f"edges{k - 1}")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
