"""Connected components of an edge table, by alternating star contractions.

Every round turns the graph into one with the same components and shorter paths, until each
node hangs on the smallest node of its component.  Each round is a cut table in the shared folder; only three
numbers of each reach the driver.  A node that many edges meet in has its rows spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, drop, spread_join

#: A node of more edges than this and than a hundredth of all has its rows spread.
HUB = 1000


def _state(edges: DataFrame) -> tuple:
    per = edges.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    return tuple(per.agg(F.sum("n"), F.sum("h"), F.max("n")).first())


def _with_lowest(rows: DataFrame, low: DataFrame, hub: bool) -> DataFrame:
    """``rows(u, v)`` with ``m`` of ``low(u, n, m)``."""
    return spread_join(rows, cut(low, "lowest"), "u") if hub else rows.join(low.drop("n"), "u")


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of long nodes, u <> v -> ``(node, root)`` for every node that is not its own root.

    An empty edge table gives an empty result; repeated edges and either direction are fine.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = _state(now)
    while True:
        hub = (state[2] or 0) > max(HUB, (state[0] or 0) / 100)
        # large star: larger neighbours move to the smallest neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.least(F.min("v"), F.col("u")).alias("m"))
        large = _with_lowest(both, low, hub).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours, and the node itself, move to the smallest of them
        low = large.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m"))
        small = _with_lowest(large, low, hub).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(old)
        if (then := _state(now)) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = then
