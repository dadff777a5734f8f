"""Connected components by alternating large-star and small-star contraction.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).  Long
chains, which density clusters produce, shrink in a logarithmic number of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.plans.lineage import RollingCut
from tripweave.plans.skew import HOT_ROWS, hot_keys, spread_join


def connected_components(
    nodes: DataFrame, edges: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Label every ``nodes.node`` with ``component``, the smallest node it reaches.

    ``edges`` has columns ``a`` and ``b``; direction, repeats and loops do not matter.
    """
    cut = RollingCut()
    links = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )
    while True:
        unsettled, widest = _star_check(links)
        if not unsettled:
            break
        # A large star makes at most one link of each link of a node, so the width found
        # here bounds both joins; within the bound a plain join is balanced.
        skewed = widest > hot_rows
        links = cut(
            _small_star(_large_star(links, skewed, hot_rows), skewed, hot_rows)
        )
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("_root"))
    return nodes.join(roots, "node", "left").select(
        "node", F.coalesce("_root", "node").alias("component")
    )


def _large_star(links: DataFrame, skewed: bool, hot_rows: int) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        _with_lowest(both, skewed, hot_rows)
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
        .distinct()
    )


def _small_star(links: DataFrame, skewed: bool, hot_rows: int) -> DataFrame:
    """Hang a node and all its smaller neighbours on the smallest of them."""
    # The lowest neighbour's own row turns into the node's row: both hang on it.
    return (
        _with_lowest(links, skewed, hot_rows)
        .select(
            F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"),
            F.col("low").alias("v"),
        )
        .distinct()
    )


def _with_lowest(links: DataFrame, skewed: bool, hot_rows: int) -> DataFrame:
    low = links.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("_rows"))
    hot = hot_keys(low, ["u"], hot_rows=hot_rows) if skewed else None
    return spread_join(links, low.drop("_rows"), ["u"], ["v"], hot)


def _star_check(links: DataFrame) -> tuple[int, int]:
    """Nodes that break the star shape (0: every node hangs on one root, and roots on
    nothing), and the largest number of links at one node."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    heads = links.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    broken = (F.col("hangs") > 1) | ((F.col("hangs") == 1) & (F.col("holds") > 0))
    row = (
        ends.unionByName(heads)
        .groupBy("node")
        .agg(F.sum("hangs").alias("hangs"), F.sum("holds").alias("holds"))
        .agg(
            F.count_if(broken).alias("broken"),
            F.max(F.col("hangs") + F.col("holds")).alias("widest"),
        )
        .first()
    )
    return row["broken"], row["widest"] or 0
