"""Connected components of a link table by alternating large-star and small-star steps.

Follows Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each step is
a grouped minimum and a join, so no node's neighbours are ever gathered in one place, and
links never leave the executors. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import materialise

MAX_ROUNDS = 60


def _star(arcs: DataFrame, small: bool) -> DataFrame:
    """Arcs (u, v): link u's larger (or, with ``small``, smaller) neighbours and u to u's minimum."""
    low = arcs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    joined = arcs.join(low, arcs.u == low.c)
    if small:
        # arcs run from the larger node to smaller ones: all of them, and u itself, go to m
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
        own = low.select(F.col("c").alias("a"), F.col("m").alias("b"))
        out = moved.unionByName(own)
    else:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where(F.col("a") != F.col("b")).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """Links (a, b) -> (node, root): root is the least node reachable; only linked nodes appear.

    Nodes are any one orderable type without nulls. Self-links and repeated links are ignored;
    no links gives an empty table.
    """
    links = materialise(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a") != F.col("b")).distinct(), "links")
    mark = _mark(links)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = materialise(_star(both, small=False), "large-star")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        links = materialise(_star(down, small=True), "small-star")
        now = _mark(links)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
