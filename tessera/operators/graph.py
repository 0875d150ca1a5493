"""Connected components by alternating large-star and small-star (Kiveris et al. 2014) as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import skew
from tessera.runtime import discard, materialize


def _star(edges: DataFrame, total: int) -> tuple[DataFrame, list[DataFrame]]:
    """(edges (u, v) with m, the smallest of u's neighbours, tables to discard); a hub's rows are dealt out, which takes a written table of the minima."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if total <= skew.LEAST:  # no hub can be hot
        return edges.join(low.drop("n"), "u"), []
    low, known = skew.weighed(low, "n", "low")
    return skew.hot_join(edges, low, ["u"], "n", known=known), [low]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b); component is the smallest node reachable.

    Large-star links every larger neighbour of a node to the node's smallest
    neighbour, small-star links the smaller ones; both keep connectivity, and the two
    alternate until nothing moves, then every edge points at a minimum.  The number
    of rounds grows with the logarithm of the nodes, so there is no limit on them.
    Each half-round is one partial aggregation and one equi-join on the node.  Null
    ends and self-loops are ignored; an empty input gives an empty result.
    """
    links = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    links = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    stats = links.agg(F.count("*"), F.lit(0)).first()
    if not stats[0]:
        return links.toDF("node", "component")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        starred, one = _star(both, 2 * stats[0])
        large = starred.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        few = 2 * stats[0] <= skew.LEAST
        large = large if few else materialize(large, "large")
        joined, two = _star(large, stats[0])
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        after = materialize(small.distinct(), "links")
        before, stats = stats, after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(links, *one, *two, *([] if few else [large]))
        links = after
        if stats == before:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
