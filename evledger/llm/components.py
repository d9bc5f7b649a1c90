"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evledger.session import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node is tied to the smallest node around it."""
    ways = _both_ways(edges)
    least = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    tied = ways.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its neighbours below are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of one orderable type to ``(node, root)``.

    ``root`` is the smallest node reachable.  Only nodes with a link to another
    node appear.  Null ends and self links are ignored; an empty table gives an
    empty result.  The state between rounds is a written table, so a lost
    executor repeats one round; the rounds grow with the logarithm of the size.
    Hubs are pre-aggregated to their minimum, and the join back to a hub's links
    is one that adaptive execution splits.
    """
    edges = materialize(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    mark = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "stars")
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
