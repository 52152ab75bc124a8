"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.storage import stored


def _star(arcs: DataFrame, large: bool) -> DataFrame:
    """One star step over arcs (u, v), every one of which points to a neighbour."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = arcs.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.where("u > m").select("u", F.col("m").alias("v"))
    return joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node each linked node can reach.

    Nodes without a link to another node are left out.  Every step is an aggregate
    and a join over the links, so a node with many links is combined map-side and
    its join can be split; each round is a written table, and the number of rounds
    grows with the logarithm of the longest path.
    """
    one_way = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    links = stored(one_way.distinct(), "links")
    before = None
    while True:
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stars = _star(both, large=True).distinct()
        links = stored(_star(stars, large=False).distinct(), "links")
