"""Connected components of a link table by alternating large-star and small-star joins (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node long, component long): for each linked node the smallest node reachable.

    Nodes without links to others don't appear. Repeated links, links in both directions and links of a node
    to itself are allowed; rows with a null end are left out. Adjacency lists are never gathered: each round
    takes the smallest neighbour by a pre-aggregated group and joins it back, and adaptive execution splits the
    join of a hub. Each round ends in a table in the shared folder."""
    a, b = F.col("a"), F.col("b")
    edges = materialise(
        links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links"
    )
    before = _digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.join(low, "a").where(b > a).select(b.alias("a"), F.col("low").alias("b")).where(a != b).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where(b != F.col("low")).select(b.alias("a"), F.col("low").alias("b"))
        edges = materialise(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "links")
        after = _digest(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(a.alias("node"), b.alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
