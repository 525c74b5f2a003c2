"""Connected components of a graph given by its links, as rounds of Spark joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicatlas.operators.lineage import cut_lineage


def _checksum(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("v", "u"))).first()
    )


def _to_minimum(sides: DataFrame) -> DataFrame:
    """Each row ``(u, v)`` with ``m``, the least of ``u`` and the nodes beside it.

    The minima are written before they are joined: both sides of the join are then
    plain exchanges, whose partitions Spark can split for a node with many links.
    """
    least = sides.groupBy("u").agg(F.min("v").alias("m"))
    least = cut_lineage(least.select("u", F.least("u", "m").alias("m")), "least")
    return sides.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``links (a, b)``; ``component`` is its least node.

    Alternates two contractions: every node hands its greater neighbours to its
    least neighbour, then its lesser ones.  Links become stars around the least
    node in a number of rounds that grows with the logarithm of the longest path.
    Links may repeat, and a node may be linked to itself; null ends are ignored.
    Each round is a written table, so a lost executor costs that round at most.
    """
    edges = (
        links.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges = cut_lineage(edges, "links")
    before = _checksum(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.distinct(), "large-star")
        small = _to_minimum(large)
        small = small.select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        ).select("e.u", "e.v")
        edges = cut_lineage(small.where("u != v").distinct(), "small-star")
        after = _checksum(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.union(centres)
