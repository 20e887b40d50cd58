"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def _to_least(arcs: DataFrame, larger_only: bool) -> DataFrame:
    """For each u, its arcs (u, v) turned to the least of u and its neighbours."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    turned = arcs.join(least, "u")
    if larger_only:
        return turned.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return turned.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the least node that it reaches. Self links and repeated links do no harm.

    A round turns arcs to the least neighbour twice: first those to larger nodes, then those to smaller ones; a path's length falls by a constant
    factor. No task holds a node's whole neighbourhood: minima are partial sums, and joins can be split. Each round is written out."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, True).where("u <> v").distinct()
        edges = cut(_to_least(large, False).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
