"""Connected components of a large graph, by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a grouped minimum and a join, so a hub with very many links is pre-aggregated on the map side and its join
partition can be split; no group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatmeter.llm.common import settled
from seatmeter.session import MAX_BROADCAST_ROWS


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Link every larger neighbour of u to the smallest of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(F.broadcast(least) if few else least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """Link u and its smaller neighbours to the smallest of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(F.broadcast(least) if few else least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(u, v): every node of `edges` except each component's smallest, with that smallest node.

    `edges` has two columns of one orderable type, u and v. Self links and repeated links are ignored. The steps
    shrink the distance to the smallest node fast, so a few rounds are enough; `limit` only guards against a fault,
    and reaching it is an error, never a wrong result.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = settled(edges, "components")
    mark = _mark(edges)
    for _ in range(limit):
        if not mark[0]:
            return edges
        # There are at most twice as many nodes as links. Few of them are broadcast, so a hub's links stay spread out.
        few = 2 * mark[0] <= MAX_BROADCAST_ROWS
        edges = settled(_small_star(_large_star(edges, few), few), "components")
        before, mark = mark, _mark(edges)
        if mark == before:
            return edges
    raise RuntimeError("the components did not settle")
