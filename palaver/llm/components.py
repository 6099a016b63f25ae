"""Connected components of a table of links, without collecting it.

Alternating large-star and small-star steps (Kiveris et al., 2014): every node is
pointed to the least node among its neighbours until the stars stop changing. The least
neighbour of a node is a map-side combined minimum, and the join back to the edges has one
row per node on its other side, so a node with very many links can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import forget, materialise

#: Rounds after which an error is raised (nothing is lost); they grow with the logarithm of the nodes.
MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v, once each."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("m", "u").alias("m"))
        out = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).groupBy("u", "v").agg(F.lit(1).alias("_one")).select("u", "v")


def _state(edges: DataFrame) -> tuple:
    """Count and order-free digests of the (distinct) edges, to tell when they stop changing."""
    seeds = [F.bit_xor(F.xxhash64(F.lit(seed), "u", "v")) for seed in (1, 2)]
    return tuple(edges.agg(F.count(F.lit(1)), *seeds).first())


def components(links: DataFrame, a: str = "a", b: str = "b", *, most: int | None = None) -> DataFrame:
    """(node, comp): every node of a link with the least node that it reaches.

    ``most``: an upper bound of the links, where known. A round turns edges into no more
    than twice as many.
    """
    least, most_node = F.least(a, b).alias("v"), F.greatest(a, b).alias("u")
    edges = links.where(F.col(a) != F.col(b)).select(most_node, least).groupBy("u", "v").agg(F.lit(1).alias("_one"))
    edges = materialise(edges.select("u", "v"), "cc-edges", rows=most)
    before = _state(edges)
    for _ in range(MAX_ROUNDS):
        new = materialise(_star(_star(edges, True), False), "cc-edges", rows=2 * before[0])
        now = _state(new)
        forget(edges)
        edges = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    parents = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return parents.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
