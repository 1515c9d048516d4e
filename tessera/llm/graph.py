"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v): link the neighbours v of each u to the least of u and its neighbours.

    The least neighbour is an aggregate that Spark sums up before the shuffle, and the join back to the pairs is one that
    adaptive execution splits when a hub has very many neighbours.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """node, root for every node that a link of edges touches; root is the least node that links reach.

    Self-links, repeated links and nulls are ignored. Each round is written to the shared folder, so no round is done
    again when an executor is lost; the rounds end when the links form stars (their number and checksum stay the same).
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    links = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, large=True)
        links = materialize(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), large=False), "links")
        new = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if new == mark or new[0] == 0:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
