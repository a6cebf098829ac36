"""Connected components of a graph given as edges, by alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _mark(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mixed.cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").bitwiseXOR(mixed).cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node that has an edge; component is the least node reachable.

    ``edges``: long columns a, b in any order, repeats allowed. A round links every node to the least
    of its neighbours, first over larger neighbours, then over smaller ones; it is two aggregations
    and two joins, and the number of rounds grows with the logarithm of the longest path. Minima are
    aggregated before the shuffle and joins on a hub are split by AQE, so a hub needs no large task.
    Each round is a written table, so a lost executor costs one round at most.
    """
    # orient: a > b
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-0")
    before = _mark(now)
    for k in range(1, most_rounds + 1):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # written, so that the join's sides are plain shuffles and AQE can split a hub
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{tag}-least-{k}")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        mins = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(mins, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = scratch.save(small, f"{tag}-{k}")
        scratch.drop(f"{tag}-{k - 1}", f"{tag}-least-{k}")
        after, now = _mark(new), new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
