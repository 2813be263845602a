"""Connected components of an edge table by alternating large and small stars; all state stays in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(sides: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours; summed in the map tasks first, so a node with many edges is no burden."""
    return sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the component's least node. Loops, repeated and empty edge tables are fine.

    Each round is two joins of edges with nodes; a node with very many edges is a large join key, which Spark splits.
    Stops when a round changes nothing; raises RuntimeError if that takes more than most_rounds."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(state) == seen or not state["n"]:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = tuple(state)
        sides = _both(now)
        first = materialize(_least(sides), "least")
        large = materialize(sides.where("v > u").join(first, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        second = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(second, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, now = now, materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "small")
        discard(before, first, large, second)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
