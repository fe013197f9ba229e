"""Connected components of an edge table by alternating star contractions; labels are the smallest reachable node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) of each node of edges (a, b). Each round's edges are written to the shared folder; rounds go with the
    logarithm of the longest path, and not to have converged after `rounds` of them is an error.

    A large star links each node's larger neighbours to its smallest one, a small star its smaller ones; neither grows
    the number of edges, and a hub's neighbours are aggregated, not collected.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(edges)
    for _ in range(rounds if state[0] else 0):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
        large = both.join(lowest, F.col("u") == F.col("of")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "of")
        joined = large.join(lowest, F.col("u") == F.col("of"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lowest.select(F.col("of").alias("u"), F.col("m").alias("v"))).distinct()
        edges = written(small, "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components have not converged in {rounds} rounds")
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes: alike in two rounds only when nothing has changed."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return r["n"], r["h"]
