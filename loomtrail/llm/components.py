"""Connected components over an edge table, as alternating star contractions in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges``: two columns of longs. Returns (node, root) for every node that isn't its own root.

    Each round links the larger neighbours of every node to its smallest neighbour, then the smaller
    ones; it ends when the edges stay as they are. Every round costs two groupings with partial minima
    and two joins that adaptive execution may split, so a node with very many edges is no hot spot. No
    edge list reaches the driver: it reads only a row count and a sum of hashes each round. Null ends and
    loops are ignored; an empty table gives an empty result.
    """
    u, v = edges.columns
    edges = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct()
    edges, state = cut(edges), None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        edges = cut(_small_star(_large_star(edges)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # cut, so that the join may split a node with very many edges
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b, the smallest node of each node's component."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
