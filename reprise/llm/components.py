"""Connected components by alternating large-star and small-star steps, each an aggregate and a join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

FEW = 200_000  #: edges that the driver links itself (16 bytes each), as a round of stages takes longer than they do


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, root of each) of the edges from u to v, root being the smallest node that it is connected to."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[x], root[y]
        if (a == b).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b) of longs: root is the smallest node that it is connected to.

    Minima come from aggregates with partial sums on the map side, so that a node with many edges isn't gathered in one
    place; the number of rounds grows with the logarithm of the longest path. Edges from a node to itself say nothing.
    FEW edges at most are linked on the driver, with the same result.
    """
    cur = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if cur.count() <= FEW:
        got = cur.toArrow()
        nodes, roots = smallest(got["u"].to_numpy(), got["v"].to_numpy())
        return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(roots, pa.int64())}))
    before = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = checkpoint(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first())
        if now == before:
            break
        before = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
