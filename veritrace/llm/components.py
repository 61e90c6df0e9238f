"""Connected components of a graph given by edges, in a number of rounds that grows with the logarithm of the longest path.

Each round hangs every neighbour of a node under the smallest one (large star: the greater neighbours, small star: the
rest), so edges never multiply, and is written to the shared folder. Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(low)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of columns a, b of `edges` reaches; only nodes with an edge."""
    now = materialize(edges.select("a", "b").where("a != b").distinct(), "edges")
    said = None
    while not now.isEmpty():
        then = materialize(_small_star(_large_star(now).where("a != b").distinct()).distinct(), "stars")
        forget(now)
        now = then
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        if tuple(new) == said:
            break
        said = tuple(new)
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.union(now.select(F.col("b"), F.col("b")).distinct())


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with edges i-j the smallest node that each reaches, without a loop over edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:
            further = new[new]
            if (further == new).all():
                break
            new = further
        if (new == label).all():
            return label
        label = new
