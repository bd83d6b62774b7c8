"""Connected components of an edge table by alternating stars; nothing of it reaches the driver.

Each round joins edges with the least neighbour of a node, once for greater and once for lesser
neighbours. Hubs are no problem: least neighbours combine before the shuffle, and the joins split
skewed keys. Rounds grow with the logarithm of a component's size, not with its diameter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewatch.llm.common import written

MOST_ROUNDS = 60


class Union:
    """Union-find over positions; the root of a set is its least position."""

    def __init__(self, count: int):
        self.parent = list(range(count))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many edges as connect the same nodes: each from the least node of a tree to another of its nodes."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    union, half = Union(len(nodes)), len(a)
    for x, y in zip(places[:half].tolist(), places[half:].tolist()):
        union.join(x, y)
    roots = np.fromiter(map(union.root, range(len(nodes))), np.int64, len(nodes))
    other = roots != np.arange(len(nodes))
    return nodes[roots[other]], nodes[other]


def _local_forest(edges: DataFrame) -> DataFrame:
    """Drops edges that a batch of rows does not need for its connections."""
    def run(frames):
        for frame in frames:
            a, b = forest(frame["a"].to_numpy(), frame["b"].to_numpy())
            yield pd.DataFrame({"a": a, "b": b})
    return edges.mapInPandas(run, "a bigint, b bigint")


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star operation; edges have a < b."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("m"))
    large = edges.join(least, "a").select(F.col("m").alias("a"), "b")
    low = large.groupBy("b").agg(F.min("a").alias("m"))
    moved = large.join(low, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return low.select(F.col("m").alias("a"), "b").union(moved.distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node has lesser and greater neighbours, or two lesser ones."""
    both = edges.select("a", "b", F.lit(0).alias("low")).union(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("low")))
    return both.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most"), F.sum("low").alias("low")).where(
        "low > 1 OR low = 1 AND most > a").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node and component (least node reachable), for every node that has an edge."""
    pairs = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b")
    now = written(_local_forest(pairs), "edges")
    for _ in range(MOST_ROUNDS):
        now = written(_stars(now), "edges")
        if _settled(now):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
