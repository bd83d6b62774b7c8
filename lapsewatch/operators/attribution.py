"""Contributions of the features to a tree ensemble's answer, by the path of each row.

On its way down a tree every split moves a row from the value of one node to that of the next; the
difference belongs to the feature that was asked. Summed over the trees, contributions and the
bias (the values of the roots) give the answer itself, exactly: the margin of boosted trees, the
probability of class 1 of a forest or a single tree. The ensemble travels with the tasks as small
arrays (a row per node); rows are worked on in Arrow batches where they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewatch.session import scratch_path

NODES = ("tree int, weight double, id int, value double, left_id int, right_id int, feature int, "
         "cut array<double>, categories int")


def tree_table(model: Model, spark) -> DataFrame:
    """A row per node of a fitted ensemble or tree, read from its saved form."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    boosted = "GBT" in type(model).__name__
    if "treeID" in data.columns:
        weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "about", "weight").select("tree", "weight")
        nodes = data.select(F.col("treeID").alias("tree"), "nodeData.*").join(weights, "tree")
        if not boosted:
            total = weights.agg(F.sum("weight")).first()[0]
            nodes = nodes.withColumn("weight", F.col("weight") / total)
    else:
        nodes = data.withColumns({"tree": F.lit(0), "weight": F.lit(1.0)})
    share = F.col("impurityStats")[1] / F.aggregate("impurityStats", F.lit(0.0), lambda t, x: t + x)
    return nodes.select(
        "tree", "weight", "id", (F.col("prediction") if boosted else share).alias("value"),
        F.col("leftChild").alias("left_id"), F.col("rightChild").alias("right_id"),
        F.col("split.featureIndex").alias("feature"), F.col("split.leftCategoriesOrThreshold").alias("cut"),
        F.col("split.numCategories").alias("categories"))


@dataclass
class Forest:
    """Nodes of all trees, one after the other; a leaf leads to itself."""

    roots: np.ndarray
    weight: np.ndarray  # per tree
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray  # -1: leaf
    threshold: np.ndarray
    go_left: np.ndarray  # (node, category): whether a category goes left
    by_category: np.ndarray
    depth: int

    @classmethod
    def of(cls, nodes: DataFrame) -> Forest:
        """The arrays of a node table; as many rows as the ensemble has nodes come to the driver."""
        rows = sorted(nodes.collect(), key=lambda r: (r.tree, r.id))
        at = {(r.tree, r.id): i for i, r in enumerate(rows)}
        leaf = np.array([r.left_id < 0 for r in rows])
        kinds = np.array([not end and r.categories >= 0 for r, end in zip(rows, leaf)])
        width = max([2] + [r.categories for r, k in zip(rows, kinds) if k])
        go_left = np.zeros((len(rows), width), bool)
        for i, r in enumerate(rows):
            if kinds[i]:
                go_left[i, [int(c) for c in r.cut]] = True
        left = np.array([i if leaf[i] else at[r.tree, r.left_id] for i, r in enumerate(rows)])
        right = np.array([i if leaf[i] else at[r.tree, r.right_id] for i, r in enumerate(rows)])
        trees = sorted({(r.tree, r.weight) for r in rows})
        roots = np.array([at[t, 0] for t, _ in trees])
        level, depth = set(roots.tolist()), 0
        while level := {c for i in level if not leaf[i] for c in (left[i], right[i])}:
            depth += 1
        return cls(roots, np.array([w for _, w in trees]), np.array([r.value for r in rows]), left, right,
                   np.array([-1 if end else r.feature for r, end in zip(rows, leaf)]),
                   np.array([r.cut[0] if not end and not k else 0.0 for r, end, k in zip(rows, leaf, kinds)]),
                   go_left, kinds, depth)

    @property
    def bias(self) -> float:
        return float((self.weight * self.value[self.roots]).sum())

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """A number per row and slot."""
        n, slots = x.shape
        node = np.broadcast_to(self.roots, (n, len(self.roots))).copy()
        rows = np.broadcast_to(np.arange(n)[:, None], node.shape)
        out = np.zeros(n * slots)
        for _ in range(self.depth):
            asked = self.feature[node]
            open_ = asked >= 0
            held = x[rows, np.maximum(asked, 0)]
            category = np.clip(np.nan_to_num(held), 0, self.go_left.shape[1] - 1).astype(int)
            goes = np.where(self.by_category[node], self.go_left[node, category], held <= self.threshold[node])
            after = np.where(goes, self.left[node], self.right[node])
            moved = (self.value[after] - self.value[node]) * self.weight
            out += np.bincount((rows * slots + np.maximum(asked, 0))[open_], moved[open_], n * slots)
            node = after
        return out.reshape(n, slots)


def path_contributions(forest: Forest, vector: Column) -> Column:
    """Array of a contribution per slot of an array column of the vector's numbers."""
    @F.pandas_udf("array<double>")
    def work(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=object)
        return pd.Series(list(forest.contributions(np.stack(values.to_numpy()).astype(float))))
    return work(vector)


def strongest(contributions: Column, names: Sequence[str], n: int = 3) -> Column:
    """The n slots that move the answer most, as (feature, term), strongest first."""
    named = F.zip_with(contributions, F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(name).alias("feature")) for i, name in enumerate(names)]),
        lambda x, s: F.struct((-F.abs(x)).alias("size"), s["place"].alias("place"),
                              s["feature"].alias("feature"), x.alias("term")))
    return F.transform(F.slice(F.sort_array(named), 1, n), lambda t: F.struct(t["feature"], t["term"]))


def attributed(rows: DataFrame, forest: Forest, names: Sequence[str], vector: str = "features",
               n: int = 3) -> DataFrame:
    """The rows with ``contributions``, ``margin`` (their sum and the bias) and the ``strongest`` ones."""
    array = vector if rows.schema[vector].dataType.typeName() == "array" else None
    found = path_contributions(forest, F.col(vector) if array else vector_to_array(vector))
    rows = rows.withColumn("contributions", found)
    total = F.aggregate("contributions", F.lit(forest.bias), lambda t, x: t + x)
    return rows.withColumns({"margin": total, "strongest": strongest(F.col("contributions"), names, n)})
