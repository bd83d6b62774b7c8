"""Exact metric range join: all pairs of one label whose cosine reaches a threshold.

On unit vectors the threshold is a distance. Pivots, real vectors of the label, split its vectors
into cells of the nearest pivot. A vector is also sent to another cell if its distance to the
plane between the two pivots is within the range, which the triangle inequality gives for any
partner there. So each cell finds all partners of its own vectors alone. Cells are cut into
blocks of bounded size, so neither a hot label nor a dense cell has to fit one task.

Equal vectors of one label become one class first and count as links of each other. Vectors that
are null, empty, zero or hold null or non-finite components, and those without a label or a key, have
no links. Vectors of different widths are not compared. Repeated rows are vectors of their own. Only
the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewatch.llm.common import written
from lapsewatch.llm.components import components, forest
from lapsewatch.llm.vectors import stack, unit, usable

THRESHOLD = 0.98
#: A pivot for so many vectors of a label, and at most so many pivots.
CELL, PIVOTS = 1000, 64
#: Vectors of a block; a pair of blocks is one group.
BLOCK = 4000
#: Distances are widened by this against rounding; found pairs are compared by cosine itself.
SLACK = 1e-6


def _pivots(classes: DataFrame) -> DataFrame:
    """A row per pivot: of each hash bucket of a label the vector with the least hash."""
    order = F.xxhash64("rep", F.lit(3))
    size = classes.groupBy("group", "width").agg(F.count(F.lit(1)).alias("size"))
    return (classes.groupBy("group", "width", F.pmod(order, F.lit(PIVOTS)).alias("pivot"))
            .agg(F.min_by("vec", F.struct(order, "rep")).alias("vec")).join(size, ["group", "width"])
            .where(F.col("pivot") <= F.col("size") / CELL)
            .withColumn("parts", F.ceil(F.col("size") / (5 * BLOCK)).cast("int")))


def _place(rows: pd.DataFrame, pivots: pd.DataFrame, reach: float) -> pd.DataFrame:
    """Home cell of each vector and the cells it visits."""
    names = ["rep", "vec", "n", "group", "width", "cell", "home"]
    if not len(rows):
        return pd.DataFrame({n: [] for n in names})
    x, centres = unit(stack(rows["vec"])), stack(pivots["vec"]) if len(pivots) else None
    if centres is None:  # no bucket below the bound holds a vector: one cell
        near, cell = np.ones((len(x), 1), bool), np.zeros(len(x), np.int64)
    else:
        centres = unit(centres)
        squares = 2 - 2 * x @ centres.T
        cell = squares.argmin(1)
        between = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))[cell]
        past = squares - squares[np.arange(len(x)), cell][:, None]
        near = past <= 2 * between * (reach + SLACK) + SLACK
        near[np.arange(len(x)), cell] = True
    at, to = np.nonzero(near)
    out = rows.iloc[at][["rep", "vec", "n", "group", "width"]].reset_index(drop=True)
    out["cell"], out["home"] = to.astype(np.int32), to == cell[at]
    return out[names]


def _join(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Link counts of a block of home vectors with a block of all, and edges that connect them."""
    home, other = rows[rows["left"]], rows[~rows["left"]]
    if not len(home) or not len(other):
        return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
    ids, others = home["rep"].to_numpy(), other["rep"].to_numpy()
    x, y, weight = unit(stack(home["vec"])), unit(stack(other["vec"])), other["n"].to_numpy()
    counts, left, right = np.zeros(len(ids), np.int64), [], []
    for start in range(0, len(ids), 500):
        near = x[start:start + 500] @ y.T >= threshold
        near &= ids[start:start + 500, None] != others
        counts[start:start + 500] = near @ weight
        at, to = np.nonzero(near)
        a, b = forest(ids[start + at], others[to])
        left.append(a)
        right.append(b)
    a, b = forest(np.concatenate(left), np.concatenate(right))
    linked = counts > 0
    return pd.DataFrame({"a": np.concatenate([ids[linked], a]),
                         "b": np.concatenate([np.full(linked.sum(), -1), b]),
                         "n": np.concatenate([counts[linked], np.zeros(len(a), np.int64)])})


def linked(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (a, -1, n): links of class ``a``; rows (a, b, 0): edges that connect what is linked."""
    reach = float(np.sqrt(2 - 2 * threshold))
    pivots = written(_pivots(classes), "pivots")
    parts = pivots.groupBy("group", "width").agg(F.max("parts").alias("parts"))
    keys = ["group", "width", "part"]
    spread = classes.join(parts, ["group", "width"], "left").withColumn(
        "part", F.pmod(F.xxhash64("rep", F.lit(4)), F.coalesce("parts", F.lit(1))).cast("int"))
    copied = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = written(spread.groupBy(*keys).cogroup(copied.groupBy(*keys)).applyInPandas(
        lambda rows, centres: _place(rows, centres, reach),
        "rep bigint, vec binary, n bigint, group string, width int, cell int, home boolean"), "cells")
    cell = ["group", "width", "cell"]
    sizes = placed.groupBy(*cell).agg(
        F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).cast("int").alias("lefts"),
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("rights"))
    sized = placed.join(sizes, cell).where("lefts > 0")
    mine = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("lefts"))
    theirs = F.pmod(F.xxhash64("rep", F.lit(6)), F.col("rights"))

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    columns = [*cell, "rep", "vec", "n"]
    lefts = sized.where("home").select(*columns, F.lit(True).alias("left"),
                                       mine.cast("int").alias("l"), every("rights").alias("r"))
    rights = sized.select(*columns, F.lit(False).alias("left"),
                          every("lefts").alias("l"), theirs.cast("int").alias("r"))
    return written(lefts.unionByName(rights).groupBy(*cell, "l", "r").applyInPandas(
        lambda rows: _join(rows, threshold), "a bigint, b bigint, n bigint"), "links")


def range_join(df: DataFrame, key: str, vector: str, label: str,
               threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: key, n_links, component_id (least key reachable) and kept."""
    rows = written(usable(
        df.where(F.col(label).isNotNull() & F.col(key).isNotNull()), key, vector, label), "vectors")
    equal = ["group", "width", "vec"]
    classes = written(rows.groupBy(*equal).agg(
        F.min("key").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    found = linked(classes, threshold)
    counts = found.where("b = -1").groupBy("a").agg(F.sum("n").alias("links"))
    parts = components(found.where("b >= 0"))
    facts = (classes.join(counts, classes["rep"] == counts["a"], "left")
             .join(parts, F.col("rep") == F.col("node"), "left")
             .select(*equal, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    linkable = rows.join(facts, equal).select("key", "n_links", "component_id")
    rest = df.select(F.col(key).cast("bigint").alias("key"), F.lit(1).alias("one"))
    # Rows that take no part: their keys, as often as they occur beyond the usable rows.
    alone = (rest.groupBy("key").agg(F.count("one").alias("all"))
             .join(rows.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("some")),
                   F.col("key").eqNullSafe(F.col("k")), "left")
             .withColumn("spare", F.col("all") - F.coalesce("some", F.lit(0))).where("spare > 0")
             .select("key", F.lit(0).cast("bigint").alias("n_links"),
                     F.col("key").alias("component_id"),
                     F.explode(F.sequence(F.lit(1), F.col("spare"))).alias("copy")).drop("copy"))
    return linkable.unionByName(alone).select(
        F.col("key").alias(key), "n_links", "component_id",
        (F.col("key") == F.col("component_id")).alias("kept"))
