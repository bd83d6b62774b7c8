"""Nearest neighbours by a forest of random-projection trees and exact reranking.

Every node of a tree splits a bounded sample at the median along a random direction that two power
steps have turned towards where the node's vectors spread; every vector of the table is put into its
leaf of every tree. A query walks all trees through one priority queue, ordered by how far it lies
beyond the splits on the way, and takes the best leaves of the forest. Leaves and their queries are
cut into blocks of bounded size; each block is compared exactly and keeps its best per query.

How many leaves a query reads is measured on the table: one pass finds the exact neighbours of
``PROBES`` vectors and the leaf of each, and queries read as many leaves as ``RECALL`` of these
neighbours need. Clustered vectors need few. Vectors without any structure, whose nearest
neighbours are hardly nearer than others, need a large part of the table.

Equal vectors become one class with its smallest ids first. The forest is that of the most frequent
width; vectors of any other width are compared exactly with all of their width. Vectors that are null,
empty, zero or hold null or non-finite components take no part, nor do those without an id. Ties go
to the smaller id. Only the named columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewatch.llm.common import by_batch, written
from lapsewatch.llm.vectors import stack, unit, usable

#: Trees, and their greatest depth; a leaf holds about sixteen vectors at least.
TREES, DEPTH = 4, 8
#: Vectors the splits are fitted on, about; every vector is indexed.
SAMPLE = 20_000
#: Vectors of a node that turn its direction.
SPREAD = 200
#: Vectors whose exact neighbours are looked up, and the part of these that must be found.
PROBES, RECALL = 64, 0.95
#: Vectors and queries of one block.
BLOCK, QUERIES = 10_000, 4_000


class Forest:
    """Random directions and thresholds of all inner nodes, level by level."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        random = np.random.default_rng(seed)
        inner = (1 << depth) - 1
        self.depth = depth
        self.direction = np.zeros((trees, inner, sample.shape[1]))
        self.cut = np.zeros((trees, inner))
        for tree in range(trees):
            node = np.zeros(len(sample), np.int64)
            for at in range(inner):  # level by level: a node's vectors are known when it is split
                held = np.flatnonzero(node == at)
                way = random.standard_normal(sample.shape[1])
                if len(held) > 3:
                    some = sample[random.choice(held, min(len(held), SPREAD), replace=False)]
                    some = some - some.mean(axis=0)
                    for _ in range(2):
                        turned = some.T @ (some @ way)
                        length = np.sqrt(turned @ turned)
                        way = turned / length if length > 1e-12 else way
                way /= np.sqrt(way @ way)
                side = sample[held] @ way
                self.direction[tree, at] = way
                self.cut[tree, at] = np.median(side) if len(held) else 0.0
                node[held] = 2 * at + 1 + (side > self.cut[tree, at])

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """Leaf number in the forest of each row (one column per tree)."""
        out = np.empty((len(rows), len(self.cut)), np.int32)
        inner = self.cut.shape[1]
        for tree, cut in enumerate(self.cut):
            side = rows @ self.direction[tree].T
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (side[np.arange(len(rows)), node] > cut[node])
            out[:, tree] = tree * (inner + 1) + node - inner
        return out

    def search(self, row: np.ndarray, wanted: int) -> list[int]:
        """The ``wanted`` leaves of least distance beyond splits, from one queue for all trees."""
        inner = self.cut.shape[1]
        margin = self.direction @ row - self.cut
        queue, found = [(0.0, tree, 0) for tree in range(len(self.cut))], []
        heapq.heapify(queue)
        while queue and len(found) < wanted:
            past, tree, node = heapq.heappop(queue)
            while node < inner:
                m = margin[tree, node]
                near = 2 * node + 1 + (m > 0)
                far = 4 * node + 3 - near
                heapq.heappush(queue, (past + m * m, tree, far))
                node = near
            found.append(tree * (inner + 1) + node - inner)
        return found


def _leaves_needed(classes: DataFrame, forest: Forest, k: int, seed: int) -> int:
    """Leaves to read so that ``RECALL`` of the probes' exact ``k`` neighbours are met.

    Each task compares its vectors with the probes and gives up ``k`` rows for each of them.
    """
    order = F.xxhash64("class", F.lit(seed + 1))
    probes = classes.orderBy(order, "class").limit(PROBES).select("class", "vec").collect()
    names, centres = [r["class"] for r in probes], unit(stack([r.vec for r in probes]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = pd.DataFrame({"probe": [], "class": [], "near": [], "leaves": []})
        for batch in batches:
            rows, own = unit(stack(batch.column(1).to_pylist())), batch.column(0).to_numpy()
            near = centres @ rows.T
            near[np.array(names)[:, None] == own] = -2
            at = np.argsort(-near, axis=1, kind="stable")[:, :k]
            met, of = np.unique(at, return_inverse=True)
            leaves = forest.leaves(rows[met])[of.ravel()]
            new = pd.DataFrame({"probe": np.repeat(np.arange(len(names)), at.shape[1]), "class": own[at].ravel(),
                                "near": np.take_along_axis(near, at, 1).ravel(), "leaves": list(leaves)})
            best = pd.concat([f for f in (best, new) if len(f)]).sort_values(["near", "class"], ascending=[False, True])
            best = best[(best["near"] > -2) & (best.groupby("probe").cumcount() < k)]
        if len(best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(best["probe"].astype(int), pa.int32()), pa.array(best["class"].astype(int), pa.int64()),
                 pa.array(best["near"].astype(float)), pa.array(list(best["leaves"]), pa.list_(pa.int32()))],
                ["probe", "class", "near", "leaves"])

    found = classes.select("class", "vec").mapInArrow(run, "probe int, class bigint, near double, leaves array<int>")
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("near"), "class"))
    ranks, orders = [], {}
    for r in found.withColumn("place", place).where(F.col("place") <= k).collect():  # PROBES * k rows
        if r.probe not in orders:
            walked = forest.search(centres[r.probe], forest.cut.shape[0] * (forest.cut.shape[1] + 1))
            orders[r.probe] = {leaf: i + 1 for i, leaf in enumerate(walked)}
        ranks.append(min(orders[r.probe][leaf] for leaf in r.leaves))
    ranks.sort()
    return ranks[math.ceil(RECALL * len(ranks)) - 1] if ranks else 1


def _few(rows: DataFrame, most: int) -> DataFrame:
    """A row per vector: its class (least key) and its ``most`` smallest keys.

    Batches give up all but their smallest keys before the shuffle, so a hot vector stays small.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        frame = batch.to_pandas().sort_values("key")
        frame = frame[frame.groupby("vec").cumcount() < most]
        return pa.RecordBatch.from_pandas(frame, preserve_index=False)

    few = by_batch(rows.select("key", "vec"), work, "key bigint, vec binary")
    return few.groupBy("vec").agg(
        F.slice(F.sort_array(F.collect_list("key")), 1, most).alias("keys")).select(
        F.col("keys")[0].alias("class"), "vec", "keys")


def _rerank(queries: pd.DataFrame, rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """The best ``most`` classes of a block for each query, by cosine of the original vectors."""
    if not len(queries) or not len(rows):
        return pd.DataFrame({"query": [], "class": [], "score": []}).astype(
            {"query": "int64", "class": "int64"})
    rows = rows.sort_values("class")
    q, x, ids = stack(queries["vec"]), stack(rows["vec"]), rows["class"].to_numpy()
    q_unit, x_unit, out = unit(q), unit(x), []
    x_norm = np.sqrt((x * x).sum(axis=1))
    for i in range(len(q)):
        near = x_unit @ q_unit[i]
        if len(near) > most:
            bound = np.partition(near, -most)[-most]
            at = np.flatnonzero(near >= bound - 1e-12)  # ties and rounding stay in
        else:
            at = np.arange(len(near))
        score = (x[at] * q[i]).sum(axis=1) / (x_norm[at] * np.sqrt((q[i] * q[i]).sum()))
        best = np.lexsort((ids[at], -score))[:most]
        out.append(pd.DataFrame({"query": queries["class"].iloc[i], "class": ids[at][best],
                                 "score": score[best]}))
    return pd.concat(out)


def search(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 5, trees: int = TREES,
           depth: int = DEPTH, share: float | None = None, seed: int = 7) -> DataFrame:
    """Rows (query_id, rank, key, score): the ``k`` nearest other rows found for each query row.

    ``share`` sets the part of the leaves that a query reads in place of the measured number.
    """
    rows = usable(df.where(F.col(key).isNotNull()), key, vector)
    rows = written(rows, "vectors")
    widths = rows.groupBy("width").agg(F.count(F.lit(1)).alias("n"))
    most = widths.orderBy(F.desc("n"), F.desc("width")).limit(1).first()
    classes = written(_few(rows, k + 1), "classes")
    of_query = rows.join(df.where(is_query).select(F.col(key).cast("bigint").alias("key")).distinct(),
                         "key").join(classes.select("class", "vec"), "vec").select("key", "class")
    of_query = written(of_query.distinct(), "queries")
    width = (F.octet_length("vec") / 8).cast("int")
    usual = classes.where(width == (most.width if most else 0))
    number = usual.count()
    sample = usual.where(F.pmod(F.xxhash64("class", F.lit(seed)), F.lit(max(1, number))) < SAMPLE)
    fitted = [r.vec for r in sample.orderBy("class").select("vec").collect()]
    if not fitted:
        return _ranked(df.sparkSession.createDataFrame([], "query bigint, class bigint, score double"),
                       classes, of_query, key, k)
    depth = max(1, min(depth, int(math.log2(number / 16)) if number > 32 else 1))
    forest = Forest(unit(stack(fitted)), trees, depth, seed)
    wanted = (_leaves_needed(usual, forest, k, seed) if share is None
              else max(trees, round(share * trees * (1 << depth))))

    def index(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = forest.leaves(unit(stack(batch.column(1).to_pylist())))
        at = pa.array(np.repeat(np.arange(batch.num_rows), found.shape[1]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(found.ravel())],
            ["class", "vec", "leaf"])

    def walk(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([forest.search(q, wanted) for q in unit(stack(batch.column(1).to_pylist()))],
                         np.int32)
        at = pa.array(np.repeat(np.arange(batch.num_rows), found.shape[1]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(found.ravel())],
            ["class", "vec", "leaf"])

    schema = "class bigint, vec binary, leaf int"
    def odd(frame: DataFrame) -> DataFrame:
        """Vectors of another width: one leaf a width, numbered below zero."""
        return frame.where(width != most.width).select("class", "vec", (-width).alias("leaf"))

    asked = classes.join(of_query.select("class").distinct(), "class").select("class", "vec")
    indexed = written(by_batch(usual.select("class", "vec"), index, schema).unionByName(odd(classes)), "leaves")
    walked = written(by_batch(asked.where(width == most.width), walk, schema).unionByName(odd(asked)), "walks")

    def blocks(frame: DataFrame, size: int, name: str) -> DataFrame:
        return frame.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    # At most one row per leaf of the forest and odd width, whatever the number of vectors.
    sizes = written(blocks(indexed, BLOCK, "n_rows").join(blocks(walked, QUERIES, "n_asked"), "leaf"), "sizes")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    own = F.xxhash64("class", F.lit(8))
    left = walked.join(sizes, "leaf").select("leaf", F.pmod(own, "n_asked").cast("int").alias("a"),
                                             every("n_rows").alias("r"), "class", "vec")
    right = indexed.join(sizes, "leaf").select("leaf", every("n_asked").alias("a"),
                                               F.pmod(own, "n_rows").cast("int").alias("r"), "class", "vec")
    group = ["leaf", "a", "r"]
    near = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(
        lambda queries, held: _rerank(queries, held, k + 1), "query bigint, class bigint, score double")
    return _ranked(near.distinct(), classes, of_query, key, k)


def _ranked(near: DataFrame, classes: DataFrame, of_query: DataFrame, key: str, k: int) -> DataFrame:
    """Classes found to rows: the query's own row leaves, equal vectors enter one by one."""
    best = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    few = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    rows = (few.join(classes.select("class", "keys"), "class")
            .select("query", "score", F.explode("keys").alias("found"))
            .join(of_query.select(F.col("key").alias("query_id"), F.col("class").alias("query")), "query")
            .where("found <> query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "found")
    return (rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("found").alias(key), "score"))
