"""Range join and nearest neighbours against brute force, with vectors that take no part."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsewatch.llm import components, nearest, rangejoin

SCHEMA = "vec_id bigint, embedding array<float>, label int, n_links int"


@pytest.fixture(scope="module")
def rows():
    random = np.random.default_rng(2)
    out, number = [], 0
    for label in range(3):
        for _ in range(60):
            base = random.standard_normal(8)
            for copy in range(random.integers(1, 5)):
                noise = random.standard_normal(8) * random.choice([0, 0.05, 0.15])
                out.append((number, (base + noise).astype(np.float32).tolist(), label, 0))
                number += 1
    bad = [None, [], [0.0] * 8, [1.0] * 7 + [math.nan], [1.0] * 7 + [None], [1.0, 2.0]]
    out += [(number + i, v, 1, 0) for i, v in enumerate(bad)]
    out += [(number + 10, out[0][1], None, 0), (number + 11, out[0][1], 0, 0), (number + 11, out[0][1], 0, 0)]
    return out


def good(vector):
    return (vector is not None and len(vector) == 8 and None not in vector
            and all(map(math.isfinite, vector)) and any(vector))


def test_range_join(spark, rows):
    out = rangejoin.range_join(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label").collect()
    use = [i for i, r in enumerate(rows) if good(r[1]) and r[2] is not None]
    x = np.array([rows[i][1] for i in use], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (np.array([rows[i][2] for i in use])[:, None] == [rows[i][2] for i in use])
    union = components.Union(len(use))
    for a, b in zip(*np.nonzero(near)):
        union.join(int(a), int(b))
    least = collections.defaultdict(lambda: 10 ** 9)
    for i, r in enumerate(use):
        least[union.root(i)] = min(least[union.root(i)], rows[r][0])
    want = [(rows[r][0], int(near[i].sum()) - 1, least[union.root(i)]) for i, r in enumerate(use)]
    want += [(r[0], 0, r[0]) for i, r in enumerate(rows) if i not in set(use)]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == sorted(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_blocks_and_cells_agree(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(rangejoin.range_join(df, "vec_id", "embedding", "label").collect())
    monkeypatch.setattr(rangejoin, "BLOCK", 15)
    monkeypatch.setattr(rangejoin, "CELL", 20)
    assert sorted(rangejoin.range_join(df, "vec_id", "embedding", "label").collect()) == whole


def test_search(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = nearest.search(df, "vec_id", "embedding", F.col("vec_id") % 10 == 0, share=1.0).collect()
    use = [r for r in rows if good(r[1])]
    x, ids = np.array([r[1] for r in use], float), np.array([r[0] for r in use])
    want = []
    for query in sorted({r[0] for r in use if r[0] % 10 == 0}):
        q = x[ids == query][0]
        score = (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))
        score[ids == query] = -9
        best = np.lexsort((ids, -score))[:5]
        want += [(query, n + 1, int(ids[i])) for n, i in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in out) == want


def brute(x, ids, query, k=5):
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = unit @ unit[ids == query][0]
    near[ids == query] = -9
    return [int(i) for i in ids[np.lexsort((ids, -near))[:k]]]


def test_clusters_need_few_leaves(spark):
    random = np.random.default_rng(4)
    centres = random.standard_normal((40, 24)) * 4
    x = np.repeat(centres, 60, axis=0) + random.standard_normal((2400, 24)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    classes = nearest._few(nearest.usable(df, "vec_id", "embedding"), 6)
    forest = nearest.Forest(nearest.unit(x), nearest.TREES, 7, 7)
    leaves = nearest._leaves_needed(classes, forest, 5, 7)
    assert leaves <= 0.1 * nearest.TREES * 128
    found = collections.defaultdict(list)
    for r in nearest.search(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect():
        found[r.query_id].append((r["rank"], r.vec_id))
    hit = sum(len({v for _, v in found[q]} & set(brute(x, np.arange(2400), q))) for q in range(0, 2400, 50))
    assert hit >= 0.9 * 5 * 48


def test_leaves_needed_against_brute_force(spark):
    """The measured number is the least that meets the wanted part of the probes' neighbours."""
    random = np.random.default_rng(5)
    x = nearest.unit(random.standard_normal((300, 6)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    classes = nearest._few(nearest.usable(df, "vec_id", "embedding"), 6)
    forest = nearest.Forest(x, 2, 4, 3)
    got = nearest._leaves_needed(classes, forest, 5, 7)
    probes = [r["class"] for r in classes.orderBy(F.xxhash64("class", F.lit(8)), "class").limit(nearest.PROBES).collect()]

    def part(wanted):
        hit = 0
        for p in probes:
            read = set(forest.search(x[p], wanted))
            hit += sum(bool(read & set(map(int, forest.leaves(x[[v]])[0]))) for v in brute(x, np.arange(300), p))
        return hit / (5 * len(probes))

    assert part(got) >= nearest.RECALL > part(got - 1)


def test_every_width_is_searched(spark):
    random = np.random.default_rng(6)
    data = [(i, random.standard_normal(3 if i % 4 == 0 else 8 if i % 4 < 3 else 5).tolist()) for i in range(200)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    found = collections.defaultdict(list)
    for r in nearest.search(df, "vec_id", "embedding", F.col("vec_id") % 10 == 0, share=1.0).collect():
        found[r.query_id].append((r["rank"], r.vec_id))
    for query in range(0, 200, 10):
        held = [(i, v) for i, v in data if len(v) == len(data[query][1])]
        want = brute(np.array([v for _, v in held]), np.array([i for i, _ in held]), query)
        assert [v for _, v in sorted(found[query])] == want


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert nearest.search(df, "vec_id", "embedding", F.lit(True)).count() == 0
    assert rangejoin.range_join(df, "vec_id", "embedding", "label").count() == 0


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = df.collect()
    x = np.array([r.embedding for r in data], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, hit, all_ = np.array([r.vec_id for r in data]), 0, 0
    found = collections.defaultdict(set)
    for r in nearest.search(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect():
        found[r.query_id].add(r.vec_id)
    for i in np.flatnonzero(ids % 50 == 0):
        score = x @ x[i]
        score[i] = -9
        best = {int(v) for v in ids[np.argsort(-score)[:5]]}
        hit, all_ = hit + len(best & found[int(ids[i])]), all_ + 5
    assert hit / all_ >= 0.9


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(7, 7)]
    out = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    want = {i: 100 for i in range(100, 161)} | {i: 5 for i in [5, *range(200, 260)]}
    assert {r.node: r.component for r in out} == want and len(out) == len(want)


def test_local_forest_is_stars():
    """What a batch of edges gives up are edges from the least node of each component, in any order of the edges."""
    random = np.random.default_rng(3)
    order = random.permutation(29)
    a, b = components.forest(np.arange(30, 59)[order], np.arange(31, 60)[order])
    assert set(a.tolist()) == {30} and sorted(b.tolist()) == list(range(31, 60))
