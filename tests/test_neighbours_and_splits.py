"""Nearest-neighbour information, exact splits and order-preserving codes against plain computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsewatch.functions.scalars import digamma
from lapsewatch.operators import encoding, neighbours, splitting

EULER = 0.57721566490153286


def harmonic_digamma(n):
    return sum(1 / i for i in range(1, n)) - EULER


def test_digamma(spark):
    for r in spark.createDataFrame([(n,) for n in (1, 2, 3, 7, 50, 1000)], "n bigint").select(
            "n", digamma(F.col("n")).alias("d")).collect():
        assert r.d == pytest.approx(harmonic_digamma(r.n), abs=1e-11)


def brute(values, labels, k):
    x, y = np.array(values), np.array(labels)
    keep = np.array([(y == c).sum() > 1 for c in y])
    ks, sizes, counts = [], [], []
    for i in np.flatnonzero(keep):
        same = np.flatnonzero(y == y[i])
        own = min(k, len(same) - 1)
        gaps = np.sort(np.abs(x[same] - x[i]))
        r = gaps[own]
        ks.append(own)
        sizes.append(len(same))
        counts.append(max(1, int((np.abs(x - x[i]) < r).sum())))
    mean = lambda n: np.mean([harmonic_digamma(v) for v in n])
    return max(0.0, harmonic_digamma(len(x)) + mean(ks) - mean(sizes) - mean(counts))


def test_information_equals_brute_force(spark, monkeypatch):
    """Two thousand rows in slices of 64: a wide gap, a rare class, ties, and a column without link."""
    monkeypatch.setattr(neighbours, "SLICE", 64)
    draw = random.Random(5)
    rows = []
    for i in range(2000):
        label = 2 if i % 400 == 0 else int(draw.random() < 0.3)
        rows.append((f"c{i}", label, draw.gauss(label * 2.0, 1.0) + (1000 if i % 97 == 0 else 0),
                     float(draw.randint(0, 6)), draw.random() if i % 50 else None))
    df = spark.createDataFrame(rows, "customerID string, label int, near double, tied double, other double").repartition(5)
    got = {r.feature: r.mi_score for r in neighbours.neighbour_information(df, ["near", "tied", "other"]).collect()}
    moved = neighbours.shifted(df, ["near", "tied", "other"]).collect()
    assert set(got) == {"near", "tied", "other"}
    for name, score in got.items():
        mine = [(r.value, r.label) for r in moved if r.feature == name]
        assert score == pytest.approx(brute(*zip(*mine), 3), abs=1e-9), name
    assert got["near"] > 0.3 > got["other"]


def test_information_of_repeated_rows_and_tiny_classes(spark):
    rows = [("a", 0, 1.0)] * 3 + [("b", 1, 2.0), ("c", 1, 5.0), ("d", 7, 1.0), (None, None, 1.0)]
    df = spark.createDataFrame(rows, "customerID string, label int, v double")
    assert [r.feature for r in neighbours.neighbour_information(df, ["v"]).collect()] == ["v"]


@pytest.mark.parametrize("n", [1, 2, 7, 3001])
def test_splits_hold_every_class_to_the_row(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("customerID"), F.expr(
        "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 4 = 0 THEN 1 ELSE 0 END").alias("label"))
    out = splitting.add_exact_split(df)
    sizes = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    got = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert sum(got.values()) == n
    for label, size in sizes.items():
        for part, share in splitting.TRAIN_VALIDATION_TEST:
            assert abs(got.get((label, part), 0) - share * size) < 1 + 1e-9
    folds = splitting.add_exact_folds(df, 5).groupBy("label", "fold").count().collect()
    for label, size in sizes.items():
        mine = [r["count"] for r in folds if r.label == label] + [0] * 5
        assert max(mine) <= math.ceil(size / 5) and sum(mine) == size


def test_codes_of_values_with_one_prefix(spark):
    """All values begin alike; no slice may hold more than a fair part of them."""
    values = [f"customer/{i:05d}é" for i in range(3000)]
    few = [None, "b", "a", "B"]
    rows = [(str(i), values[i * 7 % 3000], few[i % 4]) for i in range(6000)]
    df = spark.createDataFrame(rows, "customerID string, many string, few string").repartition(6)
    codes = {(r.feature, r.value): r.code for r in encoding.level_codes(df, ["many", "few"]).collect()}
    assert [codes["many", v] for v in sorted(values)] == list(range(3000))
    assert [codes["few", v] for v in ("B", "a", "b")] == [0, 1, 2]
    out = {r.customerID: (r.many, r.few) for r in encoding.label_encode(df, ["many", "few"]).collect()}
    assert len(out) == 6000
    for key, many, one in rows:
        assert out[key] == (values.index(many), {None: 0, "B": 0, "a": 1, "b": 2}[one])
    with pytest.raises(ValueError, match="many has 3000 levels"):
        encoding.one_hot(df, ["few", "many"])
