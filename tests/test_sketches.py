"""Merged daily sketches against one pass over the rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lapsewatch.operators import drift, sketches

START = dt.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(8)
    made = [(START + dt.timedelta(hours=draw.randrange(24 * 20)), draw.gauss(10, 3), float(draw.randint(0, 4)),
             f"u{draw.randint(0, 2500)}") for _ in range(12000)]
    made += [(START, None, float("nan"), None), (None, 1.0, 1.0, "late")]
    return spark.createDataFrame(made, "at timestamp, x double, step double, user string").repartition(5).cache()


def test_windows_equal_one_pass(spark, rows, tmp_path):
    sketches.daily(rows, "at", ["x", "step"], ["user"]).write.parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days"))
    found = {r.column_name: r for r in sketches.profile(sketches.window(days, "2024-03-03", "2024-03-12")).collect()}
    inside = rows.where("at >= '2024-03-03' AND at < '2024-03-13'")
    n = inside.count()
    exact = inside.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.countDistinct("user").alias("u")).first()
    assert (found["x"].n, found["x"].nulls, found["user"].deciles) == (n, 0, None)
    assert found["x"].mean == pytest.approx(exact.m) and found["x"].std == pytest.approx(exact.s)
    assert found["user"].distinct_values == pytest.approx(exact.u, rel=sketches.DISTINCT_ERROR)
    values = sorted(r.x for r in inside.select("x").collect())
    for i, cut in enumerate(found["x"].deciles):
        below = sum(v < cut for v in values)
        assert abs(below - i / 10 * n) <= sketches.RANK_ERROR * n + 1
    whole = {r.column_name: r for r in sketches.profile(sketches.merged(days)).collect()}
    assert (whole["x"].n, whole["x"].nulls, whole["step"].nulls) == (12002, 1, 1)


def test_index_is_close_to_the_exact_one(rows):
    moved = rows.withColumn("x", F.col("x") + F.when(F.col("at") > "2024-03-11", 4.0).otherwise(0.0))
    days = sketches.daily(moved, "at", ["x", "step"])
    first, last = F.col("at") < "2024-03-12", F.col("at") >= "2024-03-12"
    exact = {r.feature: r for r in drift.psi(moved.where(first), moved.where(last), ["x", "step"]).collect()}
    got = {r.feature: r for r in sketches.psi(sketches.window(days, "2024-03-01", "2024-03-11"),
                                              sketches.window(days, "2024-03-12", "2024-04-01")).collect()}
    assert set(got) == {"x", "step"} and got["x"].is_drifted and not got["step"].is_drifted
    for name, r in got.items():
        assert r.psi == pytest.approx(exact[name].psi, abs=0.02 + 0.1 * exact[name].psi)


def test_empty_windows(rows):
    days = sketches.daily(rows, "at", ["x"], ["user"])
    none = sketches.window(days, "2030-01-01", "2030-01-02")
    assert none.count() == 0 and sketches.psi(none, none).count() == 0
    assert sketches.daily(rows.limit(0), "at", ["x"]).count() == 0


def test_rolling_mean(rows):
    days = sketches.daily(rows, "at", ["step"])
    got = {r.day: r for r in sketches.rolling_mean(days, "step", 3).collect()}
    values = [(r.at.date(), r.step) for r in rows.where("at IS NOT NULL AND NOT isnan(step)").collect()]
    for day, r in got.items():
        mine = [v for d, v in values if 0 <= (day - d).days < 3]
        assert r.requests == len(mine) and r.mean == pytest.approx(sum(mine) / len(mine))
