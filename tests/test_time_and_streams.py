import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lapsewatch.operators import metrics, pointintime, splitting, uplift
from lapsewatch.streaming import jobs, requests, stateful

START = dt.datetime(2024, 1, 1)


def events(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("forward", [False, True])
def test_as_of_join_with_a_hot_key(spark, forward):
    """Two thirds of all rows belong to one key; every result is compared with brute force."""
    source = random.Random(9)

    def key():
        return "hot" if source.random() < 0.66 else f"k{source.randrange(5)}"

    asked = [(i, key(), START + dt.timedelta(minutes=source.randrange(5000))) for i in range(300)]
    known = [(key(), START + dt.timedelta(minutes=source.randrange(5000)), float(i), i) for i in range(300)]
    joined = pointintime.as_of_join(
        events(spark, asked, "id int, k string, t timestamp"),
        events(spark, known, "k string, ft timestamp, v double, n int"),
        "k", "t", "ft", ["v"], "n", forward=forward, within_seconds=36000, slices=16)
    got = {r.id: r.v for r in joined.collect()}
    assert len(got) == 300
    for i, k, t in asked:
        if forward:
            best = min(((ft, n, v) for kk, ft, v, n in known if kk == k and ft >= t),
                       key=lambda x: (x[0], -x[1]), default=None)
        else:
            best = max(((ft, n, v) for kk, ft, v, n in known if kk == k and ft <= t),
                       key=lambda x: (x[0], x[1]), default=None)
        fresh = best and abs((best[0] - t).total_seconds()) <= 36000
        assert got[i] == (best[2] if fresh else None)


def test_latest_and_unknown_keys(spark):
    rows = events(spark, [("a", START, 1.0), ("a", START + dt.timedelta(days=1), 2.0), ("b", START, 3.0)],
                  "k string, at timestamp, v double")
    newest = pointintime.latest_per_key(rows, "k", "at", ["v"], as_of=F.lit(START + dt.timedelta(days=2)),
                                        ttl_days=1.5)
    assert [(r.k, r.v) for r in newest.collect()] == [("a", 2.0)]
    asked = spark.createDataFrame([("a",), ("z",), ("z",)], "k string")
    assert [tuple(r) for r in pointintime.unknown_keys(asked, rows, "k").collect()] == [("z", 2)]


def write_slices(spark, path, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


LOG = "request_id bigint, ts timestamp, customer bigint, endpoint string, is_error int, prob double, latency_s double"


def test_late_rows_are_dropped(spark, tmp_path):
    def row(i, hours):
        return (i, START + dt.timedelta(hours=hours), 1, "predict", 0, 0.5, 0.1)
    path = str(tmp_path / "log")
    schema = LOG

    def run():
        stream = spark.readStream.schema(schema).parquet(path)
        return requests.run_to_table(
            requests.request_counts(stream, "1 hour", "1 hour"), str(tmp_path / "out"))

    spark.createDataFrame([row(1, 0), row(2, 10)], schema).write.parquet(path)
    run()
    spark.createDataFrame([row(3, 0.5), row(4, 9.5), row(5, 20)], schema).write.mode("append").parquet(path)
    got = {r.window_start.hour: r.requests for r in run().collect()}
    # The window 0-1h was closed before row 3 came; 9-10h was still open for row 4.
    assert got == {0: 1, 9: 1, 10: 1}


def label_events():
    source = random.Random(4)
    made, labels = [], []
    for i in range(120):
        customer = 1 if source.random() < 0.5 else source.choice([2, 3, 4, 5, None])
        hour = i * 4 + source.randrange(4)
        kind = made if source.random() < 0.7 else labels
        kind.append((i, customer, START + dt.timedelta(hours=hour), 0.5 if kind is made else 1.0))
    made += [made[7], made[7], (900, 1, START + dt.timedelta(hours=5), None)]
    labels += [(901, 1, labels[3][2], 0.0), (902, 77, START, 1.0)]
    return made, labels


def first_label(labels, customer, at, days):
    return min((t for _, c, t, _ in labels if c == customer and at <= t <= at + dt.timedelta(days=days)), default=None)


def test_label_stream_over_batches_and_restarts(spark, tmp_path):
    """Every prediction once, with its first label; half of the slices come after a restart."""
    made, labels = label_events()
    root = str(tmp_path / "job")
    made_schema = "request_id bigint, customer bigint, ts timestamp, prob double"
    label_schema = "label_id bigint, customer bigint, ts timestamp, label double"
    for low, high in ((0, 7), (7, 14), (14, 30)):
        def part(rows):
            return [r for r in rows if low <= (r[2] - START).days < high]
        streams = [write_slices(spark, str(tmp_path / name), [part(rows)], schema) for name, rows, schema in (
            ("made", made, made_schema), ("labels", labels, label_schema))]
        if low == 0:
            continue  # two slices in the first start, one micro-batch each
        out = stateful.label_stream(*streams, root, delay_days=2, parts=3).collect()
        came = [r for r in made if (r[2] - START).days < high]
        seen = [r for r in labels if (r[2] - START).days < high]
        assert sorted((r.request_id, r.customer or 0, r.ts, r.prob or 0.0, r.label_ts or START) for r in out) == sorted(
            (i, c or 0, at, p or 0.0, first_label(seen, c, at, 2) or START) for i, c, at, p in came)
    settled = stateful.settled_rows(spark, root).collect()
    assert 0 < len(settled) < len(made)
    newest = max(r[2] for r in made + labels) - dt.timedelta(days=1)
    for r in settled:
        assert (r.label_ts or r.ts + dt.timedelta(days=2)) < newest


def test_performance_stream_equals_batch(spark, tmp_path):
    made, labels = label_events()
    root = str(tmp_path / "job")
    schema = "request_id bigint, customer bigint, ts timestamp, prob double, label_ts timestamp, label double"
    rows = [(i, c, at, i % 10 / 10, None, 1.0 if first_label(labels, c, at, 2) else None) for i, c, at, _ in made]
    flags = None
    for low, high in ((0, 6), (6, 12), (12, 40)):
        stream = write_slices(spark, str(tmp_path / "settled"),
                              [[r for r in rows if low <= (r[2] - START).days < high]], schema)
        flags = stateful.performance_stream(stream, root, 0.4, 1, days=5)
    got = {r.day: r for r in flags.collect()}
    newest = max(r[2] for r in rows) - dt.timedelta(days=1)
    daily = spark.createDataFrame(rows, schema).fillna(0.0, ["label"]).groupBy(
        F.to_date("ts").alias("day")).agg(*metrics.confusion_columns(0.4))
    want = {r.day: r for r in requests.performance_drop(daily, days=5).collect()
            if dt.datetime.combine(r.day, dt.time()) + dt.timedelta(days=1) <= newest}
    assert set(got) == set(want) and len(got) > 10
    for day, r in want.items():
        assert got[day].f1 == pytest.approx(r.f1) and got[day].retrain == r.retrain
        assert got[day].baseline_f1 == (r.baseline_f1 if r.baseline_f1 is None else pytest.approx(r.baseline_f1))


def test_maintained_table_over_batches_restart_and_compaction(spark, tmp_path):
    schema = "k string, at timestamp, v double"
    path, root = str(tmp_path / "rows"), str(tmp_path / "job")
    parts = [[("a", START, 1.0), ("b", START, 2.0)], [("a", START + dt.timedelta(days=1), 3.0)]]
    stream = write_slices(spark, path, parts, schema)
    assert {r.k: r.v for r in jobs.maintain_latest(stream, "k", "at", root=root).collect()} == {"a": 3.0, "b": 2.0}
    jobs.compact(spark, root, stream.schema, "k")
    later = [[("a", START + dt.timedelta(hours=1), 9.0), ("c", START, 4.0)], [("b", START + dt.timedelta(days=2), 5.0)]]
    stream = write_slices(spark, path, later, schema)
    table = {r.k: r.v for r in jobs.maintain_latest(stream, "k", "at", root=root).collect()}
    assert table == {"a": 3.0, "b": 5.0, "c": 4.0}
    sizes = {r.batch: r.n for r in spark.read.parquet(f"{root}/changes").groupBy("batch").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {0: 2, 1: 1, 2: 2, 3: 1}  # only the keys of the batch, never the table


def test_score_stream_goes_on_after_a_restart(spark, customers, tmp_path):
    from lapsewatch.operators import quality
    root, path = str(tmp_path / "job"), str(tmp_path / "rows")

    def run(*changes):
        rows = quality.repair_total_charges(customers(*changes))
        rows.write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        return jobs.score_stream(stream, F.lit(0.7), 0.3, root)

    assert run({}, {"tenure": -1}).groupBy("status").count().count() == 2
    again = run({"tenure": 3}, {}, {})
    assert again.count() == 5 and again.where("status = 'scored'").count() == 4


def test_performance_drop_flags_a_bad_day(spark):
    days = [(START.date() + dt.timedelta(days=i), 80, 10, 10) for i in range(5)]
    days.append((START.date() + dt.timedelta(days=5), 10, 50, 50))
    table = requests.performance_drop(spark.createDataFrame(days, "day date, tp int, fp int, fn int"))
    flags = [r.retrain for r in table.orderBy("day").collect()]
    assert flags == [False] * 5 + [True]


def test_splits_are_nested_and_stable(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("customerID"))
    first = splitting.add_split(rows).groupBy("split").count().collect()
    shares = {r.split: r["count"] / 2000 for r in first}
    assert shares["train"] == pytest.approx(0.7, abs=0.05) and shares["test"] == pytest.approx(0.2, abs=0.05)
    assert splitting.add_fold(rows).groupBy("fold").count().count() == 5


def test_untreated_rows_of_a_stratum_without_treated_ones_stay(spark):
    rows = spark.createDataFrame(
        [("a", 0, 1), ("a", 0, 0), ("a", 1, 0), ("b", 0, 1)], "s string, treated int, label int")
    found = uplift.segment(uplift.stratum_effects(rows, ["s"])).orderBy("s").collect()
    assert [(r.s, r.base_churn_prob, r.cate) for r in found] == [
        ("a", 0.5, -0.5), ("a", 0.5, -0.5), ("b", 1.0, None)]
    assert found[2].uplift_segment == "Unknown"


@pytest.mark.parametrize("base, cate, name", [
    (0.5, -0.05, uplift.PERSUADABLE), (0.49, 0.0, uplift.SURE_THING), (0.5, 0.0, uplift.LOST_CAUSE),
    (0.49, 0.01, uplift.SLEEPING_DOG)])
def test_quadrants(spark, base, cate, name):
    assert spark.range(1).select(uplift.quadrant(F.lit(base), F.lit(cate)).alias("q")).first().q == name
