"""Streams whose state Spark keeps: delayed labels and the rolling retrain flag.

Both are keyed processors on Spark's state store, with event-time watermarks and timers, so state
survives a restart and leaves with event time. A job is named by its ``root``: checkpoint and
output lie under it, and a later call with the same root goes on where the last one ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lapsewatch import constants as K
from lapsewatch.functions.scalars import ratio
from lapsewatch.operators import metrics

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Timers are rounded up to this many milliseconds, so a key has few of them.
GRAIN_MS = 3_600_000


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Keyed processors need the store with column families; the session's own choice returns after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class LabelMatcher(StatefulProcessor):
    """Open predictions of one (customer, part), and the labels that new ones may still need.

    Times are microseconds. A prediction is settled once event time has passed its label window or
    its first label: nothing earlier can arrive any more.
    """

    def __init__(self, delay_us: int):
        self.delay = delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState(
            "pending", "at bigint, id bigint, prob double",
            "copies int, label_at bigint, label_id bigint, label double")
        self.labels = handle.getListState("labels", "at bigint, id bigint, label double")

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        made, came = [], []
        for r in rows:
            (came if r.is_label else made).append(r)
        new = [(r.at, r.id, r.value) for r in came]
        held = [tuple(x) for x in self.labels.get()] if self.labels.exists() else []
        known = [x for x in held if x[0] >= passed] + new
        if new or len(known) < len(held):
            self.labels.put(known) if known else self.labels.clear()
        due = {x[0] for x in new}
        changed = {}
        if new:
            for at, value in self.pending.iterator():
                best = self.first(tuple(at)[0], new, tuple(value)[1:])
                if best != tuple(value)[1:]:
                    changed[tuple(at)] = (tuple(value)[0], *best)
        for r in made:
            at = (r.at, r.id, r.value)
            if at in changed:
                changed[at] = (changed[at][0] + 1, *changed[at][1:])
            elif self.pending.containsKey(at):
                value = tuple(self.pending.getValue(at))
                changed[at] = (value[0] + 1, *value[1:])
            else:
                changed[at] = (1, *self.first(r.at, known, (None, None, None)))
        for at, value in changed.items():
            self.pending.updateValue(at, value)
            due.add(self.due(at, value))
        for when in {-(-(us // 1000 + 1) // GRAIN_MS) * GRAIN_MS for us in due}:
            self.handle.registerTimer(when)
        return iter(())

    def first(self, at: int, labels: list[tuple], best: tuple) -> tuple:
        """The first label within the window; of several at one time the one with the largest id."""
        for when, id_, label in labels:
            if at <= when <= at + self.delay and (
                    best[0] is None or (when, -id_) < (best[0], -best[1])):
                best = (when, id_, label)
        return best

    def due(self, at: tuple, value: tuple) -> int:
        return at[0] + self.delay if value[1] is None else value[1]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        done = [(tuple(at), tuple(value)) for at, value in self.pending.iterator()]
        done = [(at, value) for at, value in done if self.due(at, value) < passed]
        for at, value in done:
            self.pending.removeKey(at)
            for _ in range(value[0]):
                yield Row(request_id=at[1], key=key[0], at=at[0], prob=at[2], label_at=value[1], label=value[3])
        held = [tuple(x) for x in self.labels.get()] if self.labels.exists() else []
        kept = [x for x in held if x[0] >= passed]
        if len(kept) < len(held):
            self.labels.put(kept) if kept else self.labels.clear()

    def close(self) -> None:
        pass


SETTLED = "request_id bigint, key bigint, at bigint, prob double, label_at bigint, label double"


def _named(rows: DataFrame, key: str) -> DataFrame:
    return rows.select("request_id", F.col("key").alias(key), F.timestamp_micros("at").alias("ts"), "prob",
                       F.timestamp_micros("label_at").alias("label_ts"), "label")


def settle_labels(predictions: DataFrame, labels: DataFrame, root: str, key: str = "customer",
                  delay_days: float = K.LABEL_DELAY_DAYS, lateness_days: float = 1.0, parts: int = 8) -> None:
    """Run the label stream over what is there: settled predictions go to the table at ``root``.

    ``predictions`` has request_id, key, ts, prob; ``labels`` has label_id, key, ts, label. The
    predictions of a key are dealt over ``parts`` states, each of which gets the key's labels, so
    a busy key has no single task and no pairs are formed. Rows behind event time (newest row
    seen, less the lateness) are dropped. Rows without a time match nothing and are left out.
    """
    spark = predictions.sparkSession

    def rows(df: DataFrame, id_: str, value: str, is_label: bool, part) -> DataFrame:
        return df.where("ts IS NOT NULL").select(
            F.col(key).cast("bigint").alias("key"), part.alias("part"), "ts", F.unix_micros("ts").alias("at"),
            F.col(id_).cast("bigint").alias("id"), F.col(value).cast("double").alias("value"),
            F.lit(is_label).alias("is_label"))

    made = rows(predictions, "request_id", "prob", False, F.pmod(F.xxhash64("request_id"), F.lit(parts)).cast("int"))
    came = rows(labels, "label_id", "label", True, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    stream = made.unionByName(came).withWatermark("ts", f"{round(lateness_days * 86400)} seconds")
    settled = stream.groupBy("key", "part").transformWithState(
        LabelMatcher(round(delay_days * 86400) * 1_000_000), SETTLED, "append", "EventTime")
    with keyed_state(spark):
        settled.writeStream.format("parquet").option("path", f"{root}/settled").option(
            "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def settled_rows(spark: SparkSession, root: str, key: str = "customer", stream: bool = False) -> DataFrame:
    """Predictions whose label is final, as a table or as a stream for further jobs."""
    reader = (spark.readStream if stream else spark.read).schema(SETTLED)
    return _named(reader.parquet(f"{root}/settled"), key)


def open_rows(spark: SparkSession, root: str, key: str = "customer") -> DataFrame:
    """Predictions that Spark's state still holds, each with its first label so far."""
    state = spark.read.format("statestore").option("path", f"{root}/checkpoint").option(
        "stateVarName", "pending").load()
    return _named(state.select(
        F.col("user_map_key.id").alias("request_id"), F.col("key.key").alias("key"), "user_map_key.at",
        "user_map_key.prob", "user_map_value.label_at", "user_map_value.label",
        F.explode(F.sequence(F.lit(1), F.col("user_map_value.copies")))), key)


def label_stream(predictions: DataFrame, labels: DataFrame, root: str, key: str = "customer",
                 delay_days: float = K.LABEL_DELAY_DAYS, lateness_days: float = 1.0, parts: int = 8) -> DataFrame:
    """Every prediction so far with its first label within the delay: settled ones and open ones."""
    spark = predictions.sparkSession
    settle_labels(predictions, labels, root, key, delay_days, lateness_days, parts)
    return settled_rows(spark, root, key).unionByName(open_rows(spark, root, key))


class RollingBaseline(StatefulProcessor):
    """F1 of the last days of one series; every closed day is held against the days before it."""

    def __init__(self, days: int, limit: float):
        self.days, self.limit = days, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "day int", "f1 double")

    def handleInputRows(self, key, rows, timerValues):
        seen = {tuple(d)[0]: tuple(v)[0] for d, v in self.seen.iterator()}
        # Days close in the order of event time: none before these can follow.
        for r in sorted(rows, key=lambda r: r.day):
            before = [seen[d] for d in sorted(seen) if r.day - self.days <= d < r.day and seen[d] is not None]
            base = sum(before) / len(before) if before else None
            flag = base is not None and r.f1 is not None and base - r.f1 > self.limit
            seen[r.day] = r.f1
            self.seen.updateValue((r.day,), (r.f1,))
            yield Row(series=key[0], day=r.day, f1=r.f1, baseline_f1=base, retrain=flag)
        for day in seen:
            if day < max(seen) - self.days:
                self.seen.removeKey((day,))

    def close(self) -> None:
        pass


def performance_stream(settled: DataFrame, root: str, threshold: float, lateness_days: float,
                       days: int = 30, limit: float = K.F1_DROP_LIMIT, series: str | None = None) -> DataFrame:
    """A flag per closed day: F1 against the mean F1 of the ``days`` before it.

    Rows are counted per day before they meet; the state holds one number per day and series. A
    day is closed once event time, the newest prediction less ``lateness_days``, has passed its
    end; the lateness must cover the label delay, as predictions settle up to that late. A
    prediction without a label counts as not lapsed.
    """
    spark = settled.sparkSession
    rows = settled.withColumns({
        "label": F.coalesce("label", F.lit(0.0)), "series": F.col(series) if series else F.lit("all")})
    counts = rows.withWatermark("ts", f"{round(lateness_days * 86400)} seconds").groupBy(
        F.window("ts", "1 day"), "series").agg(*metrics.confusion_columns(threshold))
    daily = counts.select("series", F.unix_date(F.to_date("window.start")).alias("day"),
                          ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
    flags = daily.groupBy("series").transformWithState(
        RollingBaseline(days, limit), "series string, day int, f1 double, baseline_f1 double, retrain boolean",
        "append", "None")
    with keyed_state(spark):
        flags.writeStream.format("parquet").option("path", f"{root}/flags").option(
            "checkpointLocation", f"{root}/flag-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(flags.schema).parquet(f"{root}/flags").withColumn("day", F.date_from_unix_date("day"))
