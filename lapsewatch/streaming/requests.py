"""Request metrics over event time; the same functions serve a table and a stream.

Every aggregate is combined per partition before its shuffle, so a hot endpoint is no hot task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lapsewatch import constants as K

# Histogram limits.
LATENCY_LIMITS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
PROBABILITY_LIMITS = tuple(i / 10 for i in range(11))


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into a Parquet table, and read the table.

    Checkpoint and table lie under ``path`` in the shared folder: running again with the same
    path goes on where the last run stopped.
    """
    spark = stream.sparkSession
    query: StreamingQuery = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def _windowed(log: DataFrame, lateness: str, size: str, *keys: str):
    return log.withWatermark("ts", lateness).groupBy(F.window("ts", size), *keys)


def _opened(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").alias("window_start"), *[
        c for c in df.columns if c != "window"])


def request_counts(log: DataFrame, lateness: str = "1 hour", size: str = "1 minute") -> DataFrame:
    """Requests per window and endpoint."""
    return _opened(_windowed(log, lateness, size, "endpoint").agg(
        F.count(F.lit(1)).alias("requests")))


def error_rates(log: DataFrame, lateness: str = "1 hour", size: str = "1 hour") -> DataFrame:
    errors = F.sum(F.col("is_error").cast("bigint"))
    return _opened(_windowed(log, lateness, size, "endpoint").agg(
        errors.alias("errors"), (errors / F.count(F.lit(1))).alias("error_rate")))


def _at_most(column: str, limits: Sequence[float]) -> list[Column]:
    return [F.count_if(F.col(column) <= F.lit(x)).alias(f"le_{x}".replace(".", "_"))
            for x in limits]


def latency_histogram(log: DataFrame, lateness: str = "1 hour", size: str = "1 day",
                      limits: Sequence[float] = LATENCY_LIMITS) -> DataFrame:
    """Cumulative counts at or below each limit, total count and sum, per window and endpoint."""
    return _opened(_windowed(log, lateness, size, "endpoint").agg(
        *_at_most("latency_s", limits), F.count(F.lit(1)).alias("le_inf"),
        F.sum("latency_s").alias("latency_sum")))


def probability_histogram(log: DataFrame, lateness: str = "1 hour", size: str = "1 day",
                          limits: Sequence[float] = PROBABILITY_LIMITS) -> DataFrame:
    return _opened(_windowed(log, lateness, size).agg(
        *_at_most("prob", limits), F.count(F.lit(1)).alias("le_inf")))


def rolling_prediction_drift(log: DataFrame, baseline: float | Column, days: int = K.MONITORING_DAYS,
                             lateness: str = "1 hour",
                             limit: float = K.PREDICTION_DRIFT_LIMIT) -> DataFrame:
    """Mean probability of sliding multi-day windows against a baseline mean.

    Days are summed first; only the daily sums are spread over the windows that hold them.
    """
    daily = log.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("day")).agg(
        F.sum("prob").alias("prob_sum"), F.count(F.lit(1)).alias("n"))
    sliding = daily.groupBy(F.window(F.window_time("day"), f"{days} days", "1 day")).agg(
        F.sum("prob_sum").alias("prob_sum"), F.sum("n").alias("requests"))
    mean = F.col("prob_sum") / F.col("requests")
    base = baseline if isinstance(baseline, Column) else F.lit(float(baseline))
    return sliding.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "requests", mean.alias("mean_prob"),
        F.coalesce(F.try_divide(F.abs(mean - base), base), F.lit(0.0)).alias("shift"),
    ).withColumn("alert", F.col("shift") > limit)


def performance_drop(daily: DataFrame, days: int = 30, limit: float = K.F1_DROP_LIMIT
                     ) -> DataFrame:
    """F1 per day against the mean F1 of the days before it; a larger drop asks for retraining.

    ``daily`` has ``day``, ``tp``, ``fp``, ``fn``: one row per day, so the window is short.
    """
    from pyspark.sql import Window

    from lapsewatch.functions.scalars import ratio
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = daily.withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
    before = Window.orderBy(F.unix_date("day")).rangeBetween(-days, -1)
    return scored.withColumn("baseline_f1", F.avg("f1").over(before)).withColumn(
        "retrain", F.coalesce(F.col("baseline_f1") - F.col("f1") > limit, F.lit(False)))


def window_slices(rows: DataFrame, at: str, reference_days: int = K.REFERENCE_DAYS,
                  current_days: int = K.MONITORING_DAYS) -> tuple[DataFrame, DataFrame]:
    """(reference, current): the last ``current_days`` before the newest row, and the
    ``reference_days`` before those."""
    newest = rows.agg(F.max(at)).scalar()
    current_from = newest - F.expr(f"INTERVAL {current_days} DAYS")
    reference_from = newest - F.expr(f"INTERVAL {current_days + reference_days} DAYS")
    return (
        rows.where((F.col(at) > reference_from) & (F.col(at) <= current_from)),
        rows.where(F.col(at) > current_from),
    )
