"""Split conformal prediction sets for a binary classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewatch import constants as K
from lapsewatch.functions.scalars import ratio
from lapsewatch.operators.ranking import order_statistics


def _name(confidence: float) -> str:
    return f"q{round(confidence * 100)}"


def nonconformity(label: str = "label", prob: str = "prob") -> Column:
    """1 minus the probability given to the true class."""
    return F.when(F.col(label) == 1, 1.0 - F.col(prob)).otherwise(F.col(prob))


def calibrate(df: DataFrame, confidences: Sequence[float] = K.CONFIDENCES) -> DataFrame:
    """(confidence, quantile): the ceil((n + 1) * confidence)-th smallest score.

    With too few rows for that rank the quantile is 1, which lets every class in. The rank is
    computed in thousandths, so 0.9 * (n + 1) cannot land a hair above a whole number.
    """
    scores = df.select(nonconformity().alias("score"))
    ranks = {
        _name(c): (lambda n, c=c: F.ceil((n + 1) * F.lit(round(c * 1000)) / F.lit(1000.0)))
        for c in confidences
    }
    wide = order_statistics(scores, "score", ranks)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("confidence"),
                 F.coalesce(F.col(_name(c)), F.lit(1.0)).alias("quantile"))
        for c in confidences])))


def prediction_sets(df: DataFrame, quantiles: DataFrame, prob: str = "prob") -> DataFrame:
    """One row per (input row, confidence): a class is in the set iff 1 - p(class) <= quantile.

    The quantile table has one row per confidence; it enters as a single scalar value.
    """
    levels = quantiles.agg(F.sort_array(F.collect_list(F.struct("confidence", "quantile"))))
    exploded = df.withColumn("_levels", levels.scalar()).select(
        *df.columns, F.inline("_levels"))
    return summarise(exploded, prob)


def summarise(df: DataFrame, prob: str = "prob") -> DataFrame:
    churn = (1.0 - F.col(prob)) <= F.col("quantile")
    stays = F.col(prob) <= F.col("quantile")
    size = churn.cast("int") + stays.cast("int")
    return df.withColumns({
        "includes_churn": churn, "includes_no_churn": stays,
        "is_uncertain": size == 2, "set_size": size,
    })


def coverage_report(sets: DataFrame) -> DataFrame:
    """Empirical coverage per confidence, its gap to the target, and the set sizes."""
    covered = F.when(F.col("label") == 1, F.col("includes_churn")).otherwise(
        F.col("includes_no_churn"))
    size = F.col("set_size")
    report = sets.groupBy("confidence").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(covered.cast("double")).alias("coverage"),
        F.avg(size.cast("double")).alias("mean_set_size"),
        F.count_if(size == 0).alias("empty_sets"),
        F.count_if(size == 1).alias("singletons"),
        F.count_if(size == 2).alias("ambiguous"))
    return report.withColumns({
        "coverage_gap": F.col("coverage") - F.col("confidence"),
        "singleton_rate": ratio(F.col("singletons"), F.col("n")),
    })


def save_quantiles(quantiles: DataFrame, path: str) -> str:
    quantiles.write.mode("errorifexists").parquet(path)
    return path
