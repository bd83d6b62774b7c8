"""Probability calibration: isotonic fit and before/after comparison."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewatch.operators import metrics


def compare_stages(df: DataFrame, before: str, after: str) -> DataFrame:
    """Calibration errors, Brier score and its parts of two probability columns, with deltas as
    after minus before: a negative delta of an error is an improvement."""
    two = df.select("label", F.inline(F.array(
        F.struct(F.lit("before").alias("stage"), F.col(before).alias("prob")),
        F.struct(F.lit("after").alias("stage"), F.col(after).alias("prob")))))
    errors = metrics.calibration_errors(metrics.calibration_bins(two, ["stage"]), ["stage"])
    scores = two.groupBy("stage").agg(metrics.brier().alias("brier"))
    both = errors.join(scores, "stage")
    wide = both.agg(*[
        F.max(F.when(F.col("stage") == s, F.col(m))).alias(f"{m}_{s}")
        for m in ("ece", "mce", "brier", "reliability", "resolution") for s in ("before", "after")])
    return wide.withColumns({
        f"{m}_delta": F.col(f"{m}_after") - F.col(f"{m}_before") for m in ("ece", "mce", "brier")})


def fit_isotonic(validation: DataFrame, prob: str = "prob") -> IsotonicRegressionModel:
    """Monotone map from raw probability to observed rate.

    Rows of equal probability are combined first, with their count as weight; the fit pools
    neighbours within its partitions before its last step.
    """
    cells = validation.groupBy(prob).agg(
        F.avg(F.col("label").cast("double")).alias("label"),
        F.count(F.lit(1)).cast("double").alias("weight"))
    return IsotonicRegression(
        featuresCol=prob, labelCol="label", weightCol="weight").fit(cells)


def apply_isotonic(df: DataFrame, model: IsotonicRegressionModel, prob: str = "prob",
                   output: str = "calibrated") -> DataFrame:
    fitted = model.copy()
    fitted.setFeaturesCol(prob)
    fitted.setPredictionCol(output)
    return fitted.transform(df).withColumn(
        output, F.least(F.greatest(F.col(output), F.lit(0.0)), F.lit(1.0)))
