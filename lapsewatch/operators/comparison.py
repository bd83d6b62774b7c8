"""Statistical comparison of models from their fold scores (models x folds rows, always few)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewatch.functions.tails import student_critical, t_p_value


def effect_size(mean: Column, deviation: Column) -> Column:
    """Paired Cohen's d; 0 without any spread."""
    return F.when(deviation == 0, 0.0).otherwise(F.try_divide(mean, deviation))


def effect_band(d: Column) -> Column:
    size = F.abs(d)
    return (
        F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium")
        .otherwise("large")
    )


def paired(scores: DataFrame, model: str = "model", fold: str = "fold",
           score: str = "score") -> DataFrame:
    """All model pairs (name order) with their per-fold difference, matched on the fold."""
    left = scores.select(F.col(model).alias("model_a"), fold, F.col(score).alias("score_a"))
    right = scores.select(F.col(model).alias("model_b"), fold, F.col(score).alias("score_b"))
    return left.join(right, fold).where("model_a < model_b").withColumn(
        "diff", F.col("score_a") - F.col("score_b"))


def corrected_t_test(pairs: DataFrame, test_over_train: float, folds: int,
                     alpha: float = 0.05) -> DataFrame:
    """Resampled t-test with the variance raised for overlapping training sets.

    ``test_over_train`` is the ratio of test to training rows in a fold. With identical scores in
    all folds the standard error is taken as 1e-10.
    """
    variance = F.col("var_diff") * F.lit(1.0 / folds + test_over_train)
    error = F.when(variance > 0, F.sqrt(variance)).otherwise(F.lit(1e-10))
    reach = F.lit(student_critical(alpha, folds - 1)) * F.col("error")
    return (
        pairs.groupBy("model_a", "model_b").agg(
            F.avg("score_a").alias("mean_a"), F.avg("score_b").alias("mean_b"),
            F.avg("diff").alias("mean_diff"), F.var_samp("diff").alias("var_diff"),
            F.stddev_samp("diff").alias("std_diff"))
        .withColumn("error", error)
        .withColumns({
            "t_statistic": F.col("mean_diff") / F.col("error"),
            "ci_lower": F.col("mean_diff") - reach,
            "ci_upper": F.col("mean_diff") + reach,
            "cohens_d": effect_size(F.col("mean_diff"), F.col("std_diff")),
        })
        .withColumn("p_value", t_p_value("t_statistic", F.lit(float(folds - 1))))
        .withColumns({
            "is_significant": F.col("p_value") < alpha,
            "effect": effect_band(F.col("cohens_d")),
        })
        .drop("var_diff", "std_diff", "error")
    )


def all_pairs(scores: DataFrame, test_over_train: float, folds: int, models: int,
              alpha: float = 0.05) -> DataFrame:
    """Every pair tested at the Bonferroni level alpha / number of pairs."""
    pairs = models * (models - 1) // 2
    level = alpha / pairs if pairs else alpha
    return corrected_t_test(paired(scores), test_over_train, folds, level).withColumn(
        "bonferroni_alpha", F.lit(round(level, 6)))
