"""Group fairness: per-group metrics, demographic parity, equalised odds, overall audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewatch import constants as K
from lapsewatch.functions.scalars import tall
from lapsewatch.operators import metrics

KEYS = ["attribute", "group"]
SENSITIVE = ["gender", "SeniorCitizen"]


def by_attribute(df: DataFrame, attributes: Sequence[str], threshold: float) -> DataFrame:
    """One row per (customer, sensitive attribute), with the 0/1 decision at ``threshold``."""
    return df.select(
        "label", "prob", (F.col("prob") >= F.lit(threshold)).cast("int").alias("flagged"),
        tall(attributes, "attribute", "group", "string"))


def _mean(column: str, where: Column | None = None) -> Column:
    value = F.col(column).cast("double")
    return F.avg(F.when(where, value) if where is not None else value)


def group_metrics(df: DataFrame, attributes: Sequence[str], threshold: float) -> DataFrame:
    """Rows, rates, precision, recall, F1, ROC-AUC (NaN for one class) and ECE per group."""
    rows = by_attribute(df, attributes, threshold)
    counts = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_samples"),
        _mean("label").alias("base_rate"), _mean("flagged").alias("positive_rate"),
        *metrics.confusion_columns(threshold),
    ).withColumns(metrics.precision_recall_f1()).drop("tp", "fp", "fn", "tn")
    ranks = metrics.ranking_scores(rows, KEYS).select(*KEYS, "roc_auc")
    errors = metrics.calibration_errors(metrics.calibration_bins(rows, KEYS), KEYS)
    joined = counts.join(ranks, KEYS).join(errors.select(*KEYS, "ece"), KEYS)
    return joined.select(
        *KEYS, "n_samples", F.round("ece", 6).alias("ece"),
        *[F.round(c, 4).alias(c) for c in
          ("base_rate", "positive_rate", "precision", "recall", "f1", "roc_auc")])


def demographic_parity(df: DataFrame, attributes: Sequence[str], threshold: float) -> DataFrame:
    """Lowest over highest positive rate per attribute; rates are rounded before dividing.

    Without any positive the ratio is 0 and the check fails.
    """
    rates = by_attribute(df, attributes, threshold).groupBy(*KEYS).agg(
        F.round(_mean("flagged"), 4).alias("rate"))
    ends = rates.groupBy("attribute").agg(
        F.min(F.struct("rate", "group")).alias("low"),
        # The first group in sorted order among equally high ones.
        F.min(F.struct((-F.col("rate")).alias("neg"), F.col("group"))).alias("high"))
    high, low = -F.col("high.neg"), F.col("low.rate")
    ratio = F.coalesce(F.round(F.try_divide(low, high), 4), F.lit(0.0))
    some = high > 0
    return ends.select(
        "attribute", ratio.alias("parity_ratio"),
        (ratio >= K.PARITY_LIMIT).alias("passes"),
        F.when(some, F.col("low.group")).otherwise("N/A").alias("min_rate_group"),
        F.when(some, F.col("high.group")).otherwise("N/A").alias("max_rate_group"))


def equalised_odds(df: DataFrame, attributes: Sequence[str], threshold: float,
                   limit: float = K.ODDS_LIMIT) -> DataFrame:
    """Spread of true- and false-positive rates across groups; a missing class is ignored."""
    rates = by_attribute(df, attributes, threshold).groupBy(*KEYS).agg(
        F.round(_mean("flagged", F.col("label") == 1), 4).alias("tpr"),
        F.round(_mean("flagged", F.col("label") == 0), 4).alias("fpr"))
    def spread(c):
        return F.coalesce(F.round(F.max(c) - F.min(c), 4), F.lit(0.0))
    return rates.groupBy("attribute").agg(
        spread("tpr").alias("tpr_disparity"), spread("fpr").alias("fpr_disparity"),
    ).withColumn("satisfies", (F.col("tpr_disparity") < limit) & (F.col("fpr_disparity") < limit))


def audit(df: DataFrame, attributes: Sequence[str], threshold: float) -> DataFrame:
    """Both checks per attribute and one overall verdict: fair when every check passes."""
    both = demographic_parity(df, attributes, threshold).join(
        equalised_odds(df, attributes, threshold), "attribute")
    verdict = both.agg(F.bool_and(F.col("passes") & F.col("satisfies"))).scalar()
    return both.select(
        "attribute", "parity_ratio", F.col("passes").alias("parity_passes"), "tpr_disparity",
        "fpr_disparity", F.col("satisfies").alias("odds_pass"), verdict.alias("overall_fair"))
