"""Model leaderboards from scored rows: cross-validation tables, tuning lift, champion choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsewatch import constants as K
from lapsewatch.operators import metrics


def fold_scores(rows: DataFrame, by: Sequence[str] = ("model",), fold: str = "fold") -> DataFrame:
    """ROC-AUC and average precision per (model, fold) of out-of-fold predictions."""
    return metrics.ranking_scores(rows, [*by, fold])


def cv_summary(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and population deviation of both scores over the folds."""
    return scores.groupBy(*by).agg(
        F.avg("average_precision").alias("cv_pr_auc_mean"),
        F.stddev_pop("average_precision").alias("cv_pr_auc_std"),
        F.avg("roc_auc").alias("cv_roc_auc_mean"),
        F.stddev_pop("roc_auc").alias("cv_roc_auc_std"),
        F.count(F.lit(1)).alias("folds"))


def top_candidates(scan: DataFrame, n: int = 5, exclude: Sequence[str] = ("Dummy",)) -> DataFrame:
    """The best models of a scan, never a dummy."""
    return scan.where(~F.col("model").isin(list(exclude))).orderBy(
        F.desc("cv_pr_auc_mean"), "model").limit(n)


def tuning_lift(scan: DataFrame, tuned: DataFrame, n: int = 5) -> DataFrame:
    """Tuned minus scanned score (4 dp) for the candidates that were tuned."""
    return top_candidates(scan, n).select(
        "model", F.col("cv_pr_auc_mean").alias("scan_cv_pr_auc")).join(
        tuned.select("model", F.col("cv_pr_auc_mean").alias("tuned_cv_pr_auc")), "model"
    ).withColumn("lift", F.round(F.col("tuned_cv_pr_auc") - F.col("scan_cv_pr_auc"), 4)).orderBy(
        F.desc("tuned_cv_pr_auc"), "model")


def running_best(trials: DataFrame, study: str = "study", trial: str = "trial",
                 value: str = "value") -> DataFrame:
    """Best value up to and including each trial of its study."""
    upto = Window.partitionBy(study).orderBy(trial).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return trials.withColumn("running_best", F.max(value).over(upto))


def final_results(rows: DataFrame, by: str = "model") -> DataFrame:
    """Per model: ranking scores and the metrics at its own cost-optimal threshold."""
    sweep = metrics.threshold_sweep(rows, [by])
    cheapest = F.min_by(F.struct("threshold", "precision", "recall", "f1", "savings"),
                        F.struct("total_cost", "threshold"))
    at_best = sweep.groupBy(by).agg(cheapest.alias("best")).select(by, "best.*")
    return at_best.join(metrics.ranking_scores(rows, [by]), by).withColumnRenamed(
        "average_precision", "pr_auc")


def with_gates(final: DataFrame, roc: float = K.MIN_ROC_AUC, pr: float = K.MIN_PR_AUC,
               recall: float = K.MIN_RECALL, precision: float = K.MIN_PRECISION) -> DataFrame:
    passed = (F.col("roc_auc") >= roc) & (F.col("pr_auc") >= pr) & (F.col("recall") >= recall) \
        & (F.col("precision") >= precision)
    return final.withColumn("passes_gates", passed)


def champion(final: DataFrame) -> DataFrame:
    """The best model that passes the gates; when none does, the best of all.

    Passing models rank by tuned score, test score, savings; the fallback ignores savings. Needs
    ``cv_pr_auc_mean``, ``pr_auc``, ``savings`` and ``passes_gates``.
    """
    order = Window.orderBy(
        F.desc("passes_gates"), F.desc("cv_pr_auc_mean"), F.desc("pr_auc"),
        F.desc(F.when(F.col("passes_gates"), F.col("savings"))), "model")
    return final.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def final_summary(scan: DataFrame, final: DataFrame) -> DataFrame:
    """Every evaluated model with its scan score (null when never scanned) and the lift (4 dp)."""
    merged = scan.select("model", F.col("cv_pr_auc_mean").alias("scan_cv_pr_auc")).join(
        final, "model", "right")
    return merged.withColumn("pr_auc_lift", F.round(
        F.col("cv_pr_auc_mean") - F.col("scan_cv_pr_auc"), 4)).orderBy(F.desc("pr_auc"), "model")


def generalisation_gap(final: DataFrame) -> DataFrame:
    return final.select("model", "cv_pr_auc_mean", "pr_auc",
                        (F.col("cv_pr_auc_mean") - F.col("pr_auc")).alias("gap"))


def business_ranking(final: DataFrame) -> DataFrame:
    return final.select("model", "threshold", "savings").orderBy(F.desc("savings"), "model")
