"""Exact binary-classification metrics over (label, prob) columns, optionally per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewatch import constants as K
from lapsewatch.functions.scalars import bin_of, ratio, step_of
from lapsewatch.operators.ranking import running_totals

STEPS = 100  # thresholds 0.01 .. 0.99


def confusion_columns(threshold: float | Column, label: str = "label",
                      prob: str = "prob") -> list[Column]:
    """The four counts as aggregates; a row is flagged when prob >= threshold."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    flagged, positive = F.col(prob) >= cut, F.col(label) == 1
    return [
        F.count_if(flagged & positive).alias("tp"),
        F.count_if(flagged & ~positive).alias("fp"),
        F.count_if(~flagged & positive).alias("fn"),
        F.count_if(~flagged & ~positive).alias("tn"),
    ]


def confusion(df: DataFrame, threshold: float | Column, by: Sequence[str] = (),
              label: str = "label", prob: str = "prob") -> DataFrame:
    return df.groupBy(*by).agg(*confusion_columns(threshold, label, prob))


def precision_recall_f1() -> dict[str, Column]:
    """Precision, recall and F1 from confusion counts; every zero division gives 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    }


def cost_columns(miss: float = K.FALSE_NEGATIVE_COST,
                 alarm: float = K.FALSE_POSITIVE_COST) -> dict[str, Column]:
    """Money lost to misses and false alarms, against the baseline of missing every churner."""
    missed, alarmed = F.col("fn") * F.lit(miss), F.col("fp") * F.lit(alarm)
    baseline = (F.col("tp") + F.col("fn")) * F.lit(miss)
    return {
        "fn_cost": missed,
        "fp_cost": alarmed,
        "total_cost": missed + alarmed,
        "baseline_cost": baseline,
        "savings": baseline - missed - alarmed,
    }


def cumulative(df: DataFrame, by: Sequence[str] = (), label: str = "label",
               prob: str = "prob", weight: str | None = None) -> DataFrame:
    """Per distinct probability: rows and positives here, and at or above it.

    ``weight`` names a column of row counts when the input is already combined.
    """
    rows = F.col(weight) if weight else F.lit(1).cast("bigint")
    ranked = running_totals(
        df, prob, {"n": F.sum(rows), "pos": F.sum(F.col(label).cast("bigint") * rows)}, by)
    return ranked.select(
        *by, prob, "n", "pos", "n_all", "pos_all",
        (F.col("n_all") - F.col("n_upto") + F.col("n")).alias("n_from"),
        (F.col("pos_all") - F.col("pos_upto") + F.col("pos")).alias("pos_from"),
    )


def ranking_scores(df: DataFrame, by: Sequence[str] = (), label: str = "label",
                   prob: str = "prob", weight: str | None = None) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (step sum), one row per group.

    Both are NaN when a class is missing for ROC-AUC, and 0 for average precision without
    positives.
    """
    table = cumulative(df, by, label, prob, weight)
    pos, neg = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    above = (F.col("pos_from") - F.col("pos")).cast("double")
    gains = pos * F.col("pos_from").cast("double") / F.col("n_from").cast("double")
    sums = table.groupBy(*by).agg(
        F.sum(neg * (above + pos / 2.0)).alias("pairs"),
        F.sum(gains).alias("gains"),
        F.max("pos_all").cast("double").alias("p"),
        (F.max("n_all") - F.max("pos_all")).cast("double").alias("q"),
        F.max("n_all").alias("rows"),
    )
    return sums.select(
        *by, "rows",
        F.coalesce(F.try_divide("pairs", F.col("p") * F.col("q")), F.lit(float("nan")))
        .alias("roc_auc"),
        ratio(F.col("gains"), F.col("p")).alias("average_precision"),
    )


def curve_points(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC and precision-recall points, one per distinct probability used as threshold."""
    negatives = F.col("n_all") - F.col("pos_all")
    return cumulative(df, by).select(
        *by, F.col("prob").alias("threshold"),
        ratio(F.col("n_from") - F.col("pos_from"), negatives).alias("fpr"),
        ratio(F.col("pos_from"), F.col("pos_all")).alias("tpr"),
        ratio(F.col("pos_from"), F.col("n_from")).alias("precision"),
    )


def threshold_sweep(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics and cost at the thresholds 0.01 .. 0.99, from one pass over the rows.

    Each row falls into the highest threshold it reaches; counts at a threshold are then suffix
    sums over at most 101 slots per group.
    """
    by = list(by)
    slots = df.groupBy(*by, step_of(F.col("prob"), STEPS).alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("pos"))
    # Every slot must be present; zero rows fill the ones no probability reaches.
    groups = slots.groupBy(*by).agg(F.max("slot").alias("_top"))
    grid = groups.select(
        *by, F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("slot"),
        F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("pos"))
    filled = slots.select(*by, "slot", "n", "pos").unionByName(grid).groupBy(*by, "slot").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    from_here = (
        Window.partitionBy(*by).orderBy(F.desc("slot"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    whole = Window.partitionBy(*by)
    counted = filled.select(
        *by, "slot",
        F.sum("pos").over(from_here).alias("tp"),
        (F.sum("n").over(from_here) - F.sum("pos").over(from_here)).alias("fp"),
        F.sum("pos").over(whole).alias("_p"), F.sum("n").over(whole).alias("_n"),
    ).where(F.col("slot").between(1, STEPS - 1))
    return (
        counted.withColumns({
            "threshold": F.col("slot").cast("double") / F.lit(float(STEPS)),
            "fn": F.col("_p") - F.col("tp"),
            "tn": F.col("_n") - F.col("_p") - F.col("fp"),
        })
        .withColumns(precision_recall_f1())
        .withColumns(cost_columns())
        .drop("slot", "_p", "_n")
    )


def cost_optimal(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cheapest threshold; of equally cheap ones the lowest."""
    best = F.min(F.struct("total_cost", "threshold"))
    return sweep.groupBy(*by).agg(best.alias("best")).select(
        *by, F.round("best.threshold", 2).alias("threshold"),
        F.col("best.total_cost").alias("total_cost"))


def f1_optimal(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold of the best F1; ties go to the lowest, and 0.5 when every F1 is 0."""
    best = F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("lowest")))
    picked = sweep.groupBy(*by).agg(best.alias("best"))
    return picked.select(
        *by,
        F.when(F.col("best.f1") > 0, F.round(-F.col("best.lowest"), 2)).otherwise(F.lit(0.5))
        .alias("threshold"),
        F.col("best.f1").alias("f1"))


def risk_tier(prob: Column, high: float = K.HIGH_RISK, medium: float = K.MEDIUM_RISK) -> Column:
    return F.when(prob >= high, "HIGH").when(prob >= medium, "MEDIUM").otherwise("LOW")


def calibration_bins(df: DataFrame, by: Sequence[str] = (), bins: int = 10,
                     label: str = "label", prob: str = "prob") -> DataFrame:
    """Rows, observed rate and mean probability per equal-width bin; empty bins are absent."""
    binned = df.groupBy(*by, bin_of(F.col(prob), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(F.col(label).cast("double")).alias("accuracy"),
        F.avg(prob).alias("confidence"),
        F.sum(F.col(label).cast("bigint")).alias("pos"),
    )
    return binned.withColumns({
        "lower": F.col("bin").cast("double") / F.lit(float(bins)),
        "upper": (F.col("bin") + 1).cast("double") / F.lit(float(bins)),
    })


def calibration_errors(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Expected and maximum calibration error and the Brier parts, from the bins alone."""
    weight, gap = F.col("count").cast("double"), F.abs(F.col("accuracy") - F.col("confidence"))
    totals = Window.partitionBy(*by)
    rated = bins.withColumns({
        "_rows": F.sum("count").over(totals),
        "_base": F.sum("pos").over(totals).cast("double") / F.sum("count").over(totals),
    })
    share = weight / F.col("_rows")
    return rated.groupBy(*by).agg(
        F.sum(share * gap).alias("ece"),
        F.max(gap).alias("mce"),
        F.sum(share * F.pow(F.col("confidence") - F.col("accuracy"), F.lit(2.0)))
        .alias("reliability"),
        F.sum(share * F.pow(F.col("accuracy") - F.col("_base"), F.lit(2.0))).alias("resolution"),
        (F.max("_base") * (1.0 - F.max("_base"))).alias("uncertainty"),
        F.max("_base").alias("base_rate"),
    )


def brier(label: str = "label", prob: str = "prob") -> Column:
    return F.avg(F.pow(F.col(prob) - F.col(label).cast("double"), F.lit(2.0)))


def flat_metrics(df: DataFrame, threshold: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: ranking scores, threshold metrics, costs and counts."""
    by = list(by)
    at_cut = confusion(df, threshold, by).withColumns({**precision_recall_f1(), **cost_columns()})
    ranks = ranking_scores(df, by)
    if by:
        return at_cut.join(ranks, by)
    both = ranks.agg(F.max(F.struct("rows", "roc_auc", "average_precision"))).scalar()
    return at_cut.withColumn("_r", both).select("*", "_r.*").drop("_r")


def passes_gates(roc: float = K.MIN_ROC_AUC, pr: float = K.MIN_PR_AUC,
                 recall: float = K.MIN_RECALL, precision: float | None = None) -> Column:
    """The release gates; ``precision`` adds the guard used for choosing a champion."""
    gate = (F.col("roc_auc") >= roc) & (F.col("average_precision") >= pr) \
        & (F.col("recall") >= recall)
    return gate & (F.col("precision") >= precision) if precision is not None else gate


def what_if(segments: DataFrame, recall: float, precision: float,
            miss: float = K.FALSE_NEGATIVE_COST, alarm: float = K.FALSE_POSITIVE_COST
            ) -> DataFrame:
    """Return on a retention programme per segment (``population``, ``churn_rate``).

    Counts are truncated to whole customers at each step.
    """
    def whole(c: Column) -> Column:
        return F.floor(c).cast("bigint")

    churners = whole(F.col("population") * F.col("churn_rate"))
    costs = segments.withColumn("churners", churners).withColumn(
        "true_positives", whole(F.col("churners") * F.lit(recall))
    ).withColumns({
        "false_negatives": F.col("churners") - F.col("true_positives"),
        "false_positives": (whole(F.col("true_positives") * F.lit(1.0 / precision - 1.0))
                            if precision > 0 else F.lit(0).cast("bigint")),
    })
    model_cost = F.col("false_negatives") * F.lit(miss) + F.col("false_positives") * F.lit(alarm)
    return costs.withColumns({
        "baseline_cost": F.col("churners") * F.lit(miss), "model_cost": model_cost,
    }).withColumns({
        "savings": F.col("baseline_cost") - F.col("model_cost"),
        "roi_percent": ratio((F.col("baseline_cost") - F.col("model_cost")) * 100.0,
                             F.col("model_cost")),
    })
