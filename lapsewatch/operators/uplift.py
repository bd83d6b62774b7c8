"""Treatment effect on churn: eligible rows, two-model effects, quadrants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewatch.operators.smalltables import join_small
from lapsewatch.operators.training import fit

# Names of the four quadrants.
PERSUADABLE = "Persuadable (Target)"
SURE_THING = "Sure Thing (Ignore)"
LOST_CAUSE = "Lost Cause (Ignore)"
SLEEPING_DOG = "Sleeping Dog (Do Not Disturb)"


def eligible(df: DataFrame, treatment: str = "TechSupport") -> DataFrame:
    """Internet customers with a 0/1 ``treated`` column; the treatment itself is no covariate."""
    return (
        df.where(F.col("InternetService") != "No")
        .withColumn("treated", (F.col(treatment) == "Yes").cast("int"))
        .drop(treatment)
    )


def fit_two_models(df: DataFrame, pipeline: Pipeline) -> tuple[PipelineModel, PipelineModel]:
    """One fit per arm: (model of the untreated, model of the treated)."""
    return tuple(fit(pipeline, df.where(F.col("treated") == arm)) for arm in (0, 1))


def effects(df: DataFrame, control: PipelineModel, treated: PipelineModel) -> DataFrame:
    """Churn probability without treatment and the change under treatment, untreated rows only."""
    kept = df.columns

    def score(rows: DataFrame, model: PipelineModel, name: str) -> DataFrame:
        scored = model.transform(rows)
        return scored.withColumn(name, vector_to_array("probability")[1]).select(
            *rows.columns, name)

    untreated = df.where(F.col("treated") == 0).select(*kept)
    both = score(score(untreated, control, "base_churn_prob"), treated, "_with")
    return both.withColumn("cate", F.col("_with") - F.col("base_churn_prob")).drop("_with")


def stratum_effects(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Two-model effects where each model is the churn rate of the row's stratum and arm.

    Every untreated row stays; one whose stratum has no treated rows has no estimate, and so the
    quadrant "Unknown".
    """
    label = F.col("label").cast("double")
    rates = df.groupBy(*strata).agg(
        F.avg(F.when(F.col("treated") == 0, label)).alias("base_churn_prob"),
        F.avg(F.when(F.col("treated") == 1, label)).alias("_with"),
    )
    untreated = join_small(df.where(F.col("treated") == 0), rates, list(strata), "left")
    return untreated.withColumn(
        "cate", F.col("_with") - F.col("base_churn_prob")).drop("_with")


def quadrant(base: Column, cate: Column) -> Column:
    likely = base >= 0.5
    return (
        F.when(likely & (cate <= -0.05), PERSUADABLE)
        .when(~likely & (cate <= 0.0), SURE_THING)
        .when(likely & (cate > -0.05), LOST_CAUSE)
        .when(~likely & (cate > 0.0), SLEEPING_DOG)
        .otherwise("Unknown")
    )


def segment(df: DataFrame) -> DataFrame:
    return df.withColumn("uplift_segment", quadrant(F.col("base_churn_prob"), F.col("cate")))


def segment_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("uplift_segment").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("cate").alias("mean_cate"))
