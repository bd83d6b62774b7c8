"""Batch scoring: decisions, tiers, contributions, summaries, isolation of bad rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewatch.operators import quality
from lapsewatch.operators.metrics import risk_tier


def decide(df: DataFrame, threshold: float, prob: str = "prob") -> DataFrame:
    """Response columns; decision and tier use the raw probability, only the output is rounded."""
    raw = F.col(prob)
    return df.withColumns({
        "churn_probability": F.round(raw, 4),
        "will_churn": raw >= F.lit(threshold),
        "threshold_used": F.round(F.lit(threshold), 4),
        "risk_tier": risk_tier(raw),
    })


def with_request_id(df: DataFrame) -> DataFrame:
    return df.withColumn("request_id", F.uuid())


def batch_summary(decided: DataFrame) -> DataFrame:
    """Totals of one scored batch."""
    tier = F.col("risk_tier")
    return decided.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(tier == "HIGH").alias("high_risk"),
        F.count_if(tier == "MEDIUM").alias("medium_risk"),
        F.count_if(tier == "LOW").alias("low_risk"),
        F.round(F.avg("churn_probability"), 4).alias("mean_probability"))


def top_contributions(df: DataFrame, weights: Mapping[str, float], means: Mapping[str, float],
                      n: int = 3) -> Column:
    """The n largest terms weight * (x - mean) of a linear score by absolute value, as a map.

    Equal terms keep the order of ``weights``.
    """
    terms = F.array(*[
        F.struct(
            (-F.abs((F.col(c) - F.lit(means[c])) * F.lit(w))).alias("size"),
            F.lit(i).alias("place"), F.lit(c).alias("feature"),
            ((F.col(c) - F.lit(means[c])) * F.lit(w)).alias("term"))
        for i, (c, w) in enumerate(weights.items())])
    best = F.slice(F.sort_array(terms), 1, n)
    return F.map_from_entries(F.transform(best, lambda t: F.struct(t["feature"], t["term"])))


def vector_contributions(names: Sequence[str], weights: Sequence[float], means: Sequence[float],
                         vector: str = "features", n: int = 3) -> Column:
    """The same for the slots of a fitted linear model's vector; one number per slot is bound in."""
    slots = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("feature"),
                               F.lit(float(w)).alias("weight"), F.lit(float(m)).alias("mean"))
                      for i, (name, w, m) in enumerate(zip(names, weights, means))])
    terms = F.zip_with(vector_to_array(vector), slots, lambda x, s: F.struct(
        (-F.abs((x - s["mean"]) * s["weight"])).alias("size"), s["place"].alias("place"),
        s["feature"].alias("feature"), ((x - s["mean"]) * s["weight"]).alias("term")))
    best = F.slice(F.sort_array(terms), 1, n)
    return F.map_from_entries(F.transform(best, lambda t: F.struct(t["feature"], t["term"])))


def explain(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with prob and explanation, the three strongest contributions, of a fitted pipeline whose
    last stage is linear or made of trees; slots dropped by its selector do not appear."""
    from lapsewatch.operators import attribution
    from lapsewatch.operators.encoding import vector_names
    from lapsewatch.operators.training import positive_probability
    scored, last = model.transform(df), model.stages[-1]
    if hasattr(last, "coefficients"):
        means = scored.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
        told = vector_contributions(vector_names(scored), last.coefficients.toArray(), means)
    else:
        forest = attribution.Forest.of(attribution.tree_table(last, df.sparkSession))
        scored = attribution.attributed(scored, forest, vector_names(scored))
        told = F.map_from_entries("strongest")
    return scored.withColumns({"prob": positive_probability(scored), "explanation": told}).select(
        *df.columns, "prob", "explanation")


def full_response(df: DataFrame, threshold: float, quantiles: DataFrame, prob: str = "prob") -> DataFrame:
    """The whole answer for a row: decision columns, its explanation as it came, and ``conformal``,
    an array with one prediction set per confidence in ascending order."""
    levels = quantiles.agg(F.sort_array(F.collect_list(F.struct("confidence", "quantile")))).scalar()

    def of(level: Column) -> Column:
        churn, stays = (1.0 - F.col(prob)) <= level["quantile"], F.col(prob) <= level["quantile"]
        return F.struct(
            level["confidence"].alias("confidence"), churn.alias("includes_churn"),
            stays.alias("includes_no_churn"),
            (churn.cast("int") + stays.cast("int")).alias("set_size"),
            (churn & stays).alias("is_uncertain"))

    return decide(df.withColumn("_levels", levels), threshold, prob).withColumn(
        "conformal", F.transform("_levels", of)).drop("_levels")


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """One number per column, computed on the executors."""
    return df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()


def score_isolating_failures(df: DataFrame, probability: Column, threshold: float,
                             key: str = "customerID") -> DataFrame:
    """Every input row once: scored when it meets all request rules, else with its reasons.

    One bad row never fails the batch; its probability is null.
    """
    columns = quality.REQUEST_RULE_COLUMNS
    good = F.col("_good")
    marked = df.withColumn("_good", quality.meets_all(columns))
    scored = decide(marked.withColumn("prob", F.when(good, probability)), threshold)
    return scored.select(
        key, F.when(good, "scored").otherwise("failed").alias("status"),
        F.when(good, "").otherwise(quality.reasons(columns)).alias("reasons"),
        "churn_probability", F.when(good, F.col("will_churn")).alias("will_churn"),
        F.when(good, F.col("risk_tier")).alias("risk_tier"))
