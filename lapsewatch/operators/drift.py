"""Drift of a current table against a reference: PSI, chi-square, prediction shift, report.

Numeric features: reference deciles come from bracketed quantiles, then both sides are counted per
feature and bin before the shuffle, so what moves does not depend on the rows. Text features:
counts per category.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewatch import constants as K
from lapsewatch.functions.scalars import tall
from lapsewatch.functions.tails import chi_square_p_value
from lapsewatch.operators.brackets import number, wide_quantiles
from lapsewatch.operators.smalltables import materialise

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def monitored_features(df: DataFrame, skip: Sequence[str] = ("customerID", "label", "prob")
                       ) -> dict[str, str]:
    """Feature -> numerical or categorical, read off the column types; flags count as numbers."""
    kinds = {}
    for name, kind in df.dtypes:
        if name in skip:
            continue
        if kind in NUMBERS or kind.startswith("decimal"):
            kinds[name] = "numerical"
        elif kind in ("string", "boolean"):
            kinds[name] = "categorical"
    return kinds


def _present(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> list[str]:
    return [f for f in features if f in reference.columns and f in current.columns]


PSI_COLUMNS = ("feature string, psi double, is_drifted boolean, reference_mean double, current_mean double, "
               "reference_std double, current_std double")


def psi(reference: DataFrame, current: DataFrame, features: Sequence[str], bins: int = 10,
        limit: float = K.PSI_LIMIT, written: bool = False) -> DataFrame:
    """Population stability index per numeric feature, with means and population deviations.

    Edges are the reference deciles without repeats, bins are [lo, hi) with the last one closed.
    A value outside the reference range falls in no bin but stays in the row count. Fewer than
    three edges (a constant feature) score 0. Features missing on a side are left out. ``written``
    says that both sides are tables already, whose columns cost nothing to read again.
    """
    names = _present(reference, current, features)
    spark = reference.sparkSession
    if not names:
        return spark.createDataFrame([], PSI_COLUMNS)
    # Derived columns are worked out once; the passes below read numbers.
    reference, current = (df.select(*[number(c).alias(c) for c in names]) for df in (reference, current))
    if not written:
        reference, current = materialise(reference, "sides"), materialise(current, "sides")
    found = wide_quantiles(reference, names, [i / bins for i in range(bins + 1)])
    edges = {c: sorted(set(e)) for (c, _), e in found.items()}
    kept = [c for c in names if c in edges]
    if not kept:
        return spark.createDataFrame([], PSI_COLUMNS)

    def side(df: DataFrame, ref: bool) -> DataFrame:
        return df.select(F.lit(ref).alias("ref"), F.inline(F.array(*[
            F.struct(F.lit(c).alias("feature"), _bin_index(c, edges[c]).alias("bin"), F.col(c).alias("value"))
            for c in kept]))).where("value IS NOT NULL")

    # Counts and moments of both sides in one pass, combined where the rows are: what is shuffled
    # is a row per side, feature, bin and task, and the rest works on these few cells.
    cells = side(reference, True).unionByName(side(current, False)).groupBy("feature", "ref", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    n, held = F.col("n"), materialise(cells, "cells")

    def of(is_ref: bool, value: Column) -> Column:
        return F.sum(F.when(F.col("ref") == is_ref, value))

    means = held.groupBy("feature").agg(
        of(True, n).alias("ref_rows"), of(False, n).alias("cur_rows"),
        (of(True, n * F.col("m")) / of(True, n)).alias("reference_mean"),
        (of(False, n * F.col("m")) / of(False, n)).alias("current_mean")).where("ref_rows > 0 AND cur_rows > 0")
    # One row per feature.
    sized = held.join(F.broadcast(means), "feature")
    mean = F.when(F.col("ref"), F.col("reference_mean")).otherwise(F.col("current_mean"))
    around = n * (F.col("v") + (F.col("m") - mean) * (F.col("m") - mean))
    parts = sized.groupBy("feature", "bin", *means.columns[1:]).agg(
        F.coalesce(of(True, n), F.lit(0)).alias("ref_n"), F.coalesce(of(False, n), F.lit(0)).alias("cur_n"),
        of(True, around).alias("ref_around"), of(False, around).alias("cur_around"))

    def share(which: str) -> Column:
        return F.col(f"{which}_n") / F.col(f"{which}_rows") + K.PSI_FLOOR

    # A bin nobody falls in on either side adds (floor - floor) * log(1) = 0, so the bins that
    # occur are all that is needed.
    term = (share("cur") - share("ref")) * F.log(share("cur") / share("ref"))
    flat = [c for c in kept if len(edges[c]) < 3]
    counted = F.col("bin").isNotNull() & ~F.col("feature").isin(flat)
    scored = parts.groupBy("feature").agg(
        F.sum(F.when(counted, term).otherwise(0.0)).alias("psi"),
        F.max("reference_mean").alias("reference_mean"), F.max("current_mean").alias("current_mean"),
        F.sqrt(F.sum("ref_around") / F.max("ref_rows")).alias("reference_std"),
        F.sqrt(F.sum("cur_around") / F.max("cur_rows")).alias("current_std"))
    return scored.select(
        "feature", "psi", (F.col("psi") > limit).alias("is_drifted"), "reference_mean",
        "current_mean", "reference_std", "current_std")


def _bin_index(column: str, edges: Sequence[float]) -> Column:
    """Bin of the column's number among sorted edges; null outside them."""
    listed = ", ".join(f"double('{e!r}')" for e in edges)
    value, last = f"`{column}`", f"double('{edges[-1]!r}')"
    return F.expr(f"""CASE WHEN {value} = {last} THEN {len(edges) - 2}
        WHEN {value} < {last} AND {value} >= double('{edges[0]!r}')
        THEN size(filter(array({listed}), e -> e <= {value})) - 1 END""")


def categorical_drift(reference: DataFrame, current: DataFrame, features: Sequence[str],
                      alpha: float = K.CHI_SQUARE_ALPHA) -> DataFrame:
    """Chi-square fit of current category counts to the reference, scaled to the current size.

    Categories of both sides count. An expected count is floored, so a category the reference
    never saw gives a huge statistic. Single-category features and empty sides are left out.
    """
    names = _present(reference, current, features)

    def counts(df: DataFrame, name: str) -> DataFrame:
        cells = df.select(tall(names, value="category", cast="string"))
        return cells.where("category IS NOT NULL").groupBy("feature", "category").agg(
            F.count(F.lit(1)).alias(name))

    both = counts(reference, "ref").join(
        counts(current, "cur"), ["feature", "category"], "full").fillna(0, ["ref", "cur"])
    totals = both.groupBy("feature").agg(
        F.sum("ref").alias("ref_all"), F.sum("cur").alias("cur_all"),
        F.count(F.lit(1)).alias("n_categories"))
    # One row per feature.
    sized = both.join(F.broadcast(totals), "feature").where(
        "n_categories >= 2 AND ref_all > 0 AND cur_all > 0")
    expected = F.greatest(F.col("ref") * (F.col("cur_all") / F.col("ref_all")),
                          F.lit(K.PSI_FLOOR))
    gap = F.col("cur") - expected
    tested = sized.groupBy("feature").agg(
        F.sum(gap * gap / expected).alias("statistic"),
        F.max("n_categories").alias("n_categories"))
    return tested.withColumn("p_value", chi_square_p_value(
        F.col("statistic"), (F.col("n_categories") - 1).cast("double"))).withColumn(
        "is_drifted", F.col("p_value") < alpha)


def prediction_drift(reference: DataFrame, current: DataFrame, prob: str = "prob",
                     limit: float = K.PREDICTION_DRIFT_LIMIT) -> DataFrame:
    """Relative shift of the mean probability (4 dp); 0 when the reference mean is 0."""
    means = reference.select(F.lit("ref").alias("side"), prob).unionByName(
        current.select(F.lit("cur").alias("side"), prob)).agg(
        F.avg(F.when(F.col("side") == "ref", F.col(prob))).alias("reference_mean"),
        F.avg(F.when(F.col("side") == "cur", F.col(prob))).alias("current_mean"))
    shift = F.when(F.col("reference_mean") == 0, 0.0).otherwise(
        F.round(F.abs(F.col("current_mean") - F.col("reference_mean"))
                / F.col("reference_mean"), 4))
    return means.withColumn("drift_score", shift).withColumn(
        "is_drifted", F.col("drift_score") > limit)


def feature_findings(reference: DataFrame, current: DataFrame, kinds: dict[str, str] | None = None,
                     written: bool = False) -> DataFrame:
    """One row per monitored feature: method, rounded score, threshold, verdict.

    The verdict is taken before the score is rounded. For chi-square the score is the p-value. The
    sides are written first unless they are tables already (``written``): every test reads them.
    """
    kinds = kinds or monitored_features(reference)
    if not written:
        reference, current = (materialise(df.select(*[c for c in kinds if c in df.columns]), "sides")
                              for df in (reference, current))
    numeric = [f for f, k in kinds.items() if k == "numerical"]
    texts = [f for f, k in kinds.items() if k == "categorical"]
    parts = []
    if numeric:
        parts.append(psi(reference, current, numeric, written=True).select(
            "feature", F.lit("psi").alias("method"), F.round("psi", 4).alias("score"),
            F.lit(K.PSI_LIMIT).alias("threshold"), "is_drifted"))
    if texts:
        parts.append(categorical_drift(reference, current, texts).select(
            "feature", F.lit("chi_squared").alias("method"), F.round("p_value", 6).alias("score"),
            F.lit(K.CHI_SQUARE_ALPHA).alias("threshold"), "is_drifted"))
    findings = parts[0]
    for part in parts[1:]:
        findings = findings.unionByName(part)
    return findings


def report(findings: DataFrame, prediction: DataFrame | None = None,
           reference: DataFrame | None = None, current: DataFrame | None = None) -> DataFrame:
    """One row: time, rows of both sides, verdict, drifted features, prediction shift, summary."""
    drifted = F.coalesce(F.sort_array(F.collect_list(
        F.when(F.col("is_drifted"), F.col("feature")))), F.array())
    rolled = findings.agg(
        drifted.alias("drifted"),
        F.count_if(F.col("method") == "psi").alias("n_numerical"),
        F.count_if(F.col("method") == "chi_squared").alias("n_categorical"))
    if prediction is not None:
        shift = prediction.select(F.struct("drift_score", "is_drifted")).scalar()
        rolled = rolled.withColumn("_shift", shift).withColumns({
            "prediction_score": F.col("_shift.drift_score"),
            "prediction_drifted": F.col("_shift.is_drifted"),
        })
    else:
        rolled = rolled.withColumns({
            "prediction_score": F.lit(None).cast("double"), "prediction_drifted": F.lit(False)})
    def size(df: DataFrame | None) -> Column:
        return F.lit(None).cast("bigint") if df is None else df.agg(F.count(F.lit(1))).scalar()

    rolled = rolled.withColumns({"reference_rows": size(reference), "current_rows": size(current)})
    any_drift = (F.size("drifted") > 0) | F.col("prediction_drifted")
    alarm = F.concat(
        F.lit("Drift detected: "), F.size("drifted").cast("string"), F.lit(" feature(s)"),
        F.when(F.col("prediction_drifted"), ", predictions").otherwise(""),
        F.lit(". Drifted: "), F.array_join("drifted", ", "))
    calm = F.concat(
        F.lit("No significant drift in "), F.col("n_numerical").cast("string"),
        F.lit(" numerical and "), F.col("n_categorical").cast("string"),
        F.lit(" categorical features"))
    return rolled.select(
        F.current_timestamp().alias("created_at"), "reference_rows", "current_rows",
        any_drift.alias("overall_drift"), F.size("drifted").alias("n_drifted"),
        F.array_join("drifted", ",").alias("drifted_features"),
        "n_numerical", "n_categorical", "prediction_score", "prediction_drifted",
        F.when(any_drift, alarm).otherwise(calm).alias("summary"))


def flat_scores(findings: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row with a ``drift_<feature>`` score (4 dp) per feature."""
    return findings.agg(*[
        F.round(F.max(F.when(F.col("feature") == f, F.col("score"))), 4).alias(f"drift_{f}")
        for f in features])


def severity(score: Column, moderate: float = K.PSI_MODERATE, high: float = K.PSI_LIMIT) -> Column:
    return F.when(score > high, "significant").when(score >= moderate, "moderate").otherwise("none")
