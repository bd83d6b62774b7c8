"""Exploratory aggregates over customer rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewatch.functions.scalars import ratio, tall
from lapsewatch.operators.brackets import number, wide_quantiles
from lapsewatch.operators.smalltables import join_small, materialise


def _rate(label: str = "label") -> Column:
    return F.avg(F.col(label).cast("double"))


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, nulls, percent null (2 dp), distinct values.

    Rows go to (column, value) counts first, so a column with few values shuffles few rows.
    """
    types = {c: t for c, t in df.dtypes}
    values = df.select(tall(df.columns, "column_name", "value", "string"))
    counts = values.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    kind = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return counts.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
        F.sum("n").alias("_rows"),
    ).select(
        "column_name", kind[F.col("column_name")].alias("type"), "nulls",
        F.round(F.col("nulls") * 100.0 / F.col("_rows"), 2).alias("pct_null"), "distinct_values")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles, maximum per numeric column."""
    df = materialise(df.select(*[number(c).alias(c) for c in columns]), "numbers")
    moments = df.agg(*[x for c in columns for x in (
        F.count(number(c)).alias(f"{c}__n"), F.avg(number(c)).alias(f"{c}__m"),
        F.stddev_samp(number(c)).alias(f"{c}__s"), F.min(number(c)).alias(f"{c}__lo"),
        F.max(number(c)).alias(f"{c}__hi"))]).first()
    quartiles = wide_quantiles(df, columns, [0.25, 0.5, 0.75])
    rows = [(c, *[moments[f"{c}__{m}"] for m in ("n", "m", "s", "lo", "hi")],
             *quartiles.get((c, 0), [None] * 3)) for c in columns]
    return df.sparkSession.createDataFrame(
        rows, "feature string, count bigint, mean double, std double, min double, max double, "
              "q25 double, q50 double, q75 double")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def revenue_at_risk(df: DataFrame, recovered: float = 0.10) -> DataFrame:
    """Churners times the mean monthly charge, per year, and what a recovery share would keep."""
    churners, monthly = F.sum(F.col("label").cast("bigint")), F.avg("MonthlyCharges")
    return df.agg(
        churners.alias("churners"), monthly.alias("mean_monthly"),
        (churners * monthly * 12.0).alias("annual_at_risk"),
        (churners * monthly * 12.0 * F.lit(recovered)).alias("annual_recovered"))


def rate_by(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Customers, churners and churn rate per group."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(F.col("label").cast("bigint")).alias("churners"),
        _rate().alias("churn_rate"))


def tenure_bucket(tenure: Column) -> Column:
    """[0,6], (6,12], (12,24], (24,48], (48,72]; null outside."""
    return (
        F.when((tenure < 0) | (tenure > 72), None).when(tenure <= 6, "0-6m")
        .when(tenure <= 12, "7-12m").when(tenure <= 24, "13-24m")
        .when(tenure <= 48, "25-48m").when(tenure <= 72, "49-72m")
    )


def rate_matrix(df: DataFrame, row: str, column: str, levels: Sequence[str]) -> DataFrame:
    """Churn rate by two categories, one column per listed level, 0 for an empty cell."""
    cells = df.groupBy(row).agg(*[
        F.coalesce(F.avg(F.when(F.col(column) == level, F.col("label").cast("double"))),
                   F.lit(0.0)).alias(level) for level in levels])
    return cells


def median_by_class(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    kind = df.schema["label"].dataType.simpleString()
    rows = materialise(df.select("label", *[number(c).alias(c) for c in columns]), "numbers")
    medians = wide_quantiles(rows, columns, [0.5], "label")
    return df.sparkSession.createDataFrame(
        [(c, label, m[0]) for (c, label), m in medians.items()],
        f"feature string, label {kind}, median double")


def segment_report(df: DataFrame, segment: Column) -> DataFrame:
    """Size, share, churn rate, lift and monthly revenue at risk of one segment, in one pass."""
    inside = F.coalesce(segment, F.lit(False))
    label = F.col("label").cast("double")
    rate, overall = F.avg(F.when(inside, label)), F.avg(label)
    return df.agg(
        F.count_if(inside).alias("segment_size"),
        ratio(F.count_if(inside), F.count(F.lit(1))).alias("share"),
        rate.alias("churn_rate"),
        F.try_divide(rate, overall).alias("lift"),
        F.coalesce(F.sum(F.when(inside & (F.col("label") == 1), F.col("MonthlyCharges"))),
                   F.lit(0.0)).alias("monthly_at_risk"),
    )


def high_risk() -> Column:
    return (
        (F.col("Contract") == "Month-to-month") & (F.col("InternetService") == "Fiber optic")
        & (F.col("tenure") <= 12)
    )


def risk_profile(df: DataFrame, by: str) -> DataFrame:
    """Customers, churn rate, lift and monthly revenue at risk per level of ``by``."""
    groups = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(F.col("label").cast("bigint")).alias("churners"),
        F.sum(F.when(F.col("label") == 1, F.col("MonthlyCharges")).otherwise(0.0))
        .alias("monthly_at_risk"))
    base = groups.agg(F.sum("churners") / F.sum("customers")).scalar()
    rate = F.col("churners") / F.col("customers")
    return groups.select(
        by, "customers", "churners", F.round(rate, 6).alias("churn_rate"),
        F.round(F.try_divide(rate, base), 6).alias("lift"),
        F.round("monthly_at_risk", 2).alias("monthly_at_risk"),
    ).orderBy(by)


def density_histogram(df: DataFrame, column: str, bins: int = 30, by: str = "label") -> DataFrame:
    """Density per equal-width bin within each class; every class has its own range."""
    value = F.col(column).cast("double")
    ranges = df.groupBy(by).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_rows"))
    ranged = join_small(df.select(by, value.alias("_v")), ranges, [by])
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    slot = F.least(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), width)), F.lit(bins - 1))
    return (
        ranged.groupBy(by, F.coalesce(slot, F.lit(0)).cast("int").alias("bin"))
        .agg(F.count("_v").alias("n"), F.max(width).alias("width"), F.max("_rows").alias("_rows"))
        .select(by, "bin", "n",
                F.try_divide(F.col("n"), F.col("_rows") * F.col("width")).alias("density"))
    )


def flag_lift(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Churn rate with and without each 0/1 flag, lift over the base rate, flagged rows."""
    cells = df.select("label", tall(flags, cast="int")).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("pos"))

    def part(flag: int, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("value") == flag, F.col(column))), F.lit(0))

    return cells.groupBy("feature").agg(
        part(1, "n").alias("n1"), part(1, "pos").alias("p1"),
        part(0, "n").alias("n0"), part(0, "pos").alias("p0"),
    ).select(
        "feature", F.col("n1").alias("count_flagged"),
        F.try_divide("p1", "n1").alias("flagged_rate"),
        F.try_divide("p0", "n0").alias("unflagged_rate"),
        F.try_divide(F.try_divide("p1", "n1"),
                     F.try_divide(F.col("p1") + F.col("p0"), F.col("n1") + F.col("n0")))
        .alias("lift"))


def group_lift(df: DataFrame, by: str) -> DataFrame:
    rates = rate_by(df, by)
    base = rates.agg(F.sum("churners") / F.sum("customers")).scalar()
    return rates.withColumn("lift", F.try_divide(F.col("churn_rate"), base))


def class_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of each numeric feature among churners and among the rest."""
    label = F.col("label")
    return df.select("label", tall(columns)).groupBy("feature").agg(
        F.avg(F.when(label == 1, F.col("value"))).alias("mean_churned"),
        F.avg(F.when(label == 0, F.col("value"))).alias("mean_retained"))


def inventory(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Kind of each feature (binary, categorical, numeric), its levels, and its class summary.

    A binary feature reports the churn rate at 1 and at 0, a numeric one its class means.
    """
    texts = {c for c, t in df.dtypes if t == "string"}
    cells = df.select("label", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(c in texts).alias("text"),
                 F.col(c).cast("string").alias("value"),
                 (F.lit(None).cast("double") if c in texts else F.col(c).cast("double"))
                 .alias("number"))
        for c in columns
    ]))).groupBy("feature", "text", "value", "number").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("pos"))
    n, pos, x = F.col("n").cast("double"), F.col("pos").cast("double"), F.col("number")
    rolled = cells.groupBy("feature", "text").agg(
        F.count("value").alias("levels"),
        F.bool_and(x.isin(0.0, 1.0)).alias("zero_one"),
        F.try_divide(F.sum(F.when(x == 1.0, pos)), F.sum(F.when(x == 1.0, n))).alias("rate_1"),
        F.try_divide(F.sum(F.when(x == 0.0, pos)), F.sum(F.when(x == 0.0, n))).alias("rate_0"),
        F.try_divide(F.sum(x * pos), F.sum(pos)).alias("mean_1"),
        F.try_divide(F.sum(x * (n - pos)), F.sum(n - pos)).alias("mean_0"),
    )
    binary = ~F.col("text") & F.col("zero_one") & (F.col("levels") <= 2)
    return rolled.select(
        "feature", "levels",
        F.when(F.col("text"), "categorical").when(binary, "binary").otherwise("numeric")
        .alias("kind"),
        F.when(binary, F.col("rate_1")).when(~F.col("text"), F.col("mean_1")).alias("at_churn"),
        F.when(binary, F.col("rate_0")).when(~F.col("text"), F.col("mean_0")).alias("at_retain"))
