"""Mergeable daily summaries: any window of days from stored sketches, without a second scan.

A day and column is one row: rows, missing values, sum, sum of squares, smallest, largest, a HyperLogLog
sketch of the distinct values and, for numbers, a KLL sketch of the distribution. New days are
appended; a window merges its days. Counts, sums and moments are exact. A distinct count is off by about
``1.04 / 2 ** (LOG_SIZE / 2)`` of itself (one deviation), a rank by about ``RANK_ERROR`` of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewatch import constants as K
from lapsewatch.operators.brackets import number

LOG_SIZE, KLL_SIZE = 13, 1024
#: Bounds: three deviations of a distinct count; of a rank, with 99 per cent confidence.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LOG_SIZE / 2), 0.004


def daily(df: DataFrame, at: str, numeric: Sequence[str], other: Sequence[str] = ()) -> DataFrame:
    """day, column_name and the summary of every listed column; rows without a time have a null day.

    What is shuffled is a row per day and task.
    """
    def summary(c: str, is_number: bool) -> Column:
        value = number(c) if is_number else F.col(c)
        whole = F.lit(None).cast("double")
        return F.struct(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n"), F.count(value).alias("present"),
            (F.sum(value) if is_number else whole).alias("total"),
            (F.sum(value * value) if is_number else whole).alias("squares"),
            (F.min(value) if is_number else whole).alias("low"), (F.max(value) if is_number else whole).alias("high"),
            F.hll_sketch_agg(value.cast("string"), F.lit(LOG_SIZE)).alias("distinct_sketch"),
            (F.kll_sketch_agg_double(value, F.lit(KLL_SIZE)) if is_number
             else F.lit(None).cast("binary")).alias("rank_sketch"))

    days = df.groupBy(F.to_date(at).alias("day")).agg(F.array(
        *[summary(c, True) for c in numeric], *[summary(c, False) for c in other]).alias("found"))
    return days.select("day", F.inline("found"))


def merged(summaries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The summaries of several days as one row per column (and ``by``), sketches included."""
    return summaries.groupBy(*by, "column_name").agg(
        F.sum("n").alias("n"), F.sum("present").alias("present"), F.sum("total").alias("total"),
        F.sum("squares").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("rank_sketch").alias("rank_sketch"))


def window(summaries: DataFrame, first: Column | str, last: Column | str) -> DataFrame:
    """One row per column for the days from ``first`` to ``last``, both included."""
    ends = [F.lit(d).cast("date") if isinstance(d, str) else d for d in (first, last)]
    return merged(summaries.where(F.col("day").between(*ends)))


def profile(rows: DataFrame) -> DataFrame:
    """Merged rows as column_name, n, nulls, distinct_values (estimated), mean, std (population), deciles."""
    mean = F.try_divide(F.col("total"), F.col("present"))
    spread = F.sqrt(F.greatest(F.try_divide(F.col("squares"), F.col("present")) - mean * mean, F.lit(0.0)))
    deciles = F.kll_sketch_get_quantile_double(F.col("rank_sketch"), F.array(*[F.lit(i / 10) for i in range(11)]))
    return rows.select(
        *[c for c in rows.columns if c not in SUMMARY], "column_name", "n", (F.col("n") - F.col("present")).alias("nulls"),
        F.hll_sketch_estimate("distinct_sketch").alias("distinct_values"), mean.alias("mean"), spread.alias("std"),
        F.when(F.col("low").isNotNull(), deciles).alias("deciles"))


SUMMARY = ("column_name", "n", "present", "total", "squares", "low", "high", "distinct_sketch", "rank_sketch")


def psi(reference: DataFrame, current: DataFrame, bins: int = 10, limit: float = K.PSI_LIMIT) -> DataFrame:
    """feature, psi, is_drifted of two merged windows: bins from the reference's deciles, shares from the
    ranks of their edges in both sketches. Features without values on a side are left out."""
    inner = F.kll_sketch_get_quantile_double("rank_sketch", F.array(*[F.lit(i / bins) for i in range(1, bins)]))
    found = reference.where("low IS NOT NULL").select("column_name", "low", "high", inner.alias("inner")).collect()
    edges = {r.column_name: sorted({r.low, *r.inner, r.high}) for r in found}
    if not edges:
        return reference.sparkSession.createDataFrame([], "feature string, psi double, is_drifted boolean")

    def below(sketch: str) -> Column:
        """Share of values below every edge, and up to the last one: ranks just beside the edges, as a value
        at an edge belongs to the bin that begins there, and to the last bin at its end."""
        shares = None
        for name, at in edges.items():
            asked = [math.nextafter(e, -math.inf) for e in at[:-1]] + [math.nextafter(at[-1], math.inf)]
            ranks = F.kll_sketch_get_rank_double(F.col(sketch), F.array(*map(F.lit, asked)))
            same = F.col("feature") == name
            shares = F.when(same, ranks) if shares is None else shares.when(same, ranks)
        return shares

    both = reference.where("low IS NOT NULL").select(F.col("column_name").alias("feature"), F.col("rank_sketch").alias("r")).join(
        current.where("low IS NOT NULL").select(F.col("column_name").alias("feature"), F.col("rank_sketch").alias("c")), "feature")
    both = both.withColumns({"rs": below("r"), "cs": below("c")})

    def share(ranks: str, i: Column) -> Column:
        return F.greatest(F.get(F.col(ranks), i + 1) - F.get(F.col(ranks), i), F.lit(0.0)) + K.PSI_FLOOR

    def term(i: Column) -> Column:
        return (share("cs", i) - share("rs", i)) * F.log(share("cs", i) / share("rs", i))

    bins_of = F.size("rs") - 1
    total = F.aggregate(F.transform(F.sequence(F.lit(0), bins_of - 1), term), F.lit(0.0), lambda t, x: t + x)
    return both.select("feature", F.when(bins_of >= 2, total).otherwise(0.0).alias("psi")).withColumn(
        "is_drifted", F.col("psi") > limit)


def rolling_mean(summaries: DataFrame, column: str, days: int = 7) -> DataFrame:
    """Mean of the last ``days`` days at every stored day, from the daily rows: day, requests, mean."""
    mine = summaries.where((F.col("column_name") == column) & F.col("day").isNotNull()).select(
        "day", "present", "total")
    spread = mine.select(F.explode(F.sequence(F.col("day"), F.date_add("day", days - 1))).alias("day"),
                         "present", "total")
    held = spread.groupBy("day").agg(F.sum("present").alias("requests"), F.sum("total").alias("total"))
    return held.join(mine.select("day"), "day").select(
        "day", "requests", F.try_divide(F.col("total"), F.col("requests")).alias("mean"))
