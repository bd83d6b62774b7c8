"""Running totals and order statistics along a value, without ever putting one group in one task.

A window ordered by score over a whole table runs in a single task. Here the rows are first
combined per distinct value (map-side, so a hot value costs nothing), the distinct values are cut
into slices at approximate quantiles, the running totals are taken inside each (group, slice), and
the totals of the earlier slices are added. The result is exact whatever the cuts are: they only
balance the work.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _slice_count(df: DataFrame) -> int:
    """As many slices as shuffle partitions."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def slice_of(value: Column, edges: Column, slices: int) -> Column:
    """How many of the sorted ``edges`` lie below the value, by bisection."""
    steps = [1 << i for i in reversed(range(slices.bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda at, step: F.when(
            F.coalesce(F.get(edges, at + step - 1) < value, F.lit(False)), at + step).otherwise(at))


def running_totals(
    df: DataFrame,
    value: str,
    totals: Mapping[str, Column],
    by: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Per group and distinct value: each total, its running total up to here, its grand total.

    ``totals`` maps a name to an aggregate. The output has ``by``, ``value`` and, for each name
    ``n``: ``n``, ``n_upto`` (this value included) and ``n_all``.
    """
    by, names = list(by), list(totals)
    slices = slices or _slice_count(df)
    cells = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(*[aggregate.alias(name) for name, aggregate in totals.items()])
    )
    cuts = [i / slices for i in range(1, slices)]
    # Reading every total here keeps this branch identical to the one below up to the shuffle of
    # the distinct values, so the input is scanned and shuffled once.
    widest = F.greatest(*[F.col(n).cast("double") for n in names]) if names[1:] \
        else F.col(names[0]).cast("double")
    counted = F.when(widest >= F.lit(float("-inf")), F.col(value))
    edges = cells.agg(F.percentile_approx(counted, cuts, 2000)).scalar()
    sliced = (
        cells.withColumn("_edges", edges)
        .withColumn("_slice", slice_of(F.col(value), F.col("_edges"), slices))
        .drop("_edges")
    )
    # One seed row per slice carries the totals of the earlier slices. It sorts first in its
    # slice (null value), so the running sums start from it and no join is needed.
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    seeds = (
        sliced.groupBy(*by, "_slice")
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(
            *by, "_slice", F.lit(None).cast(cells.schema[value].dataType).alias(value),
            *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).cast(cells.schema[n].dataType)
              .alias(n) for n in names],
            *[F.sum(n).over(group).cast(cells.schema[n].dataType).alias(f"{n}_all")
              for n in names],
        )
    )
    rows = sliced.select(*by, "_slice", value, *names, *[
        F.lit(None).cast(cells.schema[n].dataType).alias(f"{n}_all") for n in names])
    inside = (
        Window.partitionBy(*by, "_slice").orderBy(F.col(value).asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = rows.unionByName(seeds).withColumns({
        **{f"{n}_upto": F.sum(n).over(inside) for n in names},
        **{f"{n}_all": F.first(f"{n}_all").over(inside) for n in names},
    })
    return summed.where(F.col(value).isNotNull()).select(
        *by, value, *names, *[f"{n}_upto" for n in names], *[f"{n}_all" for n in names])


def exact_quantiles(
    df: DataFrame, value: str, fractions: Mapping[str, float], by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    ``weight`` names a column of row counts when the input is already combined per value.

    The position of fraction q among n ordered values is q * (n - 1); the two neighbours are read
    off the running counts, so no task ever sorts a whole group.
    """
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    ranked = running_totals(df, value, {"n": rows}, by)
    picks = []
    for name, q in fractions.items():
        position = F.lit(float(q)) * (F.col("n_all") - 1)
        held = F.col("n_upto")
        picks += [
            F.min(F.when(held > F.floor(position), F.col(value))).alias(f"{name}_lo"),
            F.min(F.when(held > F.ceil(position), F.col(value))).alias(f"{name}_hi"),
        ]
    picked = ranked.groupBy(*by).agg(F.max("n_all").alias("_n"), *picks)

    def between(name: str, q: float) -> Column:
        position = F.lit(float(q)) * (F.col("_n") - 1)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return (low + (high - low) * (position - F.floor(position))).alias(name)

    return picked.select(*by, *[between(n, q) for n, q in fractions.items()])


def order_statistics(
    df: DataFrame, value: str, ranks: Mapping[str, "callable"], by: Sequence[str] = ()
) -> DataFrame:
    """k-th smallest values, where each k is a Column function of the group's row count."""
    ranked = running_totals(df, value, {"n": F.count(F.lit(1))}, by)
    return ranked.groupBy(*by).agg(
        F.max("n_all").alias("n"),
        *[F.min(F.when(F.col("n_upto") >= rank(F.col("n_all")), F.col(value))).alias(name)
          for name, rank in ranks.items()],
    )
