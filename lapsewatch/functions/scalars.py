"""Small Column helpers used across operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def equals(column: str, value: str) -> Column:
    """1 when the column holds ``value``, else 0; null counts as different."""
    return F.col(column).eqNullSafe(F.lit(value)).cast("int")


def differs(column: str, value: str) -> Column:
    """1 when the column holds anything but ``value``, null included."""
    return (~F.col(column).eqNullSafe(F.lit(value))).cast("int")


def truth(condition: Column) -> Column:
    """A condition as 0/1 with null as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def ratio(top: Column, bottom: Column) -> Column:
    """Division in doubles with 0 where the bottom is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def step_of(value: Column, steps: int) -> Column:
    """Largest i with ``i / steps <= value``, compared with the exact double ``i / steps``.

    Multiplying first and flooring is off by one for values such as 0.29 * 100, so the guess is
    corrected against its own edges.
    """
    n = F.lit(float(steps))
    guess = F.floor(value * n)
    return (
        F.when(value < guess.cast("double") / n, guess - 1)
        .when(value >= (guess + 1).cast("double") / n, guess + 1)
        .otherwise(guess)
        .cast("int")
    )


def bin_of(value: Column, bins: int) -> Column:
    """Equal-width bin over [0, 1] with bins (lo, hi], the first one closed on both ends."""
    step = step_of(value, bins)
    on_edge = value == step.cast("double") / F.lit(float(bins))
    return F.greatest(F.when(on_edge, step - 1).otherwise(step), F.lit(0))


def named(value: Column, name: str, digits: int) -> Column:
    """Rounded and aliased report value."""
    return F.round(value, digits).alias(name)


def tall(columns: Sequence[str], name: str = "feature", value: str = "value",
         cast: str = "double") -> Column:
    """An exploded (name, value) struct per listed column; select it with ``inline``."""
    return F.inline(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast(cast).alias(value)) for c in columns
    ]))


def digamma(n: Column) -> Column:
    """The digamma function of a whole number from 1: its series six steps further, less the steps."""
    x = n.cast("double") + 6.0
    w = F.lit(1.0) / (x * x)
    series = F.log(x) - F.lit(0.5) / x - w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w / 132))))
    return series - sum((F.lit(1.0) / (n.cast("double") + float(i)) for i in range(6)), F.lit(0.0))
