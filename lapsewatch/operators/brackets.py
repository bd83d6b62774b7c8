"""Exact quantiles of many columns at once, without moving a row per column.

A sketch of every column brackets each wanted quantile between two values. A second pass counts,
map-side, what lies outside the brackets and keeps only the values inside them, a few per cent of
the rows. The exact order statistics come from that sliver. What the driver sees are the brackets
and counts: numbers per column, group and quantile.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewatch.operators.ranking import running_totals
from lapsewatch.operators.smalltables import materialise

#: Relative rank error of the sketch is one over this.
SKETCH = 2000


def number(column: str) -> Column:
    """The value as a double; NaN counts as missing."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def _number_sql(column: str) -> str:
    return f"nanvl(CAST(`{column}` AS DOUBLE), NULL)"


def _intervals(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Brackets in order, overlapping ones joined."""
    out: list[tuple[float, float]] = []
    for low, high in sorted(points):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def wide_quantiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float],
                   by: str | None = None) -> dict[tuple[str, object], list[float]]:
    """(column, group) -> exact quantiles with linear interpolation, in the order of ``fractions``.

    ``by`` names a column of few groups, such as the label. Columns without values are left out.
    """
    group = f"`{by}`" if by else "0"
    reach = 3.0 / SKETCH
    asked = sorted({min(1.0, max(0.0, q + d)) for q in fractions for d in (-reach, reach)})
    points_sql = ", ".join(map(repr, asked))
    # SQL text: as column objects, hundreds of expressions would cost thousands of calls.
    sketches = df.groupBy(F.expr(group).alias("_g")).agg(*[
        F.expr(f"struct(count({v}) AS n, min({v}) AS lo, max({v}) AS hi, "
               f"percentile_approx({v}, array({points_sql}), {SKETCH}) AS p)").alias(c)
        for c, v in ((c, _number_sql(c)) for c in columns)]).collect()
    counts, spans, known = {}, {}, {}
    for row in sketches:
        for c in columns:
            n, low, high = row[c]["n"], row[c]["lo"], row[c]["hi"]
            if not n:
                continue
            found = dict(zip(asked, row[c]["p"]))
            points = []
            for q in fractions:
                # Where a step of the sketch is less than two rows it says nothing.
                small = n < 2 * SKETCH
                points.append((low if small or q - reach <= 0 else found[q - reach],
                               high if small or q + reach >= 1 else found[q + reach]))
            if all(a == b for a, b in points):
                # Both ends of every bracket are one value: that is the quantile.
                known[c, row["_g"]] = [a for a, _ in points]
                continue
            counts[c, row["_g"]] = n
            spans[c, row["_g"]] = _intervals(points)
    groups = sorted({g for _, g in spans}, key=repr)

    def placed(c: str) -> str:
        """Number of the interval that the value is in or before, and the value if inside."""
        value, cases = _number_sql(c), ""
        for g in groups:
            if (c, g) not in spans:
                continue
            starts, ends = (", ".join(f"double('{x[i]!r}')" for x in spans[c, g]) for i in (0, 1))
            same = f"{group} IS NULL" if g is None else f"{group} = {g!r}" if by else "true"
            at = f"size(filter(array({ends}), e -> e < {value}))"
            cases += (f" WHEN {same} THEN named_struct('feature', '{c}', 'cell', {at}, 'value', "
                      f"CASE WHEN {value} >= get(array({starts}), {at}) THEN {value} END)")
        return f"CASE WHEN {value} IS NULL THEN NULL{cases} END"

    listed = [c for c in columns if any((c, g) in spans for g in groups)]
    if not listed:
        return known
    cells = materialise(
        df.select(F.expr(group).alias("g"), F.expr(f"explode(array({', '.join(map(placed, listed))}))").alias("x"))
        .where("x IS NOT NULL").groupBy("g", "x.feature", "x.cell", "x.value")
        .agg(F.count(F.lit(1)).alias("n")), "brackets")
    below: dict[tuple, int] = {}
    sizes = cells.groupBy("g", "feature", "cell").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("out"),
        F.sum("n").alias("n")).collect()
    totals = {(r["feature"], r["g"], r["cell"]): (r["out"], r["n"]) for r in sizes}
    wanted = []
    for (c, g), n in counts.items():
        before = 0
        for cell in range(len(spans[c, g]) + 1):
            out, all_ = totals.get((c, g, cell), (0, 0))
            below[c, g, cell] = before + out
            for i, q in enumerate(fractions):
                for end, rank in ((0, math.floor(q * (n - 1))), (1, math.ceil(q * (n - 1)))):
                    if before + out <= rank < before + all_:
                        wanted.append((c, g, cell, rank - before - out, i, end))
            before += all_
    ranked = running_totals(cells.where("value IS NOT NULL").withColumn("g", F.col("g").cast("string")),
                            "value", {"n": F.sum("n")}, ["g", "feature", "cell"])
    ask = df.sparkSession.createDataFrame(
        [(None if g is None else str(g), *rest) for c, g, *tail in wanted for rest in [(c, *tail)]],
        "g string, feature string, cell int, rank bigint, i int, end int")
    # A row per column, group and quantile on the asking side.
    hit = ranked.join(F.broadcast(ask.withColumnsRenamed({"g": "g_", "feature": "f_", "cell": "c_"})),
                      F.col("g").eqNullSafe(F.col("g_")) & (F.col("feature") == F.col("f_"))
                      & (F.col("cell") == F.col("c_")) & (F.col("n_upto") > F.col("rank"))
                      & (F.col("n_upto") - F.col("n") <= F.col("rank")))
    names = {None if g is None else str(g): g for g in groups}
    value = {(r["f_"], names[r["g_"]], r["i"], r["end"]): r["value"]
             for r in hit.select("f_", "g_", "i", "end", "value").collect()}
    out = dict(known)
    for (c, g), n in counts.items():
        found = []
        for i, q in enumerate(fractions):
            position = q * (n - 1)
            low, high = value[c, g, i, 0], value[c, g, i, 1]
            found.append(low + (high - low) * (position - math.floor(position)))
        out[c, g] = found
    return out
