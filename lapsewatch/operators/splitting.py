"""Row splits by a hash of the key: repeatable, without a sort, the same on any cluster.

A plain hash cut keeps the class rates in expectation, in one pass. The exact splits cut every class
at an order statistic of its own hashes, found by bracketed quantiles in two passes over narrow
rows, so each part holds its share of each class to the row. Two salted hashes are independent, so
a split may be cut again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewatch.operators.brackets import wide_quantiles
from lapsewatch.operators.smalltables import materialise

HEX_DIGITS = 8
#: Digits of the hash where no two rows should meet: all that a double holds.
FINE_DIGITS = 13
#: Classes that an exact split may have.
MOST_CLASSES = 100


def hash_share(key: str = "customerID", salt: str = "", digits: int = HEX_DIGITS) -> Column:
    """A number in [0, 1) fixed by the key: the leading hex digits of its MD5."""
    text = F.concat(F.lit(salt), F.col(key).cast("string")) if salt else F.col(key).cast("string")
    head = F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")
    return head.cast("double") / F.lit(float(16 ** digits))


def split_label(parts: Sequence[tuple[str, float]], key: str = "customerID",
                salt: str = "") -> Column:
    """Name of the part each row falls in; shares add up to 1, the last part takes the rest."""
    share, upto, chosen = hash_share(key, salt), 0.0, None
    for name, size in parts[:-1]:
        upto = round(upto + size, 12)
        inside = share < F.lit(upto)
        chosen = F.when(inside, name) if chosen is None else chosen.when(inside, name)
    return chosen.otherwise(parts[-1][0]) if chosen is not None else F.lit(parts[-1][0])


TRAIN_TEST = [("train", 0.8), ("test", 0.2)]
TRAIN_VALIDATION_TEST = [("train", 0.7), ("validation", 0.1), ("test", 0.2)]
WITH_CALIBRATION = [("train", 0.6), ("isotonic", 0.1), ("conformal", 0.1), ("test", 0.2)]


def add_split(df: DataFrame, parts: Sequence[tuple[str, float]] = TRAIN_VALIDATION_TEST,
              key: str = "customerID", name: str = "split") -> DataFrame:
    return df.withColumn(name, split_label(parts, key))


def add_fold(df: DataFrame, k: int = 5, key: str = "customerID", name: str = "fold",
             salt: str = "fold:") -> DataFrame:
    """Fold number 0 .. k-1 as equal ranges of a salted hash."""
    return df.withColumn(name, F.floor(hash_share(key, salt) * F.lit(k)).cast("int"))


def class_cuts(df: DataFrame, upto: Sequence[float], key: str = "customerID", by: str = "label",
               salt: str = "") -> dict[object, list[float]]:
    """Per class the hashes below which exactly the shares ``upto`` of its rows lie, to the row.

    Share s of n rows is floor(s * n + 1/2) rows. Rows with equal hashes (repeated keys) stay
    together. The driver holds a number per class and cut.
    """
    rows = materialise(df.select(F.col(by).alias("class"), hash_share(key, salt, FINE_DIGITS).alias("share")), "hashes")
    sizes = {r["class"]: r["count"] for r in rows.groupBy("class").count().limit(MOST_CLASSES + 1).collect()}
    if len(sizes) > MOST_CLASSES:
        raise ValueError(f"{by} has more than {MOST_CLASSES} classes")
    wanted = {c: [math.floor(s * n + 0.5) for s in upto] for c, n in sizes.items()}
    # Half way between two order statistics lies a number that parts them.
    place = {(c, k): (k - 0.5) / (sizes[c] - 1) for c, ks in wanted.items() for k in ks if 0 < k < sizes[c]}
    fractions = sorted(set(place.values()))
    found = wide_quantiles(rows, ["share"], fractions, "class") if fractions else {}

    def cut(c: object, k: int) -> float:
        if (c, k) in place:
            return found["share", c][fractions.index(place[c, k])]
        return 0.0 if k <= 0 else 2.0

    return {c: [cut(c, k) for k in ks] for c, ks in wanted.items()}


def _part_number(cuts: dict[object, list[float]], key: str, by: str, salt: str) -> Column:
    """How many of its class's cuts a row's hash has reached."""
    share = hash_share(key, salt, FINE_DIGITS)
    number = None
    for c, found in cuts.items():
        passed = sum(((share >= F.lit(t)).cast("int") for t in found), F.lit(0))
        same = F.col(by).eqNullSafe(F.lit(c))
        number = F.when(same, passed) if number is None else number.when(same, passed)
    return F.lit(0) if number is None else number


def add_exact_split(df: DataFrame, parts: Sequence[tuple[str, float]] = TRAIN_VALIDATION_TEST,
                    key: str = "customerID", by: str = "label", name: str = "split") -> DataFrame:
    """Parts that hold their share of every class to the row."""
    upto = [round(sum(size for _, size in parts[:i + 1]), 12) for i in range(len(parts) - 1)]
    number = _part_number(class_cuts(df, upto, key, by), key, by, "")
    return df.withColumn(name, F.get(F.array(*[F.lit(p) for p, _ in parts]), number))


def add_exact_folds(df: DataFrame, k: int = 5, key: str = "customerID", by: str = "label",
                    name: str = "fold", salt: str = "fold:") -> DataFrame:
    """Fold number 0 .. k-1; the rows of a class differ by at most one between folds."""
    cuts = class_cuts(df, [i / k for i in range(1, k)], key, by, salt)
    return df.withColumn(name, _part_number(cuts, key, by, salt))


def at_most(df: DataFrame, rows: int | None, key: str = "customerID") -> DataFrame:
    """About ``rows`` rows, a cut of a hash of the key; all of them with None or if there are fewer."""
    if rows is None:
        return df
    share = rows / max(1, df.count())
    return df if share >= 1 else df.where(hash_share(key, "fit:") < F.lit(share))


def add_nested_share(df: DataFrame, steps: int = 10, key: str = "customerID",
                     name: str = "size_step", salt: str = "size:") -> DataFrame:
    """Smallest subsample step holding the row: step s of ``steps`` keeps rows with value <= s.

    Larger subsamples contain the smaller ones by construction.
    """
    return df.withColumn(name, (F.floor(hash_share(key, salt) * F.lit(steps)) + 1).cast("int"))
