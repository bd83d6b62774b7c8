"""Fitted encodings: label codes, one-hot, standard scores, dummies, routed model vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsewatch import constants as K
from lapsewatch.functions.scalars import tall
from lapsewatch.operators.smalltables import materialise


#: One-hot and dummy columns are part of a schema; more levels than this are refused.
MOST_COLUMNS = 1000
#: Values of a column that a projection may list.
FEW = 64


def level_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, value, code: the place of every text value in the sorted values of its column.

    The distinct values are range-partitioned by column and value and numbered inside their
    slice; the slices before add their counts. Any column spreads over all tasks, whatever
    its values begin with.
    """
    levels = df.select(tall(columns, cast="string")).where("value IS NOT NULL").distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(levels.repartitionByRange(parts, "feature", "value").withColumn(
        "slice", F.spark_partition_id()), "levels")
    before = placed.groupBy("feature", "slice").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("feature").orderBy("slice")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("feature", "slice").orderBy("value"))
    return placed.withColumn("inside", inside).join(before, ["feature", "slice"]).select(
        "feature", "value", (F.col("before") + F.col("inside") - 1).cast("int").alias("code"))


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each text value becomes its position in sorted order; null becomes 0.

    Columns of at most ``FEW`` values are looked up inside the projection; only columns with
    more values are joined with their codes.
    """
    codes = level_codes(df, columns)
    listed: dict[str, list[tuple[str, int]]] = {c: [] for c in columns}
    for r in codes.where(F.col("code") <= FEW).collect():  # FEW + 1 rows a column at most
        listed[r.feature].append((r.value, r.code))
    many = [c for c in columns if len(listed[c]) > FEW]
    out, chosen = df, {}
    if many:
        codes = materialise(codes.where(F.col("feature").isin(many)), "codes")
    for column in columns:
        if column in many:
            one = codes.where(F.col("feature") == column).select(
                F.col("value").alias(column), F.col("code").alias(f"{column}__code"))
            out = out.join(one, column, "left")
            chosen[column] = F.coalesce(F.col(f"{column}__code"), F.lit(0))
        else:
            # The first value has code 0, which missing ones share.
            code = None
            for value, at in sorted(listed[column], key=lambda x: x[1])[1:]:
                same = F.col(column).cast("string") == F.lit(value)
                code = F.when(same, at) if code is None else code.when(same, at)
            chosen[column] = F.lit(0) if code is None else code.otherwise(0)
    return out.select(*[chosen[c].cast("int").alias(c) if c in chosen else F.col(c) for c in df.columns])


def _levels(df: DataFrame, columns: Sequence[str]) -> list[list[str]]:
    """Sorted levels per column, for outputs that have a column per level; counted before any is fetched."""
    found = materialise(df.select(tall(columns, cast="string")).where("value IS NOT NULL").distinct(), "levels")
    for r in found.groupBy("feature").count().where(F.col("count") > MOST_COLUMNS).collect():
        raise ValueError(f"{r.feature} has {r['count']} levels, too many for a column each")
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for r in found.orderBy("feature", "value").collect():
        levels[r.feature].append(r.value)
    return [levels[c] for c in columns]


def one_hot_stages(columns: Sequence[str]) -> list:
    """Indexer and encoder; the slot an unseen value would take is the one that is dropped."""
    indexed, hot = [f"{c}__index" for c in columns], [f"{c}__hot" for c in columns]
    return [
        StringIndexer(inputCols=list(columns), outputCols=indexed,
                      stringOrderType="alphabetAsc", handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
    ]


def one_hot(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """0/1 columns named ``column=value``; a value unseen in ``fit_on`` gets all zeros.

    Uses the indexer's levels directly: readable columns are wanted here, not a vector.
    """
    flags = {
        f"{c}={level}": F.col(c).eqNullSafe(F.lit(level)).cast("int")
        for c, levels in zip(columns, _levels(fit_on or df, columns)) for level in levels
    }
    return df.withColumns(flags)


def dummies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One 0/1 column per level except the first level in sorted order."""
    return df.withColumns({
        f"{c}={level}": F.col(c).eqNullSafe(F.lit(level)).cast("int")
        for c, levels in zip(columns, _levels(df, columns)) for level in levels[1:]
    })


@dataclass(frozen=True)
class Scaler:
    """Fitted means and population deviations, applied as a plain projection."""

    means: dict[str, float]
    deviations: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> "Scaler":
        row = df.agg(*[F.avg(c).alias(f"{c}__m") for c in columns],
                     *[F.stddev_pop(c).alias(f"{c}__s") for c in columns]).first()
        return cls({c: row[f"{c}__m"] for c in columns}, {c: row[f"{c}__s"] for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        """A column without spread is only centred."""
        return df.withColumns({
            c: (F.col(c) - F.lit(m)) / F.lit(self.deviations[c] or 1.0)
            for c, m in self.means.items()
        })


class PopulationScaler(Estimator):
    """Pipeline stage that fits a ``Scaler``; the fitted stage is a plain, savable projection.

    Spark's own scaler divides by the sample deviation; here the population deviation is wanted.
    """

    def __init__(self, columns: Sequence[str]):
        super().__init__()
        self.columns = list(columns)

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        scaler = Scaler.fit(dataset, self.columns)
        scaled = ", ".join(
            f"(`{c}` - {m!r}D) / {scaler.deviations[c] or 1.0!r}D AS `{c}__scaled`"
            for c, m in scaler.means.items())
        return SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")


def routed_stages(
    categorical: Sequence[str] = K.CATEGORICAL,
    numeric: Sequence[str] = K.NUMERIC,
    binary: Sequence[str] = K.BINARY,
    output: str = "features",
) -> list:
    """Stages from engineered rows to the model vector: one-hot, scaled numerics, flags."""
    stages, parts = [], []
    if categorical:
        stages += one_hot_stages(categorical)
        parts += [f"{c}__hot" for c in categorical]
    if numeric:
        stages.append(PopulationScaler(numeric))
        parts += [f"{c}__scaled" for c in numeric]
    parts += list(binary)
    stages.append(VectorAssembler(inputCols=parts, outputCol=output, handleInvalid="keep"))
    return stages


def encode(df: DataFrame, **routes: Sequence[str]) -> tuple[DataFrame, PipelineModel]:
    """Routed vector beside the key and label; every unrouted column is dropped."""
    model = Pipeline(stages=routed_stages(**routes)).fit(df)
    kept = [c for c in ("customerID", "label") if c in df.columns]
    return model.transform(df).select(*kept, "features"), model


def vector_names(df: DataFrame, column: str = "features") -> list[str]:
    """Slot names from the vector's metadata, in slot order."""
    attributes = df.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    slots = [a for group in attributes.values() for a in group]
    return [a.get("name", str(a["idx"])) for a in sorted(slots, key=lambda a: a["idx"])]


def vector_size(df: DataFrame, column: str = "features") -> int:
    return df.schema[column].metadata["ml_attr"]["num_attrs"]


def as_array(column: str = "features"):
    return vector_to_array(F.col(column))
