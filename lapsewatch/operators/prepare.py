"""From validated rows to model rows: label, types, columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewatch.operators.quality import repair_total_charges, trim_strings


def encode_target(df: DataFrame, target: str = "Churn", label: str = "label") -> DataFrame:
    """Yes -> 1, No -> 0; any other value is an error; without the target nothing happens."""
    if target not in df.columns:
        return df
    value = F.col(target)
    wrong = F.raise_error(F.concat(F.lit(f"unexpected {target}: "),
                                   F.coalesce(value, F.lit("null")))).cast("int")
    return df.withColumn(label, F.when(value == "Yes", 1).when(value == "No", 0).otherwise(wrong))


def senior_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("SeniorCitizen", F.col("SeniorCitizen").cast("string"))


def drop_columns(df: DataFrame, columns: Sequence[str] = ("customerID",)) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def feature_target_split(df: DataFrame, target: str = "Churn") -> tuple[DataFrame, list[str]]:
    """Rows with a 0/1 ``label`` and the list of feature columns; the target must be there.

    The rows stay in one DataFrame: label and features are never separated and re-aligned.
    """
    if target not in df.columns:
        raise ValueError(f"target column {target} is missing")
    labelled = encode_target(df, target)
    return labelled.drop(target), [c for c in df.columns if c != target]


def clean(df: DataFrame, keep_key: bool = True) -> DataFrame:
    """Trim, repair totals, encode the target, cast the senior flag."""
    ready = senior_as_text(encode_target(repair_total_charges(trim_strings(df))))
    ready = ready.drop("Churn")
    return ready if keep_key else drop_columns(ready)
