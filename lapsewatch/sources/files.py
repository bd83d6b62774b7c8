"""File sources and sinks: CSV intake, drift snapshots, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewatch import constants as K
from lapsewatch.operators.quality import require_columns, trim_strings


def load_raw(spark: SparkSession, path: str, schema: str = K.RAW_SCHEMA) -> DataFrame:
    """CSV with header under a declared schema, text trimmed; a missing or empty file is an error.

    The header is checked against the schema, so a reordered file cannot shift columns silently.
    """
    try:
        df = (
            spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    except AnalysisException as error:
        raise FileNotFoundError(f"no customer file at {path}") from error
    if df.isEmpty():
        raise ValueError(f"customer file {path} has no rows")
    return trim_strings(df)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").option("header", True) \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False) \
        .csv(path)
    return path


def write_ranked_csv(df: DataFrame, path: str, by: str) -> str:
    """CSV parts in descending order of ``by``: part order is the global order."""
    return write_csv(df.orderBy(F.desc(by)), path)


def write_report(df: DataFrame, path: str) -> str:
    """One JSON object per finding."""
    df.write.mode("errorifexists").json(path)
    return path


def save_snapshot(df: DataFrame, path: str, prob: str | None = None,
                  model_version: str = "unversioned") -> str:
    """Reference rows (probability kept as a column) plus one row of metadata."""
    df.write.mode("errorifexists").parquet(f"{path}/rows")
    snapshot_metadata(df, prob, model_version).write.json(f"{path}/metadata")
    return path


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{path}/rows")
    except AnalysisException as error:
        raise FileNotFoundError(f"no snapshot at {path}") from error


def snapshot_metadata(df: DataFrame, prob: str | None = None,
                      model_version: str = "unversioned", label: str = "label") -> DataFrame:
    """Row and feature counts, names, churn rate and mean prediction, creation time."""
    features = [c for c in df.columns if c not in (prob, label)]

    def mean(column: str | None):
        if column in df.columns:
            return F.round(F.avg(F.col(column).cast("double")), 4)
        return F.lit(None).cast("double")

    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(features)).alias("n_features"),
        F.lit(",".join(features)).alias("feature_names"),
        mean(label).alias("churn_rate"),
        mean(prob).alias("mean_prediction"),
        F.lit(model_version).alias("model_version"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )


METADATA_SCHEMA = (
    "n_rows bigint, n_features int, feature_names string, churn_rate double, "
    "mean_prediction double, model_version string, created_at string"
)


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).json(f"{path}/metadata")


def offline_features(raw: DataFrame, at: str) -> DataFrame:
    """Feature-table rows: an event time and numeric totals, blanks as 0 (not the monthly charge)."""
    total = F.coalesce(F.nullif(F.trim("TotalCharges"), F.lit("")).try_cast("double"), F.lit(0.0))
    return raw.withColumns({"TotalCharges": total, "event_timestamp": F.lit(at).cast("timestamp")})


def batch_intake(df: DataFrame, required: Sequence[str] = K.REQUEST_COLUMNS) -> DataFrame:
    """All request rows, after a check of the 19 columns."""
    return require_columns(df, required)
