"""The given tables and the deterministic views over them that stand in for customer data."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One text for Spark and the SQL check, so both start from identical rows.
SUBSCRIBERS_SQL = """
WITH k AS (
  SELECT o_orderkey, o_custkey, o_orderdate,
         CAST(FLOOR(o_totalprice) AS BIGINT) AS p,
         YEAR(o_orderdate) * 12 + MONTH(o_orderdate) AS m
  FROM {orders}
), b AS (
  SELECT *,
    CASE WHEN p % 101 = 0 THEN 0 ELSE CAST(m % 73 AS INT) END AS tenure,
    CASE WHEN p % 100 < 22 THEN 'No' WHEN p % 100 < 66 THEN 'Fiber optic' ELSE 'DSL' END AS inet,
    CASE WHEN o_custkey % 20 < 11 THEN 'Month-to-month'
         WHEN o_custkey % 20 < 15 THEN 'One year' ELSE 'Two year' END AS contract,
    1825 + p % 10050 AS cents,
    (o_orderkey * 7919 + o_custkey * 104729 + p * 31) % 1000 AS h
  FROM k
)
SELECT CAST(o_orderkey AS VARCHAR(20)) AS customerID,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
  CAST(CASE WHEN o_custkey % 6 = 0 THEN 1 ELSE 0 END AS INT) AS SeniorCitizen,
  CASE WHEN p % 2 = 0 THEN 'Yes' ELSE 'No' END AS Partner,
  CASE WHEN (p + o_custkey) % 10 < 3 THEN 'Yes' ELSE 'No' END AS Dependents,
  tenure,
  CASE WHEN o_orderkey % 10 = 0 THEN 'No' ELSE 'Yes' END AS PhoneService,
  CASE WHEN o_orderkey % 10 = 0 THEN 'No phone service'
       WHEN p % 9 < 4 THEN 'Yes' ELSE 'No' END AS MultipleLines,
  inet AS InternetService,
  CASE WHEN inet = 'No' THEN 'No internet service'
       WHEN h % 7 < 2 THEN 'Yes' ELSE 'No' END AS OnlineSecurity,
  CASE WHEN inet = 'No' THEN 'No internet service'
       WHEN h % 11 < 4 THEN 'Yes' ELSE 'No' END AS OnlineBackup,
  CASE WHEN inet = 'No' THEN 'No internet service'
       WHEN h % 13 < 5 THEN 'Yes' ELSE 'No' END AS DeviceProtection,
  CASE WHEN inet = 'No' THEN 'No internet service'
       WHEN h % 17 < 5 THEN 'Yes' ELSE 'No' END AS TechSupport,
  CASE WHEN inet = 'No' THEN 'No internet service'
       WHEN h % 19 < 8 THEN 'Yes' ELSE 'No' END AS StreamingTV,
  CASE WHEN inet = 'No' THEN 'No internet service'
       WHEN h % 23 < 10 THEN 'Yes' ELSE 'No' END AS StreamingMovies,
  contract AS Contract,
  CASE WHEN (o_custkey + o_orderkey) % 5 < 3 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
  CASE (p + o_orderkey) % 4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check'
       WHEN 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS PaymentMethod,
  CAST(cents AS DOUBLE) / CAST(100 AS DOUBLE) AS MonthlyCharges,
  CASE WHEN tenure = 0 THEN ' '
       ELSE CAST(CAST(FLOOR(CAST(cents * tenure AS DOUBLE) / CAST(100 AS DOUBLE)) AS BIGINT)
                 + h % 90 - 15 AS VARCHAR(20))
  END AS TotalCharges,
  CASE WHEN h < 10
            + CASE contract WHEN 'Month-to-month' THEN 200 WHEN 'One year' THEN 60 ELSE 0 END
            + CASE inet WHEN 'Fiber optic' THEN 140 WHEN 'DSL' THEN 40 ELSE 0 END
            + CASE WHEN tenure <= 12 THEN 150 ELSE 0 END THEN 'Yes' ELSE 'No' END AS Churn{extra}
FROM b
"""

# The scorecards: label and a deterministic probability per customer. Each scorecard stands in
# for a trained model where a result must be checked value by value.
SCORECARDS_SQL = """
SELECT customerID, gender, SeniorCitizen, tenure, Contract, InternetService, MonthlyCharges,
  CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS label,
  CAST(10 + contract_points + internet_points + tenure_points + noise AS DOUBLE)
    / CAST(1000 AS DOUBLE) AS prob,
  CAST(10 + contract_points + noise AS DOUBLE) / CAST(1000 AS DOUBLE) AS contract_prob,
  CAST(10 + internet_points + noise AS DOUBLE) / CAST(1000 AS DOUBLE) AS internet_prob,
  CAST(10 + tenure_points + noise AS DOUBLE) / CAST(1000 AS DOUBLE) AS tenure_prob,
  CAST(10 + noise AS DOUBLE) / CAST(1000 AS DOUBLE) AS dummy_prob
FROM (
  SELECT *,
    CASE Contract WHEN 'Month-to-month' THEN 200 WHEN 'One year' THEN 60 ELSE 0 END
      AS contract_points,
    CASE InternetService WHEN 'Fiber optic' THEN 140 WHEN 'DSL' THEN 40 ELSE 0 END
      AS internet_points,
    CASE WHEN tenure <= 12 THEN 150 ELSE 0 END AS tenure_points,
    CAST(customerID AS BIGINT) % 400 AS noise
  FROM {subscribers}
)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables; instants are read as session-zone timestamps."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return _instants(df)


def table_stream(
    spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None
) -> DataFrame:
    """The same table as a file stream."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _instants(reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir))


def _instants(df: DataFrame) -> DataFrame:
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df


def subscribers(spark: SparkSession, sf_dir: str, with_date: bool = False) -> DataFrame:
    """The 21-column customer table; ``with_date`` adds the sign-up instant."""
    return subscribers_of(table(spark, sf_dir, "orders"), with_date)


def subscribers_of(orders: DataFrame, with_date: bool = False) -> DataFrame:
    """Customer rows of an orders table or stream."""
    extra = ", o_orderdate AS signed_up" if with_date else ""
    return orders.sparkSession.sql(SUBSCRIBERS_SQL.replace("{extra}", extra), orders=orders)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and scorecard probabilities for every customer."""
    return spark.sql(SCORECARDS_SQL, subscribers=subscribers(spark, sf_dir))


def dirty_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer table with injected rule violations."""
    return dirtied(subscribers(spark, sf_dir))


def dirtied(customers: DataFrame) -> DataFrame:
    key = F.col("customerID").cast("bigint") % 388
    return customers.withColumns({
        "gender": F.when(key == 0, "X").otherwise(F.col("gender")),
        "tenure": F.when(key == 97, -1).otherwise(F.col("tenure")),
        "MonthlyCharges": F.when(key == 194, 0.0).otherwise(F.col("MonthlyCharges")),
        "Contract": F.when(key == 291, None).otherwise(F.col("Contract")),
    })


def prediction_log(events: DataFrame) -> DataFrame:
    """Served predictions, one row per request; works on a table and on a stream."""
    kind, value, key = F.col("event_type"), F.col("value"), F.col("event_id")
    return events.select(
        key.alias("request_id"),
        "ts",
        F.col("user_id").alias("customer"),
        F.when(kind == "view", "predict").when(kind == "click", "predict_batch")
        .otherwise("predict_online").alias("endpoint"),
        F.when(kind == "error", 1).otherwise(0).alias("is_error"),
        (F.least(value, F.lit(500.0)) / 500.0).alias("prob"),
        ((key % 100).cast("double") / 100.0).alias("latency_s"),
    )
