"""The 28 stateless features, as Column expressions in two projections."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewatch import constants as K
from lapsewatch.functions.scalars import differs, equals, truth
from lapsewatch.operators.quality import require_columns

REQUIRED = [
    "tenure", "MonthlyCharges", "TotalCharges", "Contract", "PhoneService", "MultipleLines",
    "InternetService", *K.ADD_ONS, "Partner", "Dependents", "SeniorCitizen", "PaymentMethod",
    "PaperlessBilling",
]
STREAMS = ["StreamingTV", "StreamingMovies"]
SECURITY = ["OnlineSecurity", "OnlineBackup", "DeviceProtection"]


def _count(*flags: Column) -> Column:
    return reduce(add, flags)


def _subscribed(columns: list[str]) -> Column:
    return _count(*[equals(c, "Yes") for c in columns])


def tenure_group(tenure: Column) -> Column:
    """Right-closed tenure bands; anything outside (-1, inf) is the text "nan"."""
    return (
        F.when(tenure.isNull() | (tenure <= -1), "nan")
        .when(tenure <= 6, "0-6m").when(tenure <= 12, "7-12m")
        .when(tenure <= 24, "13-24m").when(tenure <= 48, "25-48m").otherwise("49m+")
    )


def charge_bin(charge: Column) -> Column:
    return (
        F.when(charge.isNull(), "nan").when(charge <= 35, "Low").when(charge <= 70, "Medium")
        .otherwise("High")
    )


def base_features() -> dict[str, Column]:
    """Features that read only table columns."""
    monthly, tenure = F.col("MonthlyCharges"), F.col("tenure")
    one_year = F.when(F.col("Contract") == "One year", 1)
    return {
        "tenure_group": tenure_group(tenure),
        "is_month_to_month": equals("Contract", "Month-to-month"),
        "service_adoption_count": _count(
            _subscribed(["PhoneService", "MultipleLines", *K.ADD_ONS]),
            differs("InternetService", "No")),
        "has_protection_bundle": equals("TechSupport", "Yes") * equals("OnlineSecurity", "Yes"),
        # A tenure of -1 breaks the rules; floating-point division would give infinity here.
        "charge_to_tenure_ratio": F.when(tenure == -1, F.lit(float("inf")))
        .otherwise(monthly / (tenure + 1)),
        "is_fiber_optic": equals("InternetService", "Fiber optic"),
        "has_family": F.greatest(equals("Partner", "Yes"), equals("Dependents", "Yes")),
        "is_isolated": differs("Partner", "Yes") * differs("Dependents", "Yes"),
        "senior_no_support":
            truth(F.col("SeniorCitizen").cast("string") == "1") * differs("TechSupport", "Yes"),
        "is_auto_pay": truth(F.col("PaymentMethod").isin(K.AUTOMATIC_PAYMENTS)),
        "is_electronic_check": equals("PaymentMethod", "Electronic check"),
        "is_high_monthly_charge": truth(monthly > 70),
        "monthly_charge_bin": charge_bin(monthly),
        "charges_gap": F.col("TotalCharges") - monthly * tenure,
        "has_internet": differs("InternetService", "No"),
        "streaming_count": _subscribed(STREAMS),
        "security_service_count": _subscribed(SECURITY),
        "has_full_streaming": reduce(lambda a, b: a * b, [equals(c, "Yes") for c in STREAMS]),
        "internet_addon_count": _subscribed(K.ADD_ONS),
        "contract_numeric": F.coalesce(
            one_year, F.when(F.col("Contract") == "Two year", 2), F.lit(0)),
        "new_high_value_customer": truth((tenure <= 6) & (monthly > 70)),
        "paperless_and_echeck":
            equals("PaperlessBilling", "Yes") * equals("PaymentMethod", "Electronic check"),
    }


def derived_features() -> dict[str, Column]:
    """Features that read base features."""
    c = F.col
    return {
        "avg_charge_per_service": c("MonthlyCharges") / (c("service_adoption_count") + 1),
        "has_no_internet_addons": c("has_internet") * (c("internet_addon_count") == 0).cast("int"),
        "is_committed_customer": (c("contract_numeric") > 0).cast("int"),
        "m2m_and_fiber": c("is_month_to_month") * c("is_fiber_optic"),
        "fiber_no_security": c("is_fiber_optic") * differs("OnlineSecurity", "Yes"),
    }


def engineer(df: DataFrame) -> DataFrame:
    """All 28 features beside the input columns; same rows, input untouched."""
    require_columns(df, REQUIRED)
    risk = _count(*[F.col(f) for f in (
        "is_month_to_month", "is_fiber_optic", "is_electronic_check", "is_isolated",
        "is_high_monthly_charge", "has_no_internet_addons")], 1 - F.col("has_protection_bundle"))
    return (
        df.withColumns(base_features())
        .withColumns(derived_features())
        .withColumn("composite_churn_risk", risk)
    )


def feature_routes(spark: SparkSession) -> DataFrame:
    """Which encoding each model input takes."""
    rows = [(f, r) for r, names in (("categorical", K.CATEGORICAL), ("numerical", K.NUMERIC),
                                    ("binary", K.BINARY)) for f in names]
    return spark.createDataFrame(rows, "feature string, route string")
