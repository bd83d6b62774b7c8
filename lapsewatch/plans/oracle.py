"""SQL views used by the checks: the same tables and features, stated independently in SQL."""

from __future__ import annotations

from lapsewatch import constants as K
from lapsewatch.sources.tables import SCORECARDS_SQL, SUBSCRIBERS_SQL


def _count_yes(columns: list[str]) -> str:
    return " + ".join(f"CAST({c} = 'Yes' AS INT)" for c in columns)


FEATURES_SQL = f"""
SELECT *,
  MonthlyCharges / (service_adoption_count + 1) AS avg_charge_per_service,
  CAST(has_internet = 1 AND internet_addon_count = 0 AS INT) AS has_no_internet_addons,
  CAST(contract_numeric > 0 AS INT) AS is_committed_customer,
  CAST(is_month_to_month = 1 AND is_fiber_optic = 1 AS INT) AS m2m_and_fiber,
  CAST(is_fiber_optic = 1 AND OnlineSecurity <> 'Yes' AS INT) AS fiber_no_security,
  is_month_to_month + is_fiber_optic + is_electronic_check + (1 - has_protection_bundle)
    + is_isolated + is_high_monthly_charge
    + CAST(has_internet = 1 AND internet_addon_count = 0 AS INT) AS composite_churn_risk
FROM (
  SELECT *,
    CASE WHEN tenure <= -1 THEN 'nan' WHEN tenure <= 6 THEN '0-6m' WHEN tenure <= 12 THEN '7-12m'
         WHEN tenure <= 24 THEN '13-24m' WHEN tenure <= 48 THEN '25-48m' ELSE '49m+' END
      AS tenure_group,
    CAST(Contract = 'Month-to-month' AS INT) AS is_month_to_month,
    {_count_yes(["PhoneService", "MultipleLines", *K.ADD_ONS])}
      + CAST(InternetService <> 'No' AS INT) AS service_adoption_count,
    CAST(TechSupport = 'Yes' AND OnlineSecurity = 'Yes' AS INT) AS has_protection_bundle,
    MonthlyCharges / (tenure + 1) AS charge_to_tenure_ratio,
    CAST(InternetService = 'Fiber optic' AS INT) AS is_fiber_optic,
    CAST(Partner = 'Yes' OR Dependents = 'Yes' AS INT) AS has_family,
    CAST(Partner <> 'Yes' AND Dependents <> 'Yes' AS INT) AS is_isolated,
    CAST(SeniorCitizen = '1' AND TechSupport <> 'Yes' AS INT) AS senior_no_support,
    CAST(PaymentMethod LIKE '%(automatic)' AS INT) AS is_auto_pay,
    CAST(PaymentMethod = 'Electronic check' AS INT) AS is_electronic_check,
    CAST(MonthlyCharges > 70 AS INT) AS is_high_monthly_charge,
    CASE WHEN MonthlyCharges <= 35 THEN 'Low' WHEN MonthlyCharges <= 70 THEN 'Medium'
         ELSE 'High' END AS monthly_charge_bin,
    TotalCharges - MonthlyCharges * tenure AS charges_gap,
    CAST(InternetService <> 'No' AS INT) AS has_internet,
    {_count_yes(["StreamingTV", "StreamingMovies"])} AS streaming_count,
    {_count_yes(["OnlineSecurity", "OnlineBackup", "DeviceProtection"])}
      AS security_service_count,
    CAST(StreamingTV = 'Yes' AND StreamingMovies = 'Yes' AS INT) AS has_full_streaming,
    {_count_yes(K.ADD_ONS)} AS internet_addon_count,
    CASE Contract WHEN 'One year' THEN 1 WHEN 'Two year' THEN 2 ELSE 0 END AS contract_numeric,
    CAST(tenure <= 6 AND MonthlyCharges > 70 AS INT) AS new_high_value_customer,
    CAST(PaperlessBilling = 'Yes' AND PaymentMethod = 'Electronic check' AS INT)
      AS paperless_and_echeck
  FROM clean)
"""

# Injected dirt: a bad gender, a negative tenure, a zero charge, a missing contract.
DIRTY_SQL = """
SELECT * REPLACE (
  CASE WHEN CAST(customerID AS BIGINT) % 388 = 0 THEN 'X' ELSE gender END AS gender,
  CASE WHEN CAST(customerID AS BIGINT) % 388 = 97 THEN -1 ELSE tenure END AS tenure,
  CASE WHEN CAST(customerID AS BIGINT) % 388 = 194 THEN CAST(0 AS DOUBLE)
       ELSE MonthlyCharges END AS MonthlyCharges,
  CASE WHEN CAST(customerID AS BIGINT) % 388 = 291 THEN NULL ELSE Contract END AS Contract)
FROM subscribers
"""

REPAIRED = "COALESCE(TRY_CAST(NULLIF(TRIM(TotalCharges), '') AS DOUBLE), MonthlyCharges)"

PREDICTION_LOG_SQL = """
SELECT event_id AS request_id, ts, user_id AS customer,
  CASE event_type WHEN 'view' THEN 'predict' WHEN 'click' THEN 'predict_batch'
       ELSE 'predict_online' END AS endpoint,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_error,
  least(value, CAST(500 AS DOUBLE)) / CAST(500 AS DOUBLE) AS prob,
  CAST(event_id % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS latency_s
FROM events
"""

# name -> (views it reads, text)
VIEWS: dict[str, tuple[list[str], str]] = {
    "subscribers": ([], SUBSCRIBERS_SQL.format(orders="orders", extra="")),
    "dated": ([], SUBSCRIBERS_SQL.format(orders="orders", extra=", o_orderdate AS signed_up")),
    "scored": (["subscribers"], SCORECARDS_SQL.format(subscribers="subscribers")),
    "dirty": (["subscribers"], DIRTY_SQL),
    "dirty_repaired": (["dirty"],
                       f"SELECT * REPLACE ({REPAIRED} AS TotalCharges) FROM dirty"),
    "clean": (["subscribers"], f"""
        SELECT * EXCLUDE (Churn, SeniorCitizen, TotalCharges),
          CAST(SeniorCitizen AS VARCHAR) AS SeniorCitizen, {REPAIRED} AS TotalCharges,
          CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS label
        FROM subscribers"""),
    "features": (["clean"], FEATURES_SQL),
    "log": ([], PREDICTION_LOG_SQL),
}


def _ordered(names: list[str]) -> list[str]:
    found: list[str] = []
    for name in names:
        for needed in [*_ordered(VIEWS[name][0]), name]:
            if needed not in found:
                found.append(needed)
    return found


def check(body: str, *views: str) -> str:
    """``body`` over the named views; the body may open with its own WITH."""
    if not views:
        return body
    texts = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in _ordered(list(views)))
    return f"WITH {texts} SELECT * FROM ({body}) q"


def tall(columns: list[str], view: str = "features", keep: str = "customerID, label",
         cast: str = "DOUBLE", name: str = "feature", value: str = "value") -> str:
    """(name, value) rows of the listed columns, as a SQL subquery."""
    names = ", ".join(f"'{c}'" for c in columns)
    values = ", ".join(f"CAST({c} AS {cast})" for c in columns)
    return (f"SELECT {keep}, UNNEST([{names}]) AS {name}, UNNEST([{values}]) AS {value} "
            f"FROM {view}")
