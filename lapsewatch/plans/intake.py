"""Queries for sources, sinks, validation, preparation and features (S, V, P, F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewatch import constants as K
from lapsewatch.functions.scalars import named
from lapsewatch.operators import features, prepare, quality
from lapsewatch.plans.oracle import REPAIRED, check
from lapsewatch.plans.registry import query
from lapsewatch.session import scratch_path
from lapsewatch.sources import files
from lapsewatch.sources.tables import dirty_subscribers, scored, subscribers

FEATURE_TIME = "2024-01-01 00:00:00"


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean customers with all 28 features, key and label."""
    return features.engineer(prepare.clean(subscribers(spark, sf_dir)))


# ---- sources and sinks -------------------------------------------------------------------

TRIMMED = "* REPLACE (TRIM(TotalCharges) AS TotalCharges)"


@query("s01_load_raw", check(f"SELECT {TRIMMED} FROM subscribers", "subscribers"))
def s01(spark, sf_dir):
    path = files.write_csv(subscribers(spark, sf_dir), scratch_path(spark, "raw-csv"))
    return files.load_raw(spark, path).withColumn(
        "TotalCharges", F.coalesce("TotalCharges", F.lit("")))


@query("s02_trim_strings", check(f"SELECT {TRIMMED} FROM subscribers", "subscribers"))
def s02(spark, sf_dir):
    padded = subscribers(spark, sf_dir).withColumn("gender", F.concat(F.lit("  "), "gender"))
    return quality.trim_strings(padded)


def _snapshot(spark: SparkSession, sf_dir: str) -> str:
    rows = scored(spark, sf_dir).select("customerID", "tenure", "Contract", "label", "prob")
    return files.save_snapshot(rows, scratch_path(spark, "snapshot"), prob="prob",
                               model_version="scorecard-1")


@query("s03_save_snapshot", check("""
    SELECT COUNT(*) AS n_rows, SUM(tenure)::BIGINT AS tenure_sum, ROUND(SUM(prob), 6) AS prob_sum,
      COUNT(DISTINCT Contract) AS contracts FROM scored""", "scored"))
def s03(spark, sf_dir):
    return spark.read.parquet(f"{_snapshot(spark, sf_dir)}/rows").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("tenure").alias("tenure_sum"),
        named(F.sum("prob"), "prob_sum", 6), F.count_distinct("Contract").alias("contracts"))


@query("s04_load_snapshot",
       check("SELECT customerID, tenure, Contract, label, prob FROM scored", "scored"))
def s04(spark, sf_dir):
    return files.load_snapshot(spark, _snapshot(spark, sf_dir))


@query("s05_snapshot_metadata", check("""
    SELECT COUNT(*) AS n_rows, 3 AS n_features, 'customerID,tenure,Contract' AS feature_names,
      ROUND(AVG(label), 4) AS churn_rate, ROUND(AVG(prob), 4) AS mean_prediction,
      'scorecard-1' AS model_version FROM scored""", "scored"))
def s05(spark, sf_dir):
    return files.load_metadata(spark, _snapshot(spark, sf_dir)).drop("created_at")


@query("s06_offline_features", check(f"""
    SELECT * REPLACE (COALESCE(TRY_CAST(NULLIF(TRIM(TotalCharges), '') AS DOUBLE), 0.0)
      AS TotalCharges), '{FEATURE_TIME}' AS event_timestamp FROM subscribers""", "subscribers"))
def s06(spark, sf_dir):
    path = scratch_path(spark, "feature-table")
    files.offline_features(subscribers(spark, sf_dir), FEATURE_TIME).write.parquet(path)
    return spark.read.parquet(path).withColumn(
        "event_timestamp", F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss"))


@query("s08_ranked_csv", check("SELECT customerID, label, prob FROM scored", "scored"))
def s08(spark, sf_dir):
    ranked = scored(spark, sf_dir).select("customerID", "label", "prob")
    path = files.write_ranked_csv(ranked, scratch_path(spark, "ranked"), "prob")
    return spark.read.schema(ranked.schema).option("header", True).csv(path)


@query("s10_batch_intake", check(
    f"SELECT {', '.join(K.REQUEST_COLUMNS)}, customerID FROM subscribers", "subscribers"))
def s10(spark, sf_dir):
    return files.batch_intake(subscribers(spark, sf_dir).drop("Churn"))


# ---- cleaning and validation -------------------------------------------------------------

@query("v01_repair_total_charges", check(
    f"SELECT customerID, ROUND({REPAIRED}, 6) AS TotalCharges FROM subscribers", "subscribers"))
def v01(spark, sf_dir):
    fixed = quality.repair_total_charges(subscribers(spark, sf_dir))
    return fixed.select("customerID", named(F.col("TotalCharges"), "TotalCharges", 6))


def _failing(columns: list[str]) -> list[tuple[str, str, str]]:
    """(column, rule, SQL condition of failure) for the checks, written out in SQL."""
    special = {
        "SeniorCitizen": ("allowed", "SeniorCitizen NOT IN (0, 1)"),
        "tenure": ("range", "tenure < 0 OR tenure > 100"),
        "MonthlyCharges": ("positive", "MonthlyCharges <= 0"),
        "TotalCharges": ("not_negative", "TotalCharges < 0"),
        "Churn": ("allowed", "Churn NOT IN ('Yes', 'No')"),
    }
    out = []
    for c in columns:
        out.append((c, "not_null", f"{c} IS NULL"))
        if c in K.DOMAINS:
            allowed = ", ".join(f"'{v}'" for v in K.DOMAINS[c])
            out.append((c, "allowed", f"{c} NOT IN ({allowed})"))
        elif c in special:
            out.append((c, *special[c]))
    return out


def _counts_sql(columns: list[str]) -> str:
    return check(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{r}' AS rule, "
        f"COUNT(*) FILTER (WHERE {bad}) AS violations FROM dirty_repaired"
        for c, r, bad in _failing(columns)), "dirty_repaired")


def _cases_sql(columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT customerID, '{c}' AS column_name, '{r}' AS rule, "
        f"CAST({c} AS VARCHAR) AS failure_case FROM dirty_repaired WHERE {bad}"
        for c, r, bad in _failing(columns))


def dirty_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repair_total_charges(dirty_subscribers(spark, sf_dir))


@query("v02_raw_rule_counts", _counts_sql(K.RAW_COLUMNS))
def v02(spark, sf_dir):
    return quality.violation_counts(dirty_repaired(spark, sf_dir), K.RAW_COLUMNS)


@query("v03_request_rule_counts", _counts_sql(K.REQUEST_COLUMNS))
def v03(spark, sf_dir):
    return quality.violation_counts(dirty_repaired(spark, sf_dir), K.REQUEST_COLUMNS)


@query("v04_failure_cases", check(_cases_sql(K.RAW_COLUMNS), "dirty_repaired"))
def v04(spark, sf_dir):
    return quality.failure_cases(dirty_repaired(spark, sf_dir), K.RAW_COLUMNS)


@query("v04_validation_summary", check(f"""
    SELECT (SELECT COUNT(*) = 0 FROM ({_cases_sql(K.RAW_COLUMNS)})) AS is_valid,
      (SELECT COUNT(*) FROM dirty_repaired) AS row_count, 21 AS column_count,
      (SELECT COUNT(*) FROM ({_cases_sql(K.RAW_COLUMNS)})) AS failure_count""", "dirty_repaired"))
def v04_summary(spark, sf_dir):
    return quality.validation_summary(dirty_repaired(spark, sf_dir), K.RAW_COLUMNS)


@query("v05_implausible_total", check("""
    SELECT customerID, tenure > 0 AND TotalCharges > MonthlyCharges * (tenure + 1) * 1.5::DOUBLE
      AS implausible FROM clean""", "clean"))
def v05(spark, sf_dir):
    repaired = quality.repair_total_charges(subscribers(spark, sf_dir))
    return repaired.select("customerID", quality.implausible_total().alias("implausible"))


@query("v06_blank_total_audit", check("""
    SELECT COUNT(*) FILTER (WHERE TRIM(TotalCharges) = '') AS blank_totals,
      COUNT(*) FILTER (WHERE TRIM(TotalCharges) = '' AND tenure <> 0) = 0
        AS all_blank_at_zero_tenure FROM subscribers""", "subscribers"))
def v06(spark, sf_dir):
    return quality.blank_total_audit(subscribers(spark, sf_dir))


@query("v07_contract_checks", check("""
    SELECT COUNT(*) > 0 AS row_count_ok, TRUE AS column_count_ok,
      AVG((Churn = 'Yes')::INT) > 0.20::DOUBLE AND AVG((Churn = 'Yes')::INT) < 0.28::DOUBLE
        AS churn_rate_ok,
      MIN(tenure) >= 0 AND MAX(tenure) <= 100 AS tenure_ok,
      COUNT(*) FILTER (WHERE customerID IS NULL OR tenure IS NULL OR MonthlyCharges IS NULL
        OR Contract IS NULL OR Churn IS NULL) = 0 AS no_nulls_ok
    FROM subscribers""", "subscribers"))
def v07(spark, sf_dir):
    return quality.contract_checks(subscribers(spark, sf_dir), churn_between=(0.20, 0.28))


@query("v08_valid_and_rejected", check(f"""
    SELECT d.customerID, COALESCE(r.reasons, '') AS reasons,
      CASE WHEN r.reasons IS NULL THEN 'valid' ELSE 'rejected' END AS status
    FROM dirty_repaired d LEFT JOIN (
      SELECT customerID, STRING_AGG(column_name || ':' || rule, ',' ORDER BY column_name) AS reasons
      FROM ({_cases_sql(K.REQUEST_COLUMNS)}) GROUP BY customerID) r USING (customerID)""",
    "dirty_repaired"))
def v08(spark, sf_dir):
    return quality.mark_rows(dirty_repaired(spark, sf_dir)).select(
        "customerID", "reasons", "status")


# ---- preparation -------------------------------------------------------------------------

@query("p01_encode_target", check("""
    SELECT customerID, Churn, CASE Churn WHEN 'Yes' THEN 1 ELSE 0 END AS label
    FROM subscribers""", "subscribers"))
def p01(spark, sf_dir):
    return prepare.encode_target(subscribers(spark, sf_dir)).select("customerID", "Churn", "label")


@query("p02_senior_as_text", check("""
    SELECT customerID, CASE SeniorCitizen WHEN 1 THEN '1' ELSE '0' END AS SeniorCitizen
    FROM subscribers""", "subscribers"))
def p02(spark, sf_dir):
    return prepare.senior_as_text(subscribers(spark, sf_dir)).select("customerID", "SeniorCitizen")


@query("p03_drop_columns", check("SELECT * EXCLUDE (customerID) FROM subscribers", "subscribers"))
def p03(spark, sf_dir):
    return prepare.drop_columns(subscribers(spark, sf_dir), ["customerID", "not_there"])


@query("p04_feature_target_split", check("""
    SELECT COUNT(*) AS n_rows, 20 AS n_features,
      ROUND(AVG(CASE WHEN Churn = 'Yes' THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive_rate
    FROM subscribers""", "subscribers"))
def p04(spark, sf_dir):
    rows, names = prepare.feature_target_split(subscribers(spark, sf_dir))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(names)).alias("n_features"),
                    named(F.avg(F.col("label").cast("double")), "positive_rate", 6))


# ---- features ----------------------------------------------------------------------------

# The feature names that outputs carry, in inventory order.
FEATURE_IDS = [
    "tenure_group", "is_month_to_month", "service_adoption_count", "has_protection_bundle",
    "charge_to_tenure_ratio", "is_fiber_optic", "avg_charge_per_service", "has_family",
    "is_isolated", "senior_no_support", "is_auto_pay", "is_electronic_check",
    "is_high_monthly_charge", "monthly_charge_bin", "charges_gap", "has_internet",
    "streaming_count", "security_service_count", "has_full_streaming", "internet_addon_count",
    "has_no_internet_addons", "contract_numeric", "is_committed_customer", "m2m_and_fiber",
    "new_high_value_customer", "fiber_no_security", "paperless_and_echeck",
    "composite_churn_risk",
]
def _register_feature(number: int, feature: str) -> None:
    @query(f"f{number:02d}_{feature}",
           check(f"SELECT customerID, {feature} FROM features", "features"))
    def job(spark, sf_dir):
        return model_rows(spark, sf_dir).select("customerID", feature)


for _i, _feature in enumerate(FEATURE_IDS, start=1):
    _register_feature(_i, _feature)


@query("f29_engineer_features", check(
    f"SELECT customerID, {', '.join(FEATURE_IDS)} FROM features", "features"))
def f29(spark, sf_dir):
    return model_rows(spark, sf_dir).select("customerID", *FEATURE_IDS)


def _routes_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, '{r}' AS route, COUNT({f}) AS filled FROM features"
        for r, names in (("categorical", K.CATEGORICAL), ("numerical", K.NUMERIC),
                         ("binary", K.BINARY)) for f in names)
    return check(rows, "features")


@query("f30_feature_routes", _routes_sql())
def f30(spark, sf_dir):
    """The routing table, with the number of filled values of each routed column."""
    filled = model_rows(spark, sf_dir).agg(*[F.count(f).alias(f) for f in K.MODEL_INPUTS])
    counts = filled.unpivot([], K.MODEL_INPUTS, "feature", "filled")
    return counts.join(features.feature_routes(spark), "feature")
