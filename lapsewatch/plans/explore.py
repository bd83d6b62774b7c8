"""Queries for exploration, tests, encodings and splits (A, E, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapsewatch import constants as K
from lapsewatch.functions.scalars import named
from lapsewatch.operators import encoding, prepare, profiling, significance, splitting
from lapsewatch.plans.intake import model_rows
from lapsewatch.plans.oracle import check, tall
from lapsewatch.plans.registry import query
from lapsewatch.sources.tables import subscribers

CHARGES = ["tenure", "MonthlyCharges", "TotalCharges"]
BANDS = ["tenure_group", "monthly_charge_bin"]
NEW_NUMERIC = K.NUMERIC[3:]


def customers(spark, sf_dir):
    return prepare.clean(subscribers(spark, sf_dir))


def rounded(df, digits=6, **special):
    """Round every fractional column; ``special`` gives other digits for some."""
    return df.select(*[
        named(F.col(c), c, special.get(c, digits)) if t == "double" else F.col(c)
        for c, t in df.dtypes
    ])


# ---- profiles ----------------------------------------------------------------------------

SPARK_TYPES = {"SeniorCitizen": "int", "tenure": "int", "MonthlyCharges": "double"}


@query("a01_column_profile", check(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{SPARK_TYPES.get(c, 'string')}' AS type, "
    f"COUNT(*) - COUNT({c}) AS nulls, ROUND((COUNT(*) - COUNT({c})) * 100.0::DOUBLE / COUNT(*), 2) "
    f"AS pct_null, COUNT(DISTINCT {c}) AS distinct_values FROM dirty"
    for c in K.RAW_COLUMNS), "dirty"))
def a01(spark, sf_dir):
    from lapsewatch.sources.tables import dirty_subscribers
    return profiling.column_profile(dirty_subscribers(spark, sf_dir))


@query("a02_describe", check(f"""
    SELECT feature, COUNT(value) AS count, ROUND(AVG(value), 6) AS mean,
      ROUND(STDDEV_SAMP(value), 6) AS std, MIN(value) AS min, MAX(value) AS max,
      ROUND(QUANTILE_CONT(value, 0.25), 6) AS q25, ROUND(QUANTILE_CONT(value, 0.5), 6) AS q50,
      ROUND(QUANTILE_CONT(value, 0.75), 6) AS q75
    FROM ({tall(CHARGES, 'clean')}) GROUP BY feature""", "clean"))
def a02(spark, sf_dir):
    return rounded(profiling.describe(customers(spark, sf_dir), CHARGES))


@query("a03_class_balance", check("""
    SELECT Churn, COUNT(*) AS n, ROUND(COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (), 6) AS share
    FROM subscribers GROUP BY Churn""", "subscribers"))
def a03(spark, sf_dir):
    return rounded(profiling.class_balance(subscribers(spark, sf_dir), "Churn"))


@query("a04_revenue_at_risk", check("""
    SELECT SUM(label)::BIGINT AS churners, ROUND(AVG(MonthlyCharges), 6) AS mean_monthly,
      ROUND(SUM(label) * AVG(MonthlyCharges) * 12, 4) AS annual_at_risk,
      ROUND(SUM(label) * AVG(MonthlyCharges) * 12 * 0.1::DOUBLE, 4) AS annual_recovered
    FROM clean""", "clean"))
def a04(spark, sf_dir):
    return rounded(profiling.revenue_at_risk(customers(spark, sf_dir)), 6,
                   annual_at_risk=4, annual_recovered=4)


RATES = "COUNT(*) AS customers, SUM(label)::BIGINT AS churners, ROUND(AVG(label), 6) AS churn_rate"


@query("a05_rate_by_category", check(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS level, {RATES} FROM clean GROUP BY {c}"
    for c in ["Contract", "InternetService", "PaymentMethod", "SeniorCitizen"]), "clean"))
def a05(spark, sf_dir):
    from lapsewatch.functions.scalars import tall as spread
    columns = ["Contract", "InternetService", "PaymentMethod", "SeniorCitizen"]
    levels = customers(spark, sf_dir).select(
        "label", spread(columns, value="level", cast="string"))
    return rounded(profiling.rate_by(levels, "feature", "level")).orderBy(F.desc("churn_rate"))


@query("a06_rate_by_tenure", check(f"""
    SELECT CASE WHEN tenure <= 6 THEN '0-6m' WHEN tenure <= 12 THEN '7-12m'
      WHEN tenure <= 24 THEN '13-24m' WHEN tenure <= 48 THEN '25-48m' ELSE '49-72m' END AS bucket,
      {RATES} FROM clean WHERE tenure BETWEEN 0 AND 72 GROUP BY 1""", "clean"))
def a06(spark, sf_dir):
    rows = customers(spark, sf_dir).withColumn("bucket", profiling.tenure_bucket(F.col("tenure")))
    return rounded(profiling.rate_by(rows.where("bucket IS NOT NULL"), "bucket"))


@query("a07_rate_by_service_count", check(
    f"SELECT service_adoption_count, {RATES} FROM features GROUP BY 1", "features"))
def a07(spark, sf_dir):
    return rounded(profiling.rate_by(model_rows(spark, sf_dir), "service_adoption_count"))


@query("a08_rate_matrix", check("SELECT Contract, " + ", ".join(
    f"ROUND(COALESCE(AVG(label) FILTER (WHERE InternetService = '{k}'), 0), 6) AS \"{k}\""
    for k in K.INTERNET_KINDS) + " FROM clean GROUP BY Contract", "clean"))
def a08(spark, sf_dir):
    return rounded(profiling.rate_matrix(
        customers(spark, sf_dir), "Contract", "InternetService", K.INTERNET_KINDS))


@query("a09_median_by_class", check(f"""
    SELECT feature, label, ROUND(QUANTILE_CONT(value, 0.5), 6) AS median
    FROM ({tall(CHARGES, 'clean')}) GROUP BY ALL""", "clean"))
def a09(spark, sf_dir):
    return rounded(profiling.median_by_class(customers(spark, sf_dir), CHARGES))


MOMENTS = """SELECT feature, COUNT(*) FILTER (WHERE label = 1) AS n1,
  COUNT(*) FILTER (WHERE label = 0) AS n0, AVG(value) FILTER (WHERE label = 1) AS m1,
  AVG(value) FILTER (WHERE label = 0) AS m0, VAR_SAMP(value) FILTER (WHERE label = 1) AS v1,
  VAR_SAMP(value) FILTER (WHERE label = 0) AS v0 FROM ({rows}) GROUP BY feature"""


@query("a10_pooled_t_test", check(f"""
    SELECT feature, ROUND((m1 - m0) / SQRT(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)
      * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n0)), 6) AS statistic, (n1 + n0 - 2)::DOUBLE AS dof
    FROM ({MOMENTS.format(rows=tall(CHARGES, 'clean'))})""", "clean"))
def a10(spark, sf_dir):
    return rounded(significance.pooled_t_test(customers(spark, sf_dir), CHARGES)).drop("p_value")


@query("a11_point_biserial", check(f"""
    SELECT feature, ROUND(r, 6) AS r, ROUND(r * SQRT(n - 2) / SQRT(1 - r * r), 5) AS statistic,
      (n - 2)::DOUBLE AS dof
    FROM (SELECT feature, CORR(label, value) AS r, COUNT(*) AS n
          FROM ({tall(K.NUMERIC)}) GROUP BY feature)""", "features"))
def a11(spark, sf_dir):
    tested = significance.point_biserial(model_rows(spark, sf_dir), K.NUMERIC)
    return rounded(tested.drop("p_value", "stars"), 6, statistic=5)


@query("a11_point_biserial_p_values")
def a11_p(spark, sf_dir):
    return significance.point_biserial(model_rows(spark, sf_dir), K.NUMERIC)


def _pairs_sql(columns: list[str], having: str = "TRUE") -> str:
    place = ", ".join(f"('{c}', {i})" for i, c in enumerate(columns))
    return check(f"""
        WITH cells AS ({tall(columns, keep='customerID')}),
          place(feature, pos) AS (VALUES {place})
        SELECT feature_a, feature_b, ROUND(r, 6) AS r FROM (
          SELECT a.feature AS feature_a, b.feature AS feature_b, CORR(a.value, b.value) AS r
          FROM cells a JOIN place p ON a.feature = p.feature JOIN cells b USING (customerID)
            JOIN place q ON b.feature = q.feature
          WHERE p.pos < q.pos GROUP BY 1, 2) WHERE {having}""", "features")


@query("a12_correlation_matrix", _pairs_sql(["label", *CHARGES, "service_adoption_count"]))
def a12(spark, sf_dir):
    pairs = significance.correlation_pairs(
        model_rows(spark, sf_dir), ["label", *CHARGES, "service_adoption_count"])
    return rounded(pairs.drop("a", "b"))


@query("a13_high_risk_segment", check("""
    SELECT COUNT(*) FILTER (WHERE s) AS segment_size,
      ROUND(COUNT(*) FILTER (WHERE s)::DOUBLE / COUNT(*), 6) AS share,
      ROUND(AVG(label) FILTER (WHERE s), 6) AS churn_rate,
      ROUND(AVG(label) FILTER (WHERE s) / AVG(label), 6) AS lift,
      ROUND(SUM(MonthlyCharges) FILTER (WHERE s AND label = 1), 2) AS monthly_at_risk
    FROM (SELECT *, Contract = 'Month-to-month' AND InternetService = 'Fiber optic'
            AND tenure <= 12 AS s FROM clean)""", "clean"))
def a13(spark, sf_dir):
    report = profiling.segment_report(customers(spark, sf_dir), profiling.high_risk())
    return rounded(report, 6, monthly_at_risk=2)


@query("a13_risk_profile", check("""
    SELECT composite_churn_risk, COUNT(*) AS customers, SUM(label)::BIGINT AS churners,
      ROUND(AVG(label), 6) AS churn_rate,
      ROUND(AVG(label) / (SELECT AVG(label) FROM features), 6) AS lift,
      ROUND(COALESCE(SUM(MonthlyCharges) FILTER (WHERE label = 1), 0), 2) AS monthly_at_risk
    FROM features GROUP BY 1""", "features"))
def a13_profile(spark, sf_dir):
    return profiling.risk_profile(model_rows(spark, sf_dir), "composite_churn_risk")


@query("a14_density_histogram", check("""
    WITH r AS (SELECT label, MIN(tenure)::DOUBLE lo, MAX(tenure)::DOUBLE hi, COUNT(*) k
               FROM clean GROUP BY label)
    SELECT label, LEAST(FLOOR((tenure - lo) / ((hi - lo) / 30)), 29)::INT AS bin, COUNT(*) AS n,
      ROUND(COUNT(*) / (MAX(k) * MAX((hi - lo) / 30)), 6) AS density
    FROM clean JOIN r USING (label) GROUP BY 1, 2""", "clean"))
def a14(spark, sf_dir):
    return rounded(profiling.density_histogram(customers(spark, sf_dir), "tenure"))


def _chi_square_sql(columns: list[str]) -> str:
    """Statistic from a full grid of level x class cells."""
    return f"""
        WITH t AS ({tall(columns, cast='VARCHAR')}),
          o AS (SELECT feature, value, label, COUNT(*) AS n FROM t GROUP BY ALL),
          lv AS (SELECT feature, value, SUM(n) AS rowsum FROM o GROUP BY ALL),
          cl AS (SELECT feature, label, SUM(n) AS colsum FROM o GROUP BY ALL),
          g AS (SELECT lv.feature, lv.value, cl.label, rowsum * colsum::DOUBLE
                  / SUM(colsum) OVER (PARTITION BY lv.feature, lv.value) AS e,
                  COALESCE(o.n, 0) AS n
                FROM lv JOIN cl USING (feature) LEFT JOIN o
                  ON o.feature = lv.feature AND o.value = lv.value AND o.label = cl.label),
          d AS (SELECT feature, (COUNT(DISTINCT value) - 1) * (COUNT(DISTINCT label) - 1) AS dof
                FROM g GROUP BY feature)
        SELECT feature, SUM(CASE WHEN dof = 1
            THEN POWER(ABS(n - e) - LEAST(0.5::DOUBLE, ABS(n - e)), 2) / e
            ELSE POWER(n - e, 2) / e END) AS statistic, MAX(dof)::DOUBLE AS dof
        FROM g JOIN d USING (feature) GROUP BY feature"""


DISCRETE = K.BINARY + BANDS


@query("a15_chi_square", check(
    f"SELECT feature, ROUND(statistic, 4) AS statistic, dof FROM ({_chi_square_sql(DISCRETE)})",
    "features"))
def a15(spark, sf_dir):
    tested = significance.chi_square_test(model_rows(spark, sf_dir), DISCRETE)
    return rounded(tested.drop("p_value"), 4)


WELCH = f"""SELECT feature, ABS(m1 - m0) / SQRT(v1 / n1 + v0 / n0) AS statistic,
  POWER(v1 / n1 + v0 / n0, 2) / (POWER(v1 / n1, 2) / (n1 - 1) + POWER(v0 / n0, 2) / (n0 - 1))
    AS dof FROM ({MOMENTS.format(rows=tall(NEW_NUMERIC))})"""


@query("a16_welch_t_test", check(
    f"SELECT feature, ROUND(statistic, 5) AS statistic, ROUND(dof, 3) AS dof FROM ({WELCH})",
    "features"))
def a16(spark, sf_dir):
    tested = significance.welch_t_test(model_rows(spark, sf_dir), NEW_NUMERIC)
    return rounded(tested.drop("p_value"), 5, dof=3)


# Critical values at 0.05 by degrees of freedom: the SQL side has no tail functions.
CHI_SQUARE_05 = {1: 3.841458821, 2: 5.991464547, 3: 7.814727903, 4: 9.487729037, 5: 11.070497694,
                 6: 12.591587244, 7: 14.067140449, 8: 15.507313056}
CRITICAL = ", ".join(f"({d}, {x})" for d, x in CHI_SQUARE_05.items())


@query("a17_significance_table", check(f"""
    SELECT feature, 'chi-squared' AS test, ROUND(statistic, 4) AS statistic,
      CASE WHEN statistic > limit_05 THEN 'SIGNIFICANT' ELSE 'NOT SIGNIFICANT' END AS verdict
    FROM ({_chi_square_sql(DISCRETE)}) JOIN (VALUES {CRITICAL}) c(dof, limit_05) USING (dof)
    UNION ALL
    SELECT feature, 't-test (Welch)', ROUND(statistic, 4),
      CASE WHEN statistic > 1.9605 THEN 'SIGNIFICANT' ELSE 'NOT SIGNIFICANT' END
    FROM ({WELCH})""", "features"))
def a17(spark, sf_dir):
    found = significance.significance_table(model_rows(spark, sf_dir), DISCRETE, NEW_NUMERIC)
    return rounded(found.drop("p_value", "dof"), 4)


@query("a17_significance_p_values")
def a17_p(spark, sf_dir):
    return significance.significance_table(model_rows(spark, sf_dir), DISCRETE, NEW_NUMERIC)


@query("a18_flag_lift", check(f"""
    SELECT feature, COUNT(*) FILTER (WHERE value = 1) AS count_flagged,
      ROUND(AVG(label) FILTER (WHERE value = 1), 6) AS flagged_rate,
      ROUND(AVG(label) FILTER (WHERE value = 0), 6) AS unflagged_rate,
      ROUND(AVG(label) FILTER (WHERE value = 1) / AVG(label), 6) AS lift
    FROM ({tall(K.BINARY)}) GROUP BY feature""", "features"))
def a18(spark, sf_dir):
    return rounded(profiling.flag_lift(model_rows(spark, sf_dir), K.BINARY))


@query("a19_group_lift", check(f"""
    SELECT tenure_group, {RATES},
      ROUND(AVG(label) / (SELECT AVG(label) FROM features), 6) AS lift
    FROM features GROUP BY tenure_group""", "features"))
def a19(spark, sf_dir):
    return rounded(profiling.group_lift(model_rows(spark, sf_dir), "tenure_group"))


@query("a20_class_means", check(f"""
    SELECT feature, ROUND(AVG(value) FILTER (WHERE label = 1), 5) AS mean_churned,
      ROUND(AVG(value) FILTER (WHERE label = 0), 5) AS mean_retained
    FROM ({tall(NEW_NUMERIC)}) GROUP BY feature""", "features"))
def a20(spark, sf_dir):
    return rounded(profiling.class_means(model_rows(spark, sf_dir), NEW_NUMERIC), 5)


def _inventory_sql() -> str:
    numbers = f"""SELECT feature, COUNT(DISTINCT value) AS levels, 'numeric' AS kind,
        ROUND(AVG(value) FILTER (WHERE label = 1), 5) AS at_churn,
        ROUND(AVG(value) FILTER (WHERE label = 0), 5) AS at_retain
      FROM ({tall(NEW_NUMERIC)}) GROUP BY feature"""
    flags = f"""SELECT feature, COUNT(DISTINCT value), 'binary',
        ROUND(AVG(label) FILTER (WHERE value = 1), 5),
        ROUND(AVG(label) FILTER (WHERE value = 0), 5)
      FROM ({tall(K.BINARY)}) GROUP BY feature"""
    texts = f"""SELECT feature, COUNT(DISTINCT value), 'categorical', NULL, NULL
      FROM ({tall(BANDS, cast='VARCHAR')}) GROUP BY feature"""
    return check(f"{numbers} UNION ALL {flags} UNION ALL {texts}", "features")


@query("a20_feature_inventory", _inventory_sql())
def a20_inventory(spark, sf_dir):
    return rounded(profiling.inventory(
        model_rows(spark, sf_dir), BANDS + NEW_NUMERIC + K.BINARY), 5)


STRONG = NEW_NUMERIC + K.BINARY


@query("a21_strong_correlations", _pairs_sql(STRONG, "ABS(r) > 0.70"))
def a21(spark, sf_dir):
    pairs = significance.correlation_pairs(model_rows(spark, sf_dir), STRONG)
    return rounded(significance.strong_pairs(pairs).drop("a", "b"))


# ---- encodings ---------------------------------------------------------------------------

TEXTS = list(K.DOMAINS)


@query("e01_label_encode", check("SELECT customerID, " + ", ".join(
    f"(DENSE_RANK() OVER (ORDER BY {c}) - 1)::INT AS {c}" for c in TEXTS) + " FROM clean",
    "clean"))
def e01(spark, sf_dir):
    rows = customers(spark, sf_dir).select("customerID", *TEXTS)
    return encoding.label_encode(rows, TEXTS)


def _flags_sql(columns: list[str], first: int = 0) -> str:
    flags = ", ".join(
        f"CAST({c} = '{v}' AS INT) AS \"{c}={v}\""
        for c in columns for v in sorted(K.DOMAINS[c])[first:])
    return check(f"SELECT customerID, {flags} FROM clean", "clean")


@query("e02_one_hot", _flags_sql(TEXTS))
def e02(spark, sf_dir):
    rows = customers(spark, sf_dir).select("customerID", *TEXTS)
    return encoding.one_hot(rows, TEXTS).drop(*TEXTS)


@query("e03_standard_scores", check("SELECT customerID, " + ", ".join(
    f"ROUND(({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER (), 5) + 0.0::DOUBLE AS {c}"
    for c in K.NUMERIC) + " FROM features", "features"))
def e03(spark, sf_dir):
    rows = model_rows(spark, sf_dir).select("customerID", *K.NUMERIC)
    return rounded(encoding.Scaler.fit(rows, K.NUMERIC).transform(rows), 5)


LEVELS = {**K.DOMAINS, "SeniorCitizen": ["0", "1"], "tenure_group": K.TENURE_GROUPS,
          "monthly_charge_bin": K.CHARGE_BINS}
SLOTS = (
    [(f"{c}__hot_{v}", f"CAST({c} = '{v}' AS DOUBLE)")
     for c in K.CATEGORICAL for v in sorted(LEVELS[c])]
    + [(f"{c}__scaled", f"ROUND(({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER (), 5) "
        "+ 0.0::DOUBLE") for c in K.NUMERIC]
    + [(c, f"CAST({c} AS DOUBLE)") for c in K.BINARY])


@query("e04_model_vectors", check("SELECT customerID, label, " + ", ".join(
    f'{expression} AS "{name}"' for name, expression in SLOTS) + " FROM features", "features"))
def e04(spark, sf_dir):
    """The routed vector, one column per slot under the slot's own name."""
    vectors, _ = encoding.encode(model_rows(spark, sf_dir))
    slots = vectors.select("customerID", "label", encoding.as_array().alias("v"))
    return slots.select("customerID", "label", *[
        F.round(F.col("v")[i], 5).alias(name)
        for i, name in enumerate(encoding.vector_names(vectors))])


@query("e05_dummies", _flags_sql(["InternetService", "Contract", "PaymentMethod"], 1))
def e05(spark, sf_dir):
    columns = ["InternetService", "Contract", "PaymentMethod"]
    rows = customers(spark, sf_dir).select("customerID", *columns)
    return encoding.dummies(rows, columns).drop(*columns)


# ---- splits ------------------------------------------------------------------------------

def hash_share_sql(salt: str = "", digits: int = splitting.HEX_DIGITS) -> str:
    return (f"(CAST('0x' || SUBSTR(MD5('{salt}' || customerID), 1, {digits}) AS BIGINT) "
            f"/ {16 ** digits}.0::DOUBLE)")


def _ranked_sql(salt: str = "") -> str:
    """Place k of every row among the n rows of its class, by a fine hash."""
    return (f"SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY {hash_share_sql(salt, splitting.FINE_DIGITS)}) "
            "AS k, COUNT(*) OVER (PARTITION BY label) AS n FROM clean")


def _split_sql(parts: list[tuple[str, float]]) -> str:
    upto, cases = 0.0, ""
    for name, size in parts[:-1]:
        upto = round(upto + size, 12)
        cases += f" WHEN k <= FLOOR({upto}::DOUBLE * n + 0.5::DOUBLE) THEN '{name}'"
    return check(f"SELECT customerID, label, CASE{cases} ELSE '{parts[-1][0]}' END AS split "
                 f"FROM ({_ranked_sql()})", "clean")


def _register_split(name: str, parts: list[tuple[str, float]]) -> None:
    @query(name, _split_sql(parts))
    def job(spark, sf_dir):
        rows = customers(spark, sf_dir).select("customerID", "label")
        return splitting.add_exact_split(rows, parts)


_register_split("x01_train_test", splitting.TRAIN_TEST)
_register_split("x02_train_validation_test", splitting.TRAIN_VALIDATION_TEST)
_register_split("x03_with_calibration", splitting.WITH_CALIBRATION)


@query("x04_folds", check("SELECT customerID, label, (" + " + ".join(
    f"(k > FLOOR(({i} / 5.0::DOUBLE) * n + 0.5::DOUBLE))::INT" for i in range(1, 5))
    + f")::INT AS fold FROM ({_ranked_sql('fold:')})", "clean"))
def x04(spark, sf_dir):
    return splitting.add_exact_folds(customers(spark, sf_dir).select("customerID", "label"))


@query("x05_nested_subsamples", check(f"""
    SELECT fold, step AS size_step, COUNT(*) AS n_rows, SUM(label)::BIGINT AS churners
    FROM (SELECT label, FLOOR({hash_share_sql('fold:')} * 5)::INT AS fold,
            FLOOR({hash_share_sql('size:')} * 10)::INT + 1 AS entry FROM clean)
      JOIN (SELECT UNNEST(RANGE(1, 11))::INT AS step) ON entry <= step
    GROUP BY 1, 2""", "clean"))
def x05(spark, sf_dir):
    from pyspark.sql import Window
    rows = splitting.add_nested_share(splitting.add_fold(customers(spark, sf_dir)))
    steps = rows.groupBy("fold", "size_step").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    upto = Window.partitionBy("fold").orderBy("size_step")
    return steps.select("fold", "size_step", F.sum("n").over(upto).alias("n_rows"),
                        F.sum("pos").over(upto).alias("churners"))
