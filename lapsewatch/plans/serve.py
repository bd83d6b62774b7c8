"""Queries for scoring, feature lookups and streams (R, T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapsewatch import constants as K
from lapsewatch.functions.scalars import named, tall
from lapsewatch.operators.smalltables import materialise
from lapsewatch.operators import attribution, conformal, drift, features, metrics, pointintime, prepare, quality, scoring, sketches
from lapsewatch.plans.explore import hash_share_sql, rounded
from lapsewatch.plans.intake import model_rows
from lapsewatch.plans.monitor import chi_sql, psi_sql
from lapsewatch.plans.oracle import check
from lapsewatch.plans.registry import query
from lapsewatch.session import scratch_path
from lapsewatch.sources.tables import (
    dirty_subscribers, prediction_log, scored, subscribers, table, table_stream,
)
from lapsewatch.streaming import jobs, requests, stateful

CUT = 0.30


def stamp(column, name=None):
    """Event times as text, so both engines print them alike."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name or column)


def stamp_sql(column: str) -> str:
    return f"STRFTIME({column}, '%Y-%m-%d %H:%M:%S.%f') AS {column}"


# ---- batch scoring -----------------------------------------------------------------------

DECIDED = """SELECT customerID, ROUND(prob, 4) AS churn_probability,
    prob >= 0.30::DOUBLE AS will_churn, 0.3::DOUBLE AS threshold_used,
    CASE WHEN prob >= 0.60::DOUBLE THEN 'HIGH' WHEN prob >= 0.35::DOUBLE THEN 'MEDIUM'
      ELSE 'LOW' END AS risk_tier FROM scored"""


def _decided(spark, sf_dir):
    return scoring.decide(scored(spark, sf_dir), CUT).select(
        "customerID", "churn_probability", "will_churn", "threshold_used", "risk_tier")


@query("r01_score_table", check(DECIDED, "scored"))
def r01(spark, sf_dir):
    return scoring.with_request_id(_decided(spark, sf_dir)).drop("request_id")


@query("r02_batch_summary", check(f"""
    SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE risk_tier = 'HIGH') AS high_risk,
      COUNT(*) FILTER (WHERE risk_tier = 'MEDIUM') AS medium_risk,
      COUNT(*) FILTER (WHERE risk_tier = 'LOW') AS low_risk,
      ROUND(AVG(churn_probability), 4) AS mean_probability FROM ({DECIDED})""", "scored"))
def r02(spark, sf_dir):
    return scoring.batch_summary(_decided(spark, sf_dir))


# Fixed coefficients of a linear score, so that the terms can be checked.
COEFFICIENTS = {
    "tenure": -0.035, "MonthlyCharges": 0.012, "contract_numeric": -0.9, "is_fiber_optic": 0.8,
    "internet_addon_count": -0.15, "is_electronic_check": 0.45,
}
TERMS = " UNION ALL ".join(
    f"SELECT customerID, '{c}' AS feature, "
    f"({c} - AVG({c}) OVER ()) * {w}::DOUBLE AS term FROM features"
    for c, w in COEFFICIENTS.items())


@query("r03_top_contributions", check(f"""
    SELECT customerID, feature, ROUND(term, 6) AS term FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY customerID ORDER BY ABS(term) DESC) AS k
      FROM ({TERMS})) WHERE k <= 3""", "features"))
def r03(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    means = scoring.column_means(rows, list(COEFFICIENTS))
    top = scoring.top_contributions(rows, COEFFICIENTS, means)
    return rows.select("customerID", F.explode(top).alias("feature", "term")).select(
        "customerID", "feature", named(F.col("term"), "term", 6))


# A small ensemble as a table of nodes (value, left, right, feature, threshold), so that paths can be checked.
TREE_SLOTS = ["tenure", "MonthlyCharges", "contract_numeric", "is_fiber_optic", "service_adoption_count"]
TREES = [
    (1.0, [(-0.40, 1, 2, "contract_numeric", 0.0), (0.15, 3, 4, "tenure", 11.0), (-1.10, 5, 6, "MonthlyCharges", 64.5),
           (0.62, -1, -1, None, None), (-0.05, -1, -1, None, None), (-1.32, -1, -1, None, None),
           (-0.83, -1, -1, None, None)]),
    (0.1, [(-0.12, 1, 2, "is_fiber_optic", 0.0), (-0.51, 3, 4, "service_adoption_count", 3.0),
           (0.47, 5, 6, "tenure", 30.0), (-0.22, -1, -1, None, None), (-0.74, -1, -1, None, None),
           (0.81, -1, -1, None, None), (0.09, -1, -1, None, None)]),
    (0.1, [(0.05, 1, 2, "tenure", 3.0), (0.93, -1, -1, None, None), (-0.07, 3, 4, "tenure", 48.0),
           (0.02, -1, -1, None, None), (-0.35, -1, -1, None, None)]),
]


def _paths_sql() -> str:
    """What every node adds to its feature for the rows that reach it, and the leaves' own sum."""
    terms, leaves = [], []
    for weight, nodes in TREES:
        def walk(i: int, reached: str) -> str:
            value, left, right, feature, cut = nodes[i]
            if left < 0:
                return f"{value}::DOUBLE"
            goes = f"{feature} <= {cut}::DOUBLE"
            steps = [f"{weight}::DOUBLE * ({nodes[j][0]}::DOUBLE - {value}::DOUBLE)" for j in (left, right)]
            terms.append(f"SELECT customerID, '{feature}' AS feature, CASE WHEN {reached} THEN CASE WHEN {goes} "
                         f"THEN {steps[0]} ELSE {steps[1]} END ELSE 0 END AS term FROM features")
            return (f"CASE WHEN {goes} THEN {walk(left, f'{reached} AND {goes}')} "
                    f"ELSE {walk(right, f'{reached} AND NOT ({goes})')} END")
        leaves.append(f"{weight}::DOUBLE * ({walk(0, 'TRUE')})")
    places = ", ".join(f"('{f}', {i})" for i, f in enumerate(TREE_SLOTS))
    return f"""
        SELECT customerID, feature, ROUND(term, 6) AS term, ROUND(margin, 6) AS margin FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY customerID ORDER BY ROUND(ABS(term), 9) DESC, place) AS k
          FROM (SELECT customerID, feature, SUM(term) AS term FROM ({" UNION ALL ".join(terms)}) GROUP BY ALL)
            JOIN (VALUES {places}) p(feature, place) USING (feature))
          JOIN (SELECT customerID, {" + ".join(leaves)} AS margin FROM features) USING (customerID)
        WHERE k <= 3"""


@query("r03_tree_contributions", check(_paths_sql(), "features"))
def r03_trees(spark, sf_dir):
    """Top three path contributions of a tree ensemble, with the margin they add up to."""
    nodes = [(t, weight, i, value, left, right, -1 if feature is None else TREE_SLOTS.index(feature),
              [] if cut is None else [cut], -1)
             for t, (weight, tree) in enumerate(TREES) for i, (value, left, right, feature, cut) in enumerate(tree)]
    forest = attribution.Forest.of(spark.createDataFrame(nodes, attribution.NODES))
    rows = model_rows(spark, sf_dir).select(
        "customerID", F.array(*[F.col(c).cast("double") for c in TREE_SLOTS]).alias("features"))
    # Terms of one size may differ in their last digits, which must not decide their order.
    found = attribution.attributed(rows, forest, TREE_SLOTS)
    top = attribution.strongest(F.transform("contributions", lambda x: F.round(x, 9)), TREE_SLOTS)
    return found.select("customerID", F.round("margin", 6).alias("margin"), F.inline(top)).select(
        "customerID", "feature", named(F.col("term"), "term", 6), "margin")


SETS = {c: f"q{round(c * 100)}" for c in K.CONFIDENCES}


def _quantile_sql(confidence: float) -> str:
    """The conformal quantile of the scorecard: an order statistic of its nonconformity."""
    return (f"(SELECT COALESCE(MIN(s) FILTER (WHERE k >= CEIL((n + 1) * {round(confidence * 1000)} / 1000.0::DOUBLE)), 1) "
            "FROM (SELECT s, ROW_NUMBER() OVER (ORDER BY s) AS k, COUNT(*) OVER () AS n FROM "
            "(SELECT CASE WHEN label = 1 THEN 1 - prob ELSE prob END AS s FROM scored)))")


@query("r01_full_response", check(f"""
    WITH t AS (SELECT customerID, feature, ROUND(term, 6) AS term,
        ROW_NUMBER() OVER (PARTITION BY customerID ORDER BY ABS(term) DESC) AS k FROM ({TERMS}))
    SELECT d.*, {", ".join(f"MAX(feature) FILTER (WHERE k = {i}) AS feature_{i}, MAX(term) FILTER (WHERE k = {i}) AS term_{i}" for i in (1, 2, 3))},
      {", ".join(f"ANY_VALUE(1 - prob <= {_quantile_sql(c)}) AS churn_{n}, ANY_VALUE(prob <= {_quantile_sql(c)}) AS stays_{n}" for c, n in SETS.items())}
    FROM ({DECIDED}) d JOIN t USING (customerID) JOIN scored s USING (customerID) GROUP BY ALL""", "features", "scored"))
def r01_full(spark, sf_dir):
    """Decision, tier, the three strongest contributions and the conformal sets in one row."""
    rows = model_rows(spark, sf_dir)
    means = scoring.column_means(rows, list(COEFFICIENTS))
    explained = rows.select("customerID", scoring.top_contributions(rows, COEFFICIENTS, means).alias("explanation"))
    cards = scored(spark, sf_dir).select("customerID", "label", "prob")
    response = scoring.full_response(cards.join(explained, "customerID"), CUT, conformal.calibrate(cards))

    def key(i):
        return F.map_keys("explanation")[i]

    return response.select(
        "customerID", "churn_probability", "will_churn", "threshold_used", "risk_tier",
        *[x for i in range(3) for x in (key(i).alias(f"feature_{i + 1}"),
                                        named(F.map_values("explanation")[i], f"term_{i + 1}", 6))],
        *[x for i, n in enumerate(SETS.values()) for x in (
            F.col("conformal")[i]["includes_churn"].alias(f"churn_{n}"),
            F.col("conformal")[i]["includes_no_churn"].alias(f"stays_{n}"))])


# ---- feature lookups ---------------------------------------------------------------------
# Clicks ask for features; all other events deliver them.

def feature_events(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type <> 'click'").select(
        "user_id", F.col("ts").alias("feature_ts"), "value", "event_id")


def request_events(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'click'").select(
        "user_id", F.col("ts").alias("request_ts"), F.col("event_id").alias("request_id"))


FEATURE_ROWS = ("SELECT user_id, ts AS feature_ts, value, event_id FROM events "
                "WHERE event_type <> 'click'")
REQUEST_ROWS = ("SELECT user_id, ts AS request_ts, event_id AS request_id FROM events "
                "WHERE event_type = 'click'")
AS_OF = "2024-01-31 00:00:00"


@query("r04_latest_features", f"""
    SELECT user_id, {stamp_sql('feature_ts')}, value FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY feature_ts DESC, event_id DESC) k
      FROM ({FEATURE_ROWS}))
    WHERE k = 1 AND feature_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY""")
def r04(spark, sf_dir):
    newest = pointintime.latest_per_key(
        feature_events(spark, sf_dir), "user_id", "feature_ts", ["value"], "event_id",
        as_of=F.lit(AS_OF).cast("timestamp"), ttl_days=2)
    return newest.select("user_id", stamp("feature_ts"), "value")


@query("r05_unknown_keys", """
    SELECT c_custkey AS user_id, COUNT(*) AS requests
    FROM customer JOIN orders ON o_custkey = c_custkey
    WHERE c_custkey NOT IN (SELECT user_id FROM events) GROUP BY 1""")
def r05(spark, sf_dir):
    """Requests by the customer of each order; known are the users with events."""
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"))
    return pointintime.unknown_keys(wanted, table(spark, sf_dir, "events"), "user_id")


@query("r06_point_in_time_join", f"""
    SELECT request_id, e.user_id, {stamp_sql('request_ts')},
      STRFTIME(CASE WHEN fresh THEN feature_ts END, '%Y-%m-%d %H:%M:%S.%f') AS feature_ts,
      CASE WHEN fresh THEN value END AS value
    FROM (SELECT e.*, f.feature_ts, f.value, e.request_ts - f.feature_ts <= INTERVAL 5 DAY AS fresh
          FROM ({REQUEST_ROWS}) e ASOF LEFT JOIN ({FEATURE_ROWS}) f
            ON e.user_id = f.user_id AND e.request_ts >= f.feature_ts) e""")
def r06(spark, sf_dir):
    joined = pointintime.point_in_time(
        request_events(spark, sf_dir), feature_events(spark, sf_dir), "user_id", "request_ts",
        "feature_ts", ["value"], "event_id", ttl_days=5)
    return joined.select("request_id", "user_id", stamp("request_ts"), stamp("feature_ts"),
                         "value")


LATEST = f"""SELECT user_id, {stamp_sql('feature_ts')}, value, event_id FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY feature_ts DESC, event_id DESC) k
      FROM ({FEATURE_ROWS})) WHERE k = 1"""


@query("r07_incremental_merge", LATEST)
def r07(spark, sf_dir):
    """A table built up to mid-month takes in the rows that came after."""
    rows, path = feature_events(spark, sf_dir), scratch_path(spark, "materialised")
    cut = F.lit("2024-01-16").cast("timestamp")
    empty = rows.limit(0)
    pointintime.merge_latest(empty, rows.where(F.col("feature_ts") < cut), "user_id",
                             "feature_ts", "event_id").write.parquet(f"{path}/1")
    current = spark.read.schema(rows.schema).parquet(f"{path}/1")
    pointintime.merge_latest(current, rows.where(F.col("feature_ts") >= cut), "user_id",
                             "feature_ts", "event_id").write.parquet(f"{path}/2")
    return spark.read.schema(rows.schema).parquet(f"{path}/2").withColumn(
        "feature_ts", stamp("feature_ts"))


@query("r07_incremental_merge_stream", LATEST)
def r07_stream(spark, sf_dir):
    """Rows arrive in three parts, the oldest last; each start changes only the keys that came."""
    root = scratch_path(spark, "latest")
    at = F.col("feature_ts")
    parts = [at >= F.lit("2024-01-21").cast("timestamp"), at < F.lit("2024-01-11").cast("timestamp")]
    newest = jobs.arriving(
        feature_events(spark, sf_dir), [parts[0], ~parts[0] & ~parts[1], parts[1]],
        lambda rows: jobs.maintain_latest(rows, "user_id", "feature_ts", "event_id", root))
    return newest.withColumn("feature_ts", stamp("feature_ts"))


# A request row's probability for the mixed batch: points by contract and connection.
POINTS = """(10 + CASE Contract WHEN 'Month-to-month' THEN 200 WHEN 'One year' THEN 60 ELSE 0 END
  + CASE InternetService WHEN 'Fiber optic' THEN 140 WHEN 'DSL' THEN 40 ELSE 0 END
  + CASE WHEN tenure <= 12 THEN 150 ELSE 0 END)::DOUBLE / 500"""
BAD = """gender NOT IN ('Male', 'Female') OR tenure < 0 OR MonthlyCharges <= 0
  OR Contract IS NULL"""
MIXED = check(f"""
    SELECT customerID, CASE WHEN bad THEN 'failed' ELSE 'scored' END AS status,
      CASE WHEN gender NOT IN ('Male', 'Female') THEN 'gender:allowed'
        WHEN tenure < 0 THEN 'tenure:range' WHEN MonthlyCharges <= 0 THEN 'MonthlyCharges:positive'
        WHEN Contract IS NULL THEN 'Contract:not_null' ELSE '' END AS reasons,
      CASE WHEN NOT bad THEN ROUND(p, 4) END AS churn_probability,
      CASE WHEN NOT bad THEN p >= 0.30::DOUBLE END AS will_churn,
      CASE WHEN bad THEN NULL WHEN p >= 0.60::DOUBLE THEN 'HIGH' WHEN p >= 0.35::DOUBLE
        THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier
    FROM (SELECT *, COALESCE({BAD}, FALSE) AS bad, {POINTS} AS p FROM dirty_repaired)""",
    "dirty_repaired")


def points():
    return (
        F.lit(10)
        + F.when(F.col("Contract") == "Month-to-month", 200)
        .when(F.col("Contract") == "One year", 60).otherwise(0)
        + F.when(F.col("InternetService") == "Fiber optic", 140)
        .when(F.col("InternetService") == "DSL", 40).otherwise(0)
        + F.when(F.col("tenure") <= 12, 150).otherwise(0)
    ).cast("double") / 500.0


@query("r08_mixed_batch", MIXED)
def r08(spark, sf_dir):
    rows = quality.repair_total_charges(dirty_subscribers(spark, sf_dir))
    return scoring.score_isolating_failures(rows, points(), CUT)


# ---- streams -----------------------------------------------------------------------------
# A window is emitted once event time, the newest event less the lateness, has passed its end.

LATENESS = "1 hour"
CLOSED = "(SELECT MAX(ts) - INTERVAL 1 HOUR FROM log)"


def log_stream(spark, sf_dir):
    return prediction_log(table_stream(spark, sf_dir, "events"))


def stream_table(df, name, digits=6):
    out = requests.run_to_table(df, scratch_path(df.sparkSession, name))
    return rounded(out.select(*[
        stamp(c) if t == "timestamp" else F.col(c) for c, t in out.dtypes]), digits)


def windows_sql(size: str, step: str, aggregates: str, keys: str = "endpoint, ") -> str:
    return check(f"""
        SELECT {stamp_sql('window_start')}, {keys}{aggregates}
        FROM (SELECT *, TIME_BUCKET(INTERVAL {size}, ts) AS window_start FROM log)
        WHERE window_start + INTERVAL {step} <= {CLOSED} GROUP BY ALL""", "log")


@query("t01_requests_per_minute", windows_sql("1 MINUTE", "1 MINUTE", "COUNT(*) AS requests"))
def t01(spark, sf_dir):
    return stream_table(requests.request_counts(log_stream(spark, sf_dir), LATENESS), "t01")


@query("t01_requests_per_minute_batch", check(f"""
    SELECT {stamp_sql('window_start')}, endpoint, COUNT(*) AS requests
    FROM (SELECT *, DATE_TRUNC('minute', ts) AS window_start FROM log) GROUP BY ALL""", "log"))
def t01_batch(spark, sf_dir):
    log = prediction_log(table(spark, sf_dir, "events"))
    return requests.request_counts(log).withColumn("window_start", stamp("window_start"))


@query("t02_error_rates", windows_sql(
    "1 HOUR", "1 HOUR", "SUM(is_error)::BIGINT AS errors, ROUND(AVG(is_error), 6) AS error_rate"))
def t02(spark, sf_dir):
    return stream_table(requests.error_rates(log_stream(spark, sf_dir), LATENESS), "t02")


def _limits_sql(column: str, limits) -> str:
    return ", ".join(
        f"COUNT(*) FILTER (WHERE {column} <= {x}::DOUBLE) AS {f'le_{x}'.replace('.', '_')}"
        for x in limits) + ", COUNT(*) AS le_inf"


@query("t03_latency_histogram", windows_sql(
    "1 DAY", "1 DAY", _limits_sql("latency_s", requests.LATENCY_LIMITS)
    + ", ROUND(SUM(latency_s), 6) AS latency_sum"))
def t03(spark, sf_dir):
    return stream_table(requests.latency_histogram(log_stream(spark, sf_dir), LATENESS), "t03")


@query("t04_probability_histogram", windows_sql(
    "1 DAY", "1 DAY", _limits_sql("prob", requests.PROBABILITY_LIMITS), keys=""))
def t04(spark, sf_dir):
    return stream_table(requests.probability_histogram(log_stream(spark, sf_dir), LATENESS), "t04")


BASELINE = 0.02


@query("t05_rolling_prediction_drift", check(f"""
    WITH d AS (SELECT DATE_TRUNC('day', ts) AS day, SUM(prob) AS s, COUNT(*) AS n FROM log
               WHERE DATE_TRUNC('day', ts) + INTERVAL 1 DAY <= {CLOSED} GROUP BY 1),
      w AS (SELECT day - INTERVAL (k) DAY AS window_start, s, n
            FROM d, (SELECT UNNEST(RANGE(0, 7)) AS k))
    SELECT {stamp_sql('window_start')},
      STRFTIME(window_start + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S.%f') AS window_end,
      SUM(n)::BIGINT AS requests, ROUND(SUM(s) / SUM(n), 6) AS mean_prob,
      ROUND(ABS(SUM(s) / SUM(n) - {BASELINE}::DOUBLE) / {BASELINE}::DOUBLE, 6) AS shift,
      ABS(SUM(s) / SUM(n) - {BASELINE}::DOUBLE) / {BASELINE}::DOUBLE > 0.15::DOUBLE AS alert
    FROM w GROUP BY window_start HAVING window_start + INTERVAL 7 DAY <= {CLOSED}""", "log"))
def t05(spark, sf_dir):
    return stream_table(requests.rolling_prediction_drift(
        log_stream(spark, sf_dir), BASELINE, lateness=LATENESS), "t05")


SLICES = """
  d AS (SELECT CAST(o_orderkey AS VARCHAR) AS customerID, o_orderdate AS day FROM orders),
  r AS (SELECT features.* FROM features JOIN d USING (customerID)
        WHERE day > (SELECT MAX(day) FROM d) - INTERVAL 97 DAY
          AND day <= (SELECT MAX(day) FROM d) - INTERVAL 7 DAY),
  c AS (SELECT features.* FROM features JOIN d USING (customerID)
        WHERE day > (SELECT MAX(day) FROM d) - INTERVAL 7 DAY)"""
WATCHED, WATCHED_TEXTS = K.NUMERIC, K.CATEGORICAL
CONTINUOUS = ["tenure", "MonthlyCharges", "TotalCharges", "charge_to_tenure_ratio", "avg_charge_per_service"]


def _time_slices(spark, sf_dir):
    dated = features.engineer(prepare.clean(subscribers(spark, sf_dir, with_date=True)))
    return requests.window_slices(dated, "signed_up")


@query("t06_window_slices_psi", check(
    f"SELECT feature, ROUND(psi, 6) AS psi, is_drifted FROM ({psi_sql(WATCHED, SLICES)})",
    "features"))
def t06(spark, sf_dir):
    return rounded(drift.psi(*_time_slices(spark, sf_dir), WATCHED).select(
        "feature", "psi", "is_drifted"))


@query("t06_window_slices_chi_square", check(
    "SELECT feature, ROUND(statistic, 5) AS statistic, n_categories, is_drifted "
    f"FROM ({chi_sql(WATCHED_TEXTS, SLICES)})", "features"))
def t06_chi(spark, sf_dir):
    tested = drift.categorical_drift(*_time_slices(spark, sf_dir), WATCHED_TEXTS)
    return rounded(tested.drop("p_value"), 5)


def arrived_sides(batch: int) -> str:
    return f"""
      r AS (SELECT * FROM features WHERE {hash_share_sql()} < 0.8::DOUBLE),
      c AS (SELECT * FROM features WHERE customerID::BIGINT % 3 = {batch})"""


@query("t06_drift_stream", check(" UNION ALL ".join(
    f"SELECT {batch} AS batch, feature, ROUND(psi, 6) AS psi, is_drifted FROM "
    f"({psi_sql(WATCHED, arrived_sides(batch))})" for batch in range(3)), "features"))
def t06_stream(spark, sf_dir):
    """Customers arrive in three parts, each compared with a saved training snapshot."""
    from lapsewatch.plans.monitor import split_sides
    from lapsewatch.sources.files import load_snapshot, save_snapshot
    from lapsewatch.sources.tables import subscribers_of
    snapshot = save_snapshot(split_sides(spark, sf_dir)[0], scratch_path(spark, "reference"))
    reference, root = load_snapshot(spark, snapshot), scratch_path(spark, "drift-stream")
    return rounded(jobs.arriving(
        table(spark, sf_dir, "orders"), [F.col("o_orderkey") % 3 == part for part in range(3)],
        lambda orders: jobs.drift_stream(
            features.engineer(prepare.clean(subscribers_of(orders))), reference, WATCHED, root)))


# ---- windows from stored daily sketches ---------------------------------------------------

LOGGED, LOGGED_TEXTS = ["prob", "latency_s"], ["endpoint", "customer"]


def stored_days(rows, at, numeric, other=()):
    """Daily sketches of a table, written as a job of its own would, in two appends, and read back."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "daily")
    days = sketches.daily(rows, at, numeric, other)
    even = F.dayofmonth("day") % 2 == 0
    for part in (even, ~even):
        days.where(part).write.mode("append").parquet(path)
    return spark.read.schema(days.schema).parquet(path)


@query("t05_rolling_mean_from_sketches", check("""
    WITH d AS (SELECT CAST(ts AS DATE) AS day, SUM(prob) AS s, COUNT(prob) AS n FROM log GROUP BY 1)
    SELECT STRFTIME(day, '%Y-%m-%d') AS day, SUM(n) OVER w::BIGINT AS requests,
      ROUND(SUM(s) OVER w / SUM(n) OVER w, 6) AS mean FROM d
    WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""", "log"))
def t05_sketches(spark, sf_dir):
    days = stored_days(prediction_log(table(spark, sf_dir, "events")), "ts", LOGGED)
    return rounded(sketches.rolling_mean(days, "prob").withColumn("day", F.date_format("day", "yyyy-MM-dd")))


@query("a01_profile_from_sketches", check(" UNION ALL ".join(
    f"SELECT CAST(w AS INT) AS week, '{c}' AS column_name, COUNT(*) AS n, COUNT(*) - COUNT({c}) AS nulls, "
    f"{'ROUND(AVG(' + c + '), 6)' if c in LOGGED else 'NULL::DOUBLE'} AS mean, TRUE AS distinct_close, "
    f"TRUE AS deciles_close FROM (SELECT *, FLOOR((EXTRACT(DAY FROM ts) - 1) / 7) AS w FROM log) GROUP BY w"
    for c in LOGGED + LOGGED_TEXTS), "log"))
def a01_sketches(spark, sf_dir):
    """Columns of the request log by week, from merged days: exact counts and means, and whether the
    estimated distinct counts and deciles lie within the stated error of the exact ones."""
    log = prediction_log(table(spark, sf_dir, "events"))
    week = F.floor((F.dayofmonth("day") - 1) / 7).cast("int")
    days = stored_days(log, "ts", LOGGED, LOGGED_TEXTS).withColumn("week", week)
    found = materialise(sketches.profile(sketches.merged(days, ["week"])), "profile")
    values = log.select(F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("week"), tall(
        LOGGED + LOGGED_TEXTS, "column_name", "value", "string")).where("value IS NOT NULL")
    counted = values.groupBy("week", "column_name", "value").agg(F.count(F.lit(1)).alias("k"))
    joined = counted.join(found.select("week", "column_name", "deciles"), ["week", "column_name"])
    at = F.posexplode(F.coalesce("deciles", F.array(F.lit(0.0)))).alias("i", "cut")
    ranks = joined.select("week", "column_name", F.col("value").try_cast("double").alias("x"), "k", at).groupBy(
        "week", "column_name", "i").agg(
        F.sum(F.when(F.col("x") < F.col("cut"), F.col("k")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("x") <= F.col("cut"), F.col("k")).otherwise(0)).alias("upto"),
        F.sum("k").alias("all"), F.count(F.lit(1)).alias("values"))
    slack, wanted = sketches.RANK_ERROR * F.col("all") + 1, F.col("i") / 10.0 * F.col("all")
    checked = ranks.groupBy("week", "column_name").agg(
        F.bool_and((F.col("below") - slack <= wanted) & (wanted <= F.col("upto") + slack)).alias("fits"),
        F.max("values").alias("values"))
    gap = F.abs(F.col("distinct_values") - F.col("values")) <= 1 + sketches.DISTINCT_ERROR * F.col("values")
    return rounded(found.join(checked, ["week", "column_name"]).select(
        "week", "column_name", "n", "nulls", "mean", gap.alias("distinct_close"),
        (F.col("fits") | F.col("deciles").isNull()).alias("deciles_close")))


@query("t06_psi_from_sketches", check(
    "SELECT feature, ROUND(psi, 6) AS exact_psi, is_drifted, TRUE AS close "
    f"FROM ({psi_sql(CONTINUOUS, SLICES)})", "features"))
def t06_sketches(spark, sf_dir):
    """The 90-day reference against the last week from merged days, next to the exact index: the sketched
    one may differ by what rank errors of both sides can make of ten shares."""
    dated = features.engineer(prepare.clean(subscribers(spark, sf_dir, with_date=True)))
    newest = dated.agg(F.max("signed_up").alias("at")).first()["at"]
    # The slices end at the newest instant, so days are counted back from it.
    back = F.floor((F.lit(newest).cast("timestamp").cast("double") - F.col("signed_up").cast("double")) / 86400.0)
    rows = dated.withColumn("slot", F.date_sub(F.lit(newest).cast("date"), back.cast("int")))
    days = stored_days(rows, "slot", CONTINUOUS)
    last = F.to_date(F.lit(newest).cast("timestamp"))
    current = sketches.window(days, F.date_sub(last, 6), last)
    reference = sketches.window(days, F.date_sub(last, 96), F.date_sub(last, 7))
    exact = drift.psi(*_time_slices(spark, sf_dir), CONTINUOUS).select(
        "feature", F.col("psi").alias("exact_psi"), "is_drifted")
    slack = 0.02 + 0.1 * F.col("exact_psi")
    return rounded(exact.join(sketches.psi(reference, current).select("feature", "psi"), "feature").select(
        "feature", "exact_psi", "is_drifted", (F.abs(F.col("psi") - F.col("exact_psi")) <= slack).alias("close")))


# Labels arrive as sign-ups; every other event is a prediction. Event time spans 30 days, so the
# label delay is scaled down.
DELAY_DAYS = 3


def _predictions(events):
    return prediction_log(events.where("event_type <> 'signup'")).select(
        "request_id", "customer", "ts", "prob")


def _labels(events):
    return events.where("event_type = 'signup'").select(
        F.col("event_id").alias("label_id"), F.col("user_id").alias("customer"), "ts",
        F.lit(1).alias("label"))


PREDICTED = """SELECT event_id AS request_id, user_id AS customer, ts,
    least(value, CAST(500 AS DOUBLE)) / CAST(500 AS DOUBLE) AS prob
  FROM events WHERE event_type <> 'signup'"""
LABELLED = f"""SELECT p.request_id, p.customer, p.ts, p.prob,
    CASE WHEN l.label_ts - p.ts <= INTERVAL {DELAY_DAYS} DAY THEN l.label_ts END AS label_ts,
    CASE WHEN l.label_ts - p.ts <= INTERVAL {DELAY_DAYS} DAY THEN 1.0::DOUBLE END AS label
  FROM ({PREDICTED}) p ASOF LEFT JOIN (SELECT user_id AS customer, ts AS label_ts FROM events
    WHERE event_type = 'signup') l ON p.customer = l.customer AND p.ts <= l.label_ts"""
LABELLED_CHECK = f"""SELECT request_id, customer, {stamp_sql('ts')}, prob,
    STRFTIME(label_ts, '%Y-%m-%d %H:%M:%S.%f') AS label_ts, label FROM ({LABELLED})"""


def labelled(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    labels = _labels(events).select(
        "customer", F.col("ts").alias("label_ts"), F.col("label").cast("double").alias("label"),
        "label_id")
    return pointintime.delayed_labels(
        _predictions(events), labels, "customer", "ts", "label_ts", "label", "label_id",
        DELAY_DAYS)


@query("t07_delayed_labels", LABELLED_CHECK)
def t07(spark, sf_dir):
    return labelled(spark, sf_dir).withColumns(
        {"ts": stamp("ts"), "label_ts": stamp("label_ts")})


def by_ten_days():
    """Event time in three parts."""
    first, last = (F.col("ts") < F.lit(f"2024-01-{d}").cast("timestamp") for d in (11, 21))
    return [first, ~first & last, ~last]


@query("t07_delayed_labels_stream", LABELLED_CHECK)
def t07_stream(spark, sf_dir):
    """Events arrive in three parts; state goes on over the starts. Settled and open predictions."""
    root = scratch_path(spark, "labels")
    joined = jobs.arriving(
        table(spark, sf_dir, "events"), by_ten_days(), lambda events: stateful.label_stream(
            _predictions(events), _labels(events), root, delay_days=DELAY_DAYS))
    return joined.withColumns({"ts": stamp("ts"), "label_ts": stamp("label_ts")})


DROPS = f"""
    WITH d AS (SELECT CAST(ts AS DATE) AS day,
        COUNT(*) FILTER (WHERE prob >= 0.02::DOUBLE AND label = 1) AS tp,
        COUNT(*) FILTER (WHERE prob >= 0.02::DOUBLE AND label IS NULL) AS fp,
        COUNT(*) FILTER (WHERE prob < 0.02::DOUBLE AND label = 1) AS fn
      FROM ({LABELLED}) GROUP BY 1),
    f AS (SELECT *, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1 FROM d),
    b AS (SELECT *, AVG(f1) OVER (ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING
            AND INTERVAL 1 DAY PRECEDING) AS base FROM f)
    SELECT STRFTIME(day, '%Y-%m-%d') AS day, ROUND(f1, 6) AS f1, ROUND(base, 6) AS baseline_f1,
      COALESCE(base - f1 > 0.05::DOUBLE, FALSE) AS retrain FROM b"""


@query("t08_performance_drop", DROPS)
def t08(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("label", F.coalesce("label", F.lit(0.0)))
    daily = rows.groupBy(F.to_date("ts").alias("day")).agg(*metrics.confusion_columns(0.02))
    dropped = requests.performance_drop(daily, days=30)
    return rounded(dropped.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "f1", "baseline_f1", "retrain"))


# A prediction is settled once event time (less a day) has passed its label or its window; the
# newest of these, less delay and lateness, closes days.
@query("t08_performance_drop_stream", f"""
    SELECT * FROM ({DROPS}) WHERE CAST(day AS DATE) + INTERVAL 1 DAY <= (
      SELECT MAX(ts) - INTERVAL {DELAY_DAYS + 1} DAY FROM ({LABELLED})
      WHERE COALESCE(label_ts, ts + INTERVAL {DELAY_DAYS} DAY)
        < (SELECT MAX(ts) - INTERVAL 1 DAY FROM events))""")
def t08_stream(spark, sf_dir):
    """Labels settle while events arrive in three parts; settled rows stream on into daily flags."""
    root = scratch_path(spark, "performance")

    def run(events):
        stateful.settle_labels(_predictions(events), _labels(events), root, delay_days=DELAY_DAYS)
        settled = stateful.settled_rows(spark, root, stream=True)
        return stateful.performance_stream(settled, root, 0.02, DELAY_DAYS + 1)

    flags = jobs.arriving(table(spark, sf_dir, "events"), by_ten_days(), run)
    return rounded(flags.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "f1", "baseline_f1", "retrain"))


@query("t09_scored_stream", MIXED)
def t09(spark, sf_dir):
    """Orders arrive in three parts as request rows, some of them broken; the job restarts between."""
    from lapsewatch.sources.tables import dirtied, subscribers_of
    root = scratch_path(spark, "scored-stream")
    return jobs.arriving(
        table(spark, sf_dir, "orders"), [F.col("o_orderkey") % 3 == part for part in range(3)],
        lambda orders: jobs.score_stream(
            quality.repair_total_charges(dirtied(subscribers_of(orders))), points(), CUT, root))


@query("t10_late_events", check(f"""
    SELECT {stamp_sql('window_start')}, endpoint, COUNT(*) AS requests
    FROM (SELECT *, DATE_TRUNC('day', ts) AS window_start,
            is_error = 1 AND ts < TIMESTAMP '2024-01-21' AS late FROM log)
    WHERE window_start + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 2 DAY FROM log)
      AND NOT (late AND window_start + INTERVAL 1 DAY <= (
        SELECT MAX(ts) - INTERVAL 2 DAY FROM log
        WHERE is_error = 0 AND ts < TIMESTAMP '2024-01-21'))
    GROUP BY ALL""", "log"))
def t10(spark, sf_dir):
    """Counts per day when the errors of the first 20 days arrive after everything else of them.

    The first run takes in the other rows of those days; the second run what is left. By then
    event time has closed all but the last windows, and late errors of closed ones are dropped.
    """
    log = prediction_log(table(spark, sf_dir, "events"))
    path = scratch_path(spark, "late-log")
    first = (F.col("is_error") == 0) & (F.col("ts") < F.lit("2024-01-21").cast("timestamp"))
    for part in (log.where(first), log.where(~first)):
        part.write.mode("append").parquet(f"{path}/log")
        stream = spark.readStream.schema(log.schema).parquet(f"{path}/log")
        counts = requests.run_to_table(
            requests.request_counts(stream, lateness="2 days", size="1 day"), f"{path}/out")
    return counts.withColumn("window_start", stamp("window_start"))
