"""Queries for drift monitoring and feature selection (D, FS)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapsewatch import constants as K
from lapsewatch.functions.scalars import named
from lapsewatch.operators import drift, features, neighbours, prepare, selection, significance, splitting
from lapsewatch.operators.smalltables import materialise
from lapsewatch.plans.explore import CRITICAL, hash_share_sql, rounded
from lapsewatch.plans.intake import model_rows
from lapsewatch.plans.oracle import check, tall
from lapsewatch.plans.registry import query
from lapsewatch.session import scratch_path
from lapsewatch.sources import files
from lapsewatch.sources.tables import scored, subscribers

# The reference is the training part, the current table the held-out part: no drift expected.
# For drift, the same customers are cut by sign-up time: tenure depends on the calendar.
CUT_DATE = "1997-07-01"
MONITORED = K.CATEGORICAL + K.NUMERIC + K.BINARY
TEXTS = [*K.DOMAINS]


def split_sides(spark, sf_dir):
    rows = splitting.add_split(model_rows(spark, sf_dir), splitting.TRAIN_TEST)
    rows = rows.withColumn("prob", F.col("composite_churn_risk") / 7.0)
    return (rows.where("split = 'train'").drop("split"),
            rows.where("split = 'test'").drop("split"))


def dated_sides(spark, sf_dir):
    dated = features.engineer(prepare.clean(subscribers(spark, sf_dir, with_date=True)))
    before = F.col("signed_up") < F.lit(CUT_DATE).cast("timestamp")
    dated = dated.withColumn("prob", F.col("composite_churn_risk") / 7.0)
    return dated.where(before).drop("signed_up"), dated.where(~before).drop("signed_up")


SPLIT_VIEWS = f"""
  r AS (SELECT * FROM features WHERE {hash_share_sql()} < 0.8::DOUBLE),
  c AS (SELECT * FROM features WHERE {hash_share_sql()} >= 0.8::DOUBLE)"""
DATED_VIEWS = f"""
  day AS (SELECT CAST(o_orderkey AS VARCHAR) AS customerID,
            o_orderdate < TIMESTAMP '{CUT_DATE}' AS early FROM orders),
  r AS (SELECT features.* FROM features JOIN day USING (customerID) WHERE early),
  c AS (SELECT features.* FROM features JOIN day USING (customerID) WHERE NOT early)"""


def psi_sql(columns: list[str], sides: str) -> str:
    """PSI by joining every value to literal bin limits."""
    deciles = ", ".join(f"{i / 10}" for i in range(11))
    return f"""WITH {sides}, rt AS ({tall(columns, 'r')}), ct AS ({tall(columns, 'c')}),
        e AS (SELECT feature, LIST_SORT(LIST_DISTINCT(QUANTILE_CONT(value, [{deciles}]))) AS ed
              FROM rt GROUP BY feature),
        lim AS (SELECT feature, i, ed[i + 1] AS lo, ed[i + 2] AS hi, i = LEN(ed) - 2 AS last
                FROM (SELECT feature, ed, UNNEST(RANGE(0, LEN(ed) - 1)) AS i FROM e
                      WHERE LEN(ed) >= 3)),
        rh AS (SELECT lim.feature, i, COUNT(value) AS n FROM lim LEFT JOIN rt
                 ON rt.feature = lim.feature AND value >= lo
                   AND (value < hi OR (last AND value = hi)) GROUP BY 1, 2),
        ch AS (SELECT lim.feature, i, COUNT(value) AS n FROM lim LEFT JOIN ct
                 ON ct.feature = lim.feature AND value >= lo
                   AND (value < hi OR (last AND value = hi)) GROUP BY 1, 2),
        s AS (SELECT feature, rh.n / (SELECT COUNT(*) FROM r)::DOUBLE + 1e-6::DOUBLE AS p,
                ch.n / (SELECT COUNT(*) FROM c)::DOUBLE + 1e-6::DOUBLE AS q
              FROM rh JOIN ch USING (feature, i)),
        rm AS (SELECT feature, AVG(value) AS reference_mean, STDDEV_POP(value) AS reference_std
               FROM rt GROUP BY feature),
        cm AS (SELECT feature, AVG(value) AS current_mean, STDDEV_POP(value) AS current_std
               FROM ct GROUP BY feature)
      SELECT feature, COALESCE(SUM((q - p) * LN(q / p)), 0) AS psi,
        COALESCE(SUM((q - p) * LN(q / p)), 0) > 0.25::DOUBLE AS is_drifted,
        MAX(reference_mean) AS reference_mean, MAX(current_mean) AS current_mean,
        MAX(reference_std) AS reference_std, MAX(current_std) AS current_std
      FROM rm JOIN cm USING (feature) LEFT JOIN s USING (feature) GROUP BY feature"""


def chi_sql(columns: list[str], sides: str) -> str:
    """Chi-square against the scaled reference, with the verdict from critical values."""
    return f"""WITH {sides},
        rt AS (SELECT feature, value, COUNT(*) AS n FROM ({tall(columns, 'r', cast='VARCHAR')})
               GROUP BY 1, 2),
        ct AS (SELECT feature, value, COUNT(*) AS n FROM ({tall(columns, 'c', cast='VARCHAR')})
               GROUP BY 1, 2),
        b AS (SELECT feature, value, COALESCE(rt.n, 0) AS a, COALESCE(ct.n, 0) AS o
              FROM rt FULL JOIN ct USING (feature, value)),
        x AS (SELECT feature, o, GREATEST(a * (SUM(o) OVER w / (SUM(a) OVER w)::DOUBLE),
                1e-6::DOUBLE) AS e FROM b WINDOW w AS (PARTITION BY feature)),
        t AS (SELECT feature, SUM((o - e) * (o - e) / e) AS statistic, COUNT(*) AS n_categories
              FROM x GROUP BY feature HAVING COUNT(*) >= 2)
      SELECT feature, statistic, n_categories, statistic > limit_05 AS is_drifted
      FROM t JOIN (VALUES {CRITICAL}) k(dof, limit_05) ON dof = n_categories - 1"""


PSI_ROUNDED = """feature, ROUND(psi, 6) AS psi, is_drifted,
  ROUND(reference_mean, 5) AS reference_mean, ROUND(current_mean, 5) AS current_mean,
  ROUND(reference_std, 5) AS reference_std, ROUND(current_std, 5) AS current_std"""


@query("d01_psi_one_feature", check(
    f"SELECT feature, ROUND(psi, 6) AS psi FROM ({psi_sql(['tenure'], DATED_VIEWS)})",
    "features"))
def d01(spark, sf_dir):
    return rounded(drift.psi(*dated_sides(spark, sf_dir), ["tenure"]).select("feature", "psi"))


@query("d02_psi_all_features", check(
    f"SELECT {PSI_ROUNDED} FROM ({psi_sql(K.NUMERIC, SPLIT_VIEWS)})", "features"))
def d02(spark, sf_dir):
    scores = drift.psi(*split_sides(spark, sf_dir), [*K.NUMERIC, "not_there"])
    return rounded(scores, 5, psi=6)


@query("d02_psi_shifted", check(
    f"SELECT {PSI_ROUNDED} FROM ({psi_sql(K.NUMERIC, DATED_VIEWS)})", "features"))
def d02_shifted(spark, sf_dir):
    return rounded(drift.psi(*dated_sides(spark, sf_dir), K.NUMERIC), 5, psi=6)


CHI_ROUNDED = "feature, ROUND(statistic, 5) AS statistic, n_categories, is_drifted"


@query("d03_categorical_drift", check(
    f"SELECT {CHI_ROUNDED} FROM ({chi_sql(K.CATEGORICAL, SPLIT_VIEWS)})", "features"))
def d03(spark, sf_dir):
    tested = drift.categorical_drift(*split_sides(spark, sf_dir), K.CATEGORICAL)
    return rounded(tested.drop("p_value"), 5)


@query("d03_categorical_drift_shifted", check(
    f"SELECT {CHI_ROUNDED} FROM ({chi_sql(K.CATEGORICAL, DATED_VIEWS)})", "features"))
def d03_shifted(spark, sf_dir):
    tested = drift.categorical_drift(*dated_sides(spark, sf_dir), K.CATEGORICAL)
    return rounded(tested.drop("p_value"), 5)


PREDICTION = """SELECT a AS reference_mean, b AS current_mean,
    ROUND(ABS(b - a) / a, 4) AS drift_score, ROUND(ABS(b - a) / a, 4) > 0.15::DOUBLE AS is_drifted
  FROM (SELECT (SELECT AVG(composite_churn_risk / 7.0::DOUBLE) FROM r) AS a,
          (SELECT AVG(composite_churn_risk / 7.0::DOUBLE) FROM c) AS b)"""


@query("d04_prediction_drift", check(
    f"WITH {DATED_VIEWS} SELECT ROUND(reference_mean, 6) AS reference_mean, "
    f"ROUND(current_mean, 6) AS current_mean, drift_score, is_drifted FROM ({PREDICTION})",
    "features"))
def d04(spark, sf_dir):
    return rounded(drift.prediction_drift(*dated_sides(spark, sf_dir)))


def findings_sql(sides: str) -> str:
    return f"""SELECT feature, 'psi' AS method, ROUND(psi, 4) AS score, is_drifted
        FROM ({psi_sql(K.NUMERIC + K.BINARY, sides)})
      UNION ALL SELECT feature, 'chi_squared', NULL, is_drifted
        FROM ({chi_sql(K.CATEGORICAL, sides)})"""


def _report_sql(sides: str) -> str:
    return check(f"""
        SELECT *, CASE WHEN overall_drift THEN 'Drift detected: ' || n_drifted || ' feature(s)'
              || CASE WHEN prediction_drifted THEN ', predictions' ELSE '' END || '. Drifted: '
              || REPLACE(drifted_features, ',', ', ')
            ELSE 'No significant drift in ' || n_numerical || ' numerical and ' || n_categorical
              || ' categorical features' END AS summary FROM (
        SELECT COUNT(*) FILTER (WHERE is_drifted) > 0
            OR (SELECT is_drifted FROM (WITH {sides} {PREDICTION})) AS overall_drift,
          COALESCE(STRING_AGG(feature, ',' ORDER BY feature) FILTER (WHERE is_drifted), '')
            AS drifted_features,
          COUNT(*) FILTER (WHERE method = 'psi') AS n_numerical,
          COUNT(*) FILTER (WHERE method = 'chi_squared') AS n_categorical,
          (SELECT drift_score FROM (WITH {sides} {PREDICTION})) AS prediction_score,
          (SELECT is_drifted FROM (WITH {sides} {PREDICTION})) AS prediction_drifted,
          COUNT(*) FILTER (WHERE is_drifted)::INT AS n_drifted,
          (WITH {sides} SELECT COUNT(*) FROM r) AS reference_rows,
          (WITH {sides} SELECT COUNT(*) FROM c) AS current_rows
        FROM ({findings_sql(sides)}))""", "features")


def _report(sides):
    # Both sides are read by every kind of test: worked out once.
    sides = [materialise(side, "sides") for side in sides]
    findings = drift.feature_findings(*sides, written=True)
    return drift.report(findings, drift.prediction_drift(*sides), *sides).drop("created_at")


@query("d05_drift_report", _report_sql(SPLIT_VIEWS))
def d05(spark, sf_dir):
    return _report(split_sides(spark, sf_dir))


@query("d05_drift_report_shifted", _report_sql(DATED_VIEWS))
def d05_shifted(spark, sf_dir):
    return _report(dated_sides(spark, sf_dir))


@query("d06_monitored_features", check(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{k}' AS kind, COUNT(DISTINCT {f}) AS distinct_values FROM features"
    for k, fs in (("categorical", K.CATEGORICAL), ("numerical", K.NUMERIC + K.BINARY))
    for f in fs), "features"))
def d06(spark, sf_dir):
    from lapsewatch.operators.profiling import column_profile
    rows = model_rows(spark, sf_dir)
    kinds = drift.monitored_features(rows)
    detected = spark.createDataFrame(list(kinds.items()), "feature string, kind string")
    profile = column_profile(rows.select(*kinds))
    return detected.join(profile.select(
        F.col("column_name").alias("feature"), "distinct_values"), "feature")


@query("d07_flat_scores", check("SELECT " + ", ".join(
    f"MAX(score) FILTER (WHERE feature = '{f}') AS drift_{f}" for f in K.NUMERIC + K.BINARY)
    + f" FROM ({findings_sql(DATED_VIEWS)})", "features"))
def d07(spark, sf_dir):
    numbers = {f: "numerical" for f in K.NUMERIC + K.BINARY}
    findings = drift.feature_findings(*dated_sides(spark, sf_dir), numbers)
    return drift.flat_scores(findings, list(numbers))


@query("d07_flat_scores_with_texts")
def d07_all(spark, sf_dir):
    """The flat row of all monitored features: text features by their p-value."""
    findings = drift.feature_findings(*dated_sides(spark, sf_dir))
    return drift.flat_scores(findings, K.NUMERIC + K.BINARY + K.CATEGORICAL)


@query("d08_drift_table", check(
    f"SELECT feature, method, score, is_drifted FROM ({findings_sql(DATED_VIEWS)}) "
    "WHERE method = 'psi'", "features"))
def d08(spark, sf_dir):
    numbers = {f: "numerical" for f in K.NUMERIC + K.BINARY}
    findings = drift.feature_findings(*dated_sides(spark, sf_dir), numbers)
    return findings.drop("threshold").orderBy(F.desc("score"))


@query("d08_drift_table_with_p_values")
def d08_p(spark, sf_dir):
    return drift.feature_findings(*dated_sides(spark, sf_dir)).orderBy(F.desc("score"))


@query("d09_monitoring_baseline", check("""
    SELECT COUNT(*) AS n_rows, 48 AS n_features, ROUND(AVG(label), 4) AS churn_rate,
      NULL::DOUBLE AS mean_prediction, 'baseline' AS model_version FROM features""", "features"))
def d09(spark, sf_dir):
    from lapsewatch.operators.quality import repair_total_charges, validate
    valid = validate(repair_total_charges(subscribers(spark, sf_dir)))
    rows = features.engineer(prepare.clean(valid))
    path = files.save_snapshot(rows, scratch_path(spark, "baseline"), model_version="baseline")
    return files.load_metadata(spark, path).drop("created_at", "feature_names")


@query("d10_severity", check(f"""
    SELECT feature, score, CASE WHEN score > 0.25::DOUBLE THEN 'significant'
      WHEN score >= 0.10::DOUBLE THEN 'moderate' ELSE 'none' END AS severity
    FROM ({findings_sql(DATED_VIEWS)}) WHERE method = 'psi'""", "features"))
def d10(spark, sf_dir):
    numbers = {f: "numerical" for f in K.NUMERIC + K.BINARY}
    findings = drift.feature_findings(*dated_sides(spark, sf_dir), numbers)
    return findings.select("feature", "score", drift.severity(F.col("score")).alias("severity"))


# ---- feature selection -------------------------------------------------------------------

CODES = "SELECT customerID, label, " + ", ".join(
    [f"(DENSE_RANK() OVER (ORDER BY {c}) - 1)::DOUBLE AS {c}" for c in K.CATEGORICAL]
    + [f"{c}::DOUBLE AS {c}" for c in K.NUMERIC + K.BINARY]) + " FROM features"


def codes(spark, sf_dir):
    return selection.encoded(model_rows(spark, sf_dir), K.MODEL_INPUTS)


@query("fs1_variance_filter", check(f"""
    SELECT feature, ROUND(v, 6) AS variance, v > 0.005::DOUBLE AS kept
    FROM (SELECT feature, VAR_POP(value) AS v FROM (WITH codes AS ({CODES})
          {tall(K.MODEL_INPUTS, 'codes')}) GROUP BY feature)""", "features"))
def fs1(spark, sf_dir):
    return rounded(selection.variance_filter(codes(spark, sf_dir), K.MODEL_INPUTS))


PLACES = ", ".join(f"('{c}', {i})" for i, c in enumerate(K.MODEL_INPUTS))


@query("fs2_correlation_filter", check(f"""
    WITH codes AS ({CODES}), cells AS ({tall(K.MODEL_INPUTS, 'codes', 'customerID')}),
      place(feature, pos) AS (VALUES {PLACES}),
      pr AS (SELECT a.feature AS fa, b.feature AS fb, CORR(a.value, b.value) AS r
             FROM cells a JOIN cells b USING (customerID) WHERE a.feature <> b.feature
             GROUP BY 1, 2),
      means AS (SELECT fa AS f, ROUND((SUM(ABS(r)) + 1) / (COUNT(r) + 1), 9) AS m
                FROM pr GROUP BY fa)
    SELECT fa AS feature_a, fb AS feature_b, ROUND(r, 6) AS r,
      CASE WHEN mb.m > ma.m THEN fb ELSE fa END AS dropped
    FROM pr JOIN place p ON p.feature = fa JOIN place q ON q.feature = fb
      JOIN means ma ON ma.f = fa JOIN means mb ON mb.f = fb
    WHERE p.pos < q.pos AND ABS(r) > 0.90::DOUBLE""", "features"))
def fs2(spark, sf_dir):
    pairs = significance.correlation_pairs(codes(spark, sf_dir), K.MODEL_INPUTS)
    losers = selection.correlation_losers(pairs, len(K.MODEL_INPUTS))
    return rounded(losers.select("feature_a", "feature_b", "r", "dropped"))


NINE = ", ".join(f"{i / 10}" for i in range(1, 10))
MI = f"""
    WITH nt AS ({tall(K.NUMERIC)}),
      cuts AS (SELECT feature, QUANTILE_CONT(value, [{NINE}]) AS cut FROM nt GROUP BY feature),
      t AS ({tall(K.CATEGORICAL + K.BINARY, cast='VARCHAR')}
        UNION ALL SELECT customerID, label, feature,
          CAST(LEN(LIST_FILTER(cut, lambda x: x < value)) AS VARCHAR) FROM nt JOIN cuts USING (feature)),
      n AS (SELECT feature, value, label, COUNT(*)::DOUBLE AS k FROM t GROUP BY ALL)
    SELECT feature, SUM(k / tot * LN(k * tot / (rw * cl))) AS mi_score
    FROM (SELECT *, SUM(k) OVER (PARTITION BY feature) AS tot,
            SUM(k) OVER (PARTITION BY feature, value) AS rw,
            SUM(k) OVER (PARTITION BY feature, label) AS cl FROM n) GROUP BY feature"""


def mi_scores(spark, sf_dir):
    return selection.mutual_information(
        model_rows(spark, sf_dir), K.CATEGORICAL + K.BINARY, K.NUMERIC)


@query("fs3_mutual_information", check(f"""
    SELECT feature, ROUND(mi_score, 6) AS mi_score,
      ROW_NUMBER() OVER (ORDER BY ROUND(q0.mi_score, 6) DESC, feature)::INT AS mi_rank
    FROM ({MI}) q0""", "features"))
def fs3(spark, sf_dir):
    return rounded(selection.ranked(mi_scores(spark, sf_dir), "mi_score", "mi_rank"))


def psi_of(n: str) -> str:
    """Digamma of a whole number: the harmonic sum before it, less Euler's constant; its series from 50 on."""
    x = f"({n})::DOUBLE"
    return (f"CASE WHEN {n} < 50 THEN COALESCE(LIST_SUM(LIST_TRANSFORM(RANGE(1, {n}), lambda i: 1.0::DOUBLE / i)), 0)"
            f" - 0.5772156649015329::DOUBLE ELSE LN({x}) - 0.5::DOUBLE / {x} - 1 / (12.0::DOUBLE * {x} * {x})"
            f" + 1 / (120.0::DOUBLE * {x} * {x} * {x} * {x}) END")


# Neighbours by lag and lead within the class, counts by looking up the last row before each end.
KNN = f"""
    WITH raw AS ({tall(K.NUMERIC)}),
      top AS (SELECT feature, {neighbours.SHIFT}::DOUBLE * GREATEST(1.0::DOUBLE, MAX(ABS(value))) AS f FROM raw GROUP BY 1),
      pts AS (SELECT feature, label, value + ({hash_share_sql('near:')} - 0.5::DOUBLE) * f AS v
              FROM raw JOIN top USING (feature)),
      near AS (SELECT feature, label, v, COUNT(*) OVER (PARTITION BY feature, label) AS size,
          [v, {", ".join(f"LAG(v, {j}) OVER w" for j in (1, 2, 3))}] AS b,
          [v, {", ".join(f"LEAD(v, {j}) OVER w" for j in (1, 2, 3))}] AS a
        FROM pts WINDOW w AS (PARTITION BY feature, label ORDER BY v)),
      rad AS (SELECT *, LIST_MIN([{", ".join(
          f"CASE WHEN b[{j + 1}] IS NOT NULL AND a[{4 - j}] IS NOT NULL THEN GREATEST(v - b[{j + 1}], a[{4 - j}] - v) END"
          for j in range(4))}]) AS r FROM near),
      cut AS (SELECT feature, size, COALESCE(LIST_MAX(LIST_FILTER(b, lambda x: v - x = r)), v - r) AS low,
          COALESCE(LIST_MIN(LIST_FILTER(a, lambda x: x - v = r)), v + r) AS high FROM rad),
      rnk AS (SELECT feature, v, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY v) AS k FROM pts),
      cnt AS (SELECT c.feature, size, h.k - COALESCE(l.k, 0) AS m FROM cut c
        ASOF JOIN rnk h ON c.feature = h.feature AND c.high > h.v
        ASOF LEFT JOIN rnk l ON c.feature = l.feature AND c.low >= l.v)
    SELECT feature, GREATEST({psi_of('COUNT(*)')} + {psi_of('3')} - AVG({psi_of('size')})
      - AVG({psi_of('m')}), 0) AS mi_score FROM cnt GROUP BY feature"""


@query("fs3_mutual_information_neighbours", check(
    f"SELECT feature, ROUND(mi_score, 6) AS mi_score, "
    f"ROW_NUMBER() OVER (ORDER BY ROUND(mi_score, 6) DESC, feature)::INT AS mi_rank FROM ({KNN})", "features"))
def fs3_neighbours(spark, sf_dir):
    """Numeric features by their three nearest neighbours of the same class."""
    scores = neighbours.neighbour_information(model_rows(spark, sf_dir), K.NUMERIC)
    return rounded(selection.ranked(scores, "mi_score", "mi_rank"))


CANDIDATES = K.NUMERIC + K.BINARY


@query("fs6_rank_consensus", check(f"""
    WITH m AS (SELECT feature, ROW_NUMBER() OVER (ORDER BY ROUND(mi_score, 6) DESC, feature) AS k
               FROM ({MI})),
      r AS (SELECT feature, ROW_NUMBER() OVER (ORDER BY ROUND(s, 6) DESC, feature) AS k
            FROM (SELECT feature, ABS(CORR(label, value)) AS s FROM ({tall(CANDIDATES)})
                  GROUP BY feature)),
      g AS (SELECT feature, ROW_NUMBER() OVER (ORDER BY ROUND(s, 6) DESC, feature) AS k
            FROM (SELECT feature, ABS(AVG(value) FILTER (WHERE label = 1)
                    - AVG(value) FILTER (WHERE label = 0)) AS s FROM ({tall(CANDIDATES)})
                  GROUP BY feature))
    SELECT feature, mi_rank, corr_rank, gap_rank, votes, votes >= 2 AS selected,
      ROUND((mi_rank + corr_rank + gap_rank) / 3.0::DOUBLE, 6) AS avg_rank
    FROM (SELECT m.feature, m.k AS mi_rank, COALESCE(r.k, 47) AS corr_rank,
            COALESCE(g.k, 47) AS gap_rank, (m.k <= 12)::INT + COALESCE((r.k <= 12)::INT, 0)
              + COALESCE((g.k <= 12)::INT, 0) AS votes
          FROM m LEFT JOIN r USING (feature) LEFT JOIN g USING (feature))""", "features"))
def fs6(spark, sf_dir):
    """Three rankings from the data: mutual information, |r| and the gap of class means."""
    from lapsewatch.operators.profiling import class_means
    rows = model_rows(spark, sf_dir)
    mi = selection.ranked(mi_scores(spark, sf_dir), "mi_score", "mi_rank")
    r = significance.point_biserial(rows, CANDIDATES).select("feature", F.abs("r").alias("s"))
    gap = class_means(rows, CANDIDATES).select(
        "feature", F.abs(F.col("mean_churned") - F.col("mean_retained")).alias("s"))
    chosen = selection.consensus(mi, {
        "mi_rank": mi, "corr_rank": selection.ranked(r, "s", "corr_rank"),
        "gap_rank": selection.ranked(gap, "s", "gap_rank")}, top_n=12)
    return rounded(chosen.withColumns({
        c: F.col(c).cast("bigint") for c in ("mi_rank", "corr_rank", "gap_rank")}))
