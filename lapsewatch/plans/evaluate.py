"""Queries for evaluation, fairness, conformal sets, uplift and model comparison (Q, B, C, U, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapsewatch import constants as K
from lapsewatch.functions.scalars import named, tall
from lapsewatch.operators import comparison, conformal, fairness, leaderboard, metrics, splitting, uplift
from lapsewatch.plans.explore import hash_share_sql, rounded
from lapsewatch.plans.intake import model_rows
from lapsewatch.plans.oracle import check
from lapsewatch.plans.registry import query
from lapsewatch.session import scratch_path
from lapsewatch.sources.tables import scored

CUT = 0.30  # threshold used by the single-threshold queries

COUNTS = """COUNT(*) FILTER (WHERE prob >= {t} AND label = 1) AS tp,
  COUNT(*) FILTER (WHERE prob >= {t} AND label = 0) AS fp,
  COUNT(*) FILTER (WHERE prob < {t} AND label = 1) AS fn,
  COUNT(*) FILTER (WHERE prob < {t} AND label = 0) AS tn"""
AT_CUT = COUNTS.format(t="0.30::DOUBLE")
RATIOS = """COALESCE(tp / NULLIF(tp + fp, 0)::DOUBLE, 0) AS precision,
  COALESCE(tp / NULLIF(tp + fn, 0)::DOUBLE, 0) AS recall,
  COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1"""
COSTS = """fn * 500.0::DOUBLE AS fn_cost, fp * 20.0::DOUBLE AS fp_cost,
  fn * 500.0::DOUBLE + fp * 20.0::DOUBLE AS total_cost,
  (tp + fn) * 500.0::DOUBLE AS baseline_cost,
  (tp + fn) * 500.0::DOUBLE - fn * 500.0::DOUBLE - fp * 20.0::DOUBLE AS savings"""


def ranking_sql(view: str, by: str = "") -> str:
    """ROC-AUC from mid-ranks and average precision from running precision."""
    part, also = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    within = f"PARTITION BY {by}, prob" if by else "PARTITION BY prob"
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {also}COUNT(*) AS rows,
        (SUM(mid) FILTER (WHERE label = 1) - SUM(label) * (SUM(label) + 1) / 2.0::DOUBLE)
          / (SUM(label) * (COUNT(*) - SUM(label)))::DOUBLE AS roc_auc,
        SUM(running) FILTER (WHERE label = 1) / SUM(label) AS average_precision
      FROM (SELECT *, RANK() OVER ({part} ORDER BY prob)
              + (COUNT(*) OVER ({within}) - 1) / 2.0::DOUBLE AS mid,
              SUM(label) OVER ({part} ORDER BY prob DESC)
              / (COUNT(*) OVER ({part} ORDER BY prob DESC))::DOUBLE AS running
            FROM {view}) {group}"""


def sweep_sql(view: str, by: str = "") -> str:
    also = f"{by}, " if by else ""
    return f"""SELECT *, {RATIOS}, {COSTS} FROM (
        SELECT {also}threshold, {COUNTS.format(t='threshold')}
        FROM {view}, (SELECT i / 100.0::DOUBLE AS threshold
                      FROM (SELECT UNNEST(RANGE(1, 100)) AS i))
        GROUP BY ALL)"""


# ---- thresholds and ranking --------------------------------------------------------------

@query("q01_confusion", check(f"SELECT {AT_CUT} FROM scored", "scored"))
def q01(spark, sf_dir):
    return metrics.confusion(scored(spark, sf_dir), CUT)


@query("q02_precision_recall_f1", check(
    "SELECT ROUND(precision, 4) AS precision, ROUND(recall, 4) AS recall, ROUND(f1, 4) AS f1 "
    f"FROM (SELECT {RATIOS} FROM (SELECT {AT_CUT} FROM scored))", "scored"))
def q02(spark, sf_dir):
    counts = metrics.confusion(scored(spark, sf_dir), CUT)
    return rounded(counts.select(*[
        c.alias(n) for n, c in metrics.precision_recall_f1().items()]), 4)


@query("q03_roc_auc", check(
    f"SELECT ROUND(roc_auc, 6) AS roc_auc FROM ({ranking_sql('scored')})", "scored"))
def q03(spark, sf_dir):
    return metrics.ranking_scores(scored(spark, sf_dir)).select(
        named(F.col("roc_auc"), "roc_auc", 6))


@query("q04_average_precision", check(
    f"SELECT ROUND(average_precision, 6) AS average_precision FROM ({ranking_sql('scored')})",
    "scored"))
def q04(spark, sf_dir):
    return metrics.ranking_scores(scored(spark, sf_dir)).select(
        named(F.col("average_precision"), "average_precision", 6))


@query("q05_business_cost", check(
    f"SELECT *, {COSTS} FROM (SELECT {AT_CUT} FROM scored)", "scored"))
def q05(spark, sf_dir):
    return metrics.confusion(scored(spark, sf_dir), CUT).withColumns(metrics.cost_columns())


@query("q06_flat_metrics", check(f"""
    SELECT tp, fp, fn, tn, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall,
      ROUND(f1, 6) AS f1, fn_cost, fp_cost, total_cost, baseline_cost, savings, rows,
      ROUND(roc_auc, 6) AS roc_auc, ROUND(average_precision, 6) AS average_precision
    FROM (SELECT *, {RATIOS}, {COSTS} FROM (SELECT {AT_CUT} FROM scored)),
      ({ranking_sql('scored')})""", "scored"))
def q06(spark, sf_dir):
    return rounded(metrics.flat_metrics(scored(spark, sf_dir), CUT))


SWEEP_ROUNDED = """threshold, tp, fp, fn, tn, ROUND(precision, 6) AS precision,
  ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1, fn_cost, fp_cost, total_cost, baseline_cost,
  savings"""


@query("q07_threshold_sweep", check(
    f"SELECT {SWEEP_ROUNDED} FROM ({sweep_sql('scored')})", "scored"))
def q07(spark, sf_dir):
    return rounded(metrics.threshold_sweep(scored(spark, sf_dir)))


@query("q08_cost_optimal_threshold", check(
    f"SELECT threshold, total_cost FROM ({sweep_sql('scored')}) "
    "ORDER BY total_cost, threshold LIMIT 1", "scored"))
def q08(spark, sf_dir):
    return metrics.cost_optimal(metrics.threshold_sweep(scored(spark, sf_dir)))


@query("q09_f1_optimal_threshold", check(
    f"SELECT threshold, ROUND(f1, 6) AS f1 FROM ({sweep_sql('scored')}) q0 "
    "ORDER BY q0.f1 DESC, threshold LIMIT 1", "scored"))
def q09(spark, sf_dir):
    return rounded(metrics.f1_optimal(metrics.threshold_sweep(scored(spark, sf_dir))))


@query("q10_risk_tier", check("""
    SELECT customerID, prob, CASE WHEN prob >= 0.60::DOUBLE THEN 'HIGH'
      WHEN prob >= 0.35::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM scored""", "scored"))
def q10(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "customerID", "prob", metrics.risk_tier(F.col("prob")).alias("tier"))


@query("q11_curve_points", check("""
    SELECT DISTINCT threshold, ROUND(fpr, 6) AS fpr, ROUND(tpr, 6) AS tpr,
      ROUND(precision, 6) AS precision FROM (
      SELECT prob AS threshold,
        SUM(1 - label) OVER (ORDER BY prob DESC) / (SUM(1 - label) OVER ())::DOUBLE AS fpr,
        SUM(label) OVER (ORDER BY prob DESC) / (SUM(label) OVER ())::DOUBLE AS tpr,
        SUM(label) OVER (ORDER BY prob DESC) / (COUNT(*) OVER (ORDER BY prob DESC))::DOUBLE
          AS precision FROM scored)""", "scored"))
def q11(spark, sf_dir):
    return rounded(metrics.curve_points(scored(spark, sf_dir)))


# ---- calibration -------------------------------------------------------------------------

def bins_sql(view: str, by: str = "", prob: str = "prob") -> str:
    """Bins by a range join with literal edges."""
    also = f"{by}, " if by else ""
    return f"""SELECT {also}bin, bin / 10.0::DOUBLE AS lower, (bin + 1) / 10.0::DOUBLE AS upper,
        COUNT(*) AS count, AVG(label) AS accuracy, AVG({prob}) AS confidence,
        SUM(label)::BIGINT AS pos
      FROM {view} JOIN (SELECT UNNEST(RANGE(0, 10))::INT AS bin) b
        ON ({prob} > bin / 10.0::DOUBLE OR (bin = 0 AND {prob} = 0))
          AND {prob} <= (bin + 1) / 10.0::DOUBLE
      GROUP BY ALL"""


def errors_sql(view: str, by: str = "", prob: str = "prob") -> str:
    part, group = (f"PARTITION BY {by}", f"GROUP BY {by}") if by else ("", "")
    also = f"{by}, " if by else ""
    return f"""SELECT {also}SUM(count / n * ABS(accuracy - confidence)) AS ece,
        MAX(ABS(accuracy - confidence)) AS mce,
        SUM(count / n * POWER(confidence - accuracy, 2)) AS reliability,
        SUM(count / n * POWER(accuracy - base, 2)) AS resolution,
        MAX(base) * (1 - MAX(base)) AS uncertainty, MAX(base) AS base_rate
      FROM (SELECT *, (SUM(count) OVER ({part}))::DOUBLE AS n,
              SUM(pos) OVER ({part}) / (SUM(count) OVER ({part}))::DOUBLE AS base
            FROM ({bins_sql(view, by, prob)})) {group}"""


@query("q12_calibration_bins", check(
    "SELECT bin, lower, upper, count, ROUND(accuracy, 6) AS accuracy, "
    f"ROUND(confidence, 6) AS confidence FROM ({bins_sql('scored')})", "scored"))
def q12(spark, sf_dir):
    return rounded(metrics.calibration_bins(scored(spark, sf_dir))).drop("pos")


def _errors(spark, sf_dir):
    return metrics.calibration_errors(metrics.calibration_bins(scored(spark, sf_dir)))


@query("q13_expected_calibration_error", check(
    f"SELECT ROUND(ece, 6) AS ece FROM ({errors_sql('scored')})", "scored"))
def q13(spark, sf_dir):
    return rounded(_errors(spark, sf_dir).select("ece"))


@query("q14_maximum_calibration_error", check(
    f"SELECT ROUND(mce, 6) AS mce FROM ({errors_sql('scored')})", "scored"))
def q14(spark, sf_dir):
    return rounded(_errors(spark, sf_dir).select("mce"))


@query("q15_brier_parts", check(f"""
    SELECT ROUND((SELECT AVG(POWER(prob - label, 2)) FROM scored), 6) AS brier_score,
      ROUND(reliability, 6) AS reliability, ROUND(resolution, 6) AS resolution,
      ROUND(uncertainty, 6) AS uncertainty, ROUND(base_rate, 4) AS base_rate
    FROM ({errors_sql('scored')})""", "scored"))
def q15(spark, sf_dir):
    score = scored(spark, sf_dir).agg(metrics.brier().alias("b")).scalar()
    parts = _errors(spark, sf_dir).withColumn("brier_score", score)
    return rounded(parts.select("brier_score", "reliability", "resolution", "uncertainty",
                                "base_rate"), 6, base_rate=4)


@query("q16_reliability_diagram", check(f"""
    SELECT ROUND((lower + upper) / 2, 3) AS midpoint, ROUND(accuracy, 4) AS fraction_positives,
      ROUND(confidence, 4) AS mean_predicted, count AS bin_count FROM ({bins_sql('scored')})""",
    "scored"))
def q16(spark, sf_dir):
    bins = metrics.calibration_bins(scored(spark, sf_dir))
    return bins.select(
        named((F.col("lower") + F.col("upper")) / 2.0, "midpoint", 3),
        named(F.col("accuracy"), "fraction_positives", 4),
        named(F.col("confidence"), "mean_predicted", 4), F.col("count").alias("bin_count"))


# A fixed logistic recalibration gives the second set of probabilities to compare.
RECALIBRATED = "1 / (1 + EXP(-(-2.4::DOUBLE + 4.0::DOUBLE * prob)))"


@query("q17_calibration_report", check(f"""
    WITH two AS (SELECT 'before' AS stage, label, prob FROM scored
                 UNION ALL SELECT 'after', label, {RECALIBRATED} FROM scored),
      r AS (SELECT e.*, b.brier FROM ({errors_sql('two', 'stage')}) e
            JOIN (SELECT stage, AVG(POWER(prob - label, 2)) AS brier FROM two GROUP BY 1) b
            USING (stage))
    SELECT {", ".join(f"ROUND(p.{m}, 6) AS {m}_before, ROUND(a.{m}, 6) AS {m}_after"
                      for m in ("ece", "mce", "brier", "reliability", "resolution"))},
      {", ".join(f"ROUND(a.{m} - p.{m}, 6) AS {m}_delta" for m in ("ece", "mce", "brier"))}
    FROM r p, r a WHERE p.stage = 'before' AND a.stage = 'after'""", "scored"))
def q17(spark, sf_dir):
    from lapsewatch.operators.calibration import compare_stages
    rows = scored(spark, sf_dir).withColumn(
        "after", 1.0 / (1.0 + F.exp(-(F.lit(-2.4) + F.lit(4.0) * F.col("prob")))))
    return rounded(compare_stages(rows, before="prob", after="after"))


@query("q18_what_if", check("""
    SELECT Contract, population, ROUND(churn_rate, 6) AS churn_rate, churners, true_positives,
      false_negatives, false_positives, baseline_cost, model_cost,
      baseline_cost - model_cost AS savings,
      ROUND((baseline_cost - model_cost) * 100 / model_cost, 6) AS roi_percent
    FROM (SELECT *, churners * 500.0::DOUBLE AS baseline_cost,
        false_negatives * 500.0::DOUBLE + false_positives * 20.0::DOUBLE AS model_cost
      FROM (SELECT *, churners - true_positives AS false_negatives,
          FLOOR(true_positives * (1 / 0.5::DOUBLE - 1))::BIGINT AS false_positives
        FROM (SELECT *, FLOOR(churners * 0.75::DOUBLE)::BIGINT AS true_positives
          FROM (SELECT Contract, COUNT(*) AS population, AVG(label) AS churn_rate,
              FLOOR(COUNT(*) * AVG(label))::BIGINT AS churners
            FROM scored GROUP BY Contract))))""", "scored"))
def q18(spark, sf_dir):
    segments = scored(spark, sf_dir).groupBy("Contract").agg(
        F.count(F.lit(1)).alias("population"),
        F.avg(F.col("label").cast("double")).alias("churn_rate"))
    return rounded(metrics.what_if(segments, recall=0.75, precision=0.5))


# ---- fairness ----------------------------------------------------------------------------

ATTRIBUTES = ["gender", "SeniorCitizen", "InternetService"]
BY_ATTRIBUTE = " UNION ALL ".join(
    f"SELECT '{a}' AS attribute, CAST({a} AS VARCHAR) AS \"group\", label, prob, "
    f"(prob >= 0.30::DOUBLE)::INT AS flagged FROM scored" for a in ATTRIBUTES)
GROUP = 'attribute, "group"'


@query("b01_group_metrics", check(f"""
    WITH t AS ({BY_ATTRIBUTE})
    SELECT attribute, "group", n AS n_samples, ROUND(g.base_rate, 4) AS base_rate,
      ROUND(positive_rate, 4) AS positive_rate, ROUND(precision, 4) AS precision,
      ROUND(recall, 4) AS recall, ROUND(f1, 4) AS f1, ROUND(roc_auc, 4) AS roc_auc,
      ROUND(ece, 6) AS ece
    FROM (SELECT *, {RATIOS} FROM (SELECT {GROUP}, COUNT(*) AS n, AVG(label) AS base_rate,
            AVG(flagged) AS positive_rate, {AT_CUT} FROM t GROUP BY {GROUP})) g
      JOIN ({ranking_sql('t', GROUP)}) USING ({GROUP})
      JOIN ({errors_sql('t', GROUP)}) e USING ({GROUP})""", "scored"))
def b01(spark, sf_dir):
    return fairness.group_metrics(scored(spark, sf_dir), ATTRIBUTES, CUT)


PARITY = f"""SELECT attribute, COALESCE(ROUND(MIN(rate) / NULLIF(MAX(rate), 0), 4), 0)
    AS parity_ratio,
    COALESCE(ROUND(MIN(rate) / NULLIF(MAX(rate), 0), 4), 0) >= 0.8::DOUBLE AS passes,
    FIRST("group" ORDER BY rate, "group") AS min_rate_group,
    FIRST("group" ORDER BY rate DESC, "group") AS max_rate_group
  FROM (SELECT {GROUP}, ROUND(AVG(flagged), 4) AS rate FROM t GROUP BY {GROUP})
  GROUP BY attribute"""


@query("b02_demographic_parity", check(f"WITH t AS ({BY_ATTRIBUTE}) {PARITY}", "scored"))
def b02(spark, sf_dir):
    return fairness.demographic_parity(scored(spark, sf_dir), ATTRIBUTES, CUT)


ODDS = f"""SELECT *, tpr_disparity < 0.1::DOUBLE AND fpr_disparity < 0.1::DOUBLE AS satisfies
  FROM (SELECT attribute, ROUND(MAX(tpr) - MIN(tpr), 4) AS tpr_disparity,
      ROUND(MAX(fpr) - MIN(fpr), 4) AS fpr_disparity
    FROM (SELECT {GROUP}, ROUND(AVG(flagged) FILTER (WHERE label = 1), 4) AS tpr,
        ROUND(AVG(flagged) FILTER (WHERE label = 0), 4) AS fpr FROM t GROUP BY {GROUP})
    GROUP BY attribute)"""


@query("b03_equalised_odds", check(f"WITH t AS ({BY_ATTRIBUTE}) {ODDS}", "scored"))
def b03(spark, sf_dir):
    return fairness.equalised_odds(scored(spark, sf_dir), ATTRIBUTES, CUT)


@query("b04_fairness_audit", check(f"""
    WITH t AS ({BY_ATTRIBUTE})
    SELECT attribute, parity_ratio, passes AS parity_passes, tpr_disparity, fpr_disparity,
      satisfies AS odds_pass, BOOL_AND(passes AND satisfies) OVER () AS overall_fair
    FROM ({PARITY}) JOIN ({ODDS}) USING (attribute)""", "scored"))
def b04(spark, sf_dir):
    return fairness.audit(scored(spark, sf_dir), ATTRIBUTES, CUT)


# ---- conformal ---------------------------------------------------------------------------

PARTS = splitting.WITH_CALIBRATION
SPLIT_CASE = ("CASE WHEN s < 0.6::DOUBLE THEN 'train' WHEN s < 0.7::DOUBLE THEN 'isotonic' "
              "WHEN s < 0.8::DOUBLE THEN 'conformal' ELSE 'test' END")
WITH_PARTS = f"SELECT *, {SPLIT_CASE} AS split FROM (SELECT *, {hash_share_sql()} AS s FROM scored)"
QUANTILES = f"""
    SELECT c AS confidence, COALESCE(MIN(score) FILTER (WHERE place >= CEIL(
        (n + 1) * ROUND(c * 1000) / 1000)), 1)::DOUBLE AS quantile
    FROM (SELECT CASE WHEN label = 1 THEN 1 - prob ELSE prob END AS score,
            ROW_NUMBER() OVER (ORDER BY CASE WHEN label = 1 THEN 1 - prob ELSE prob END) AS place,
            COUNT(*) OVER () AS n
          FROM ({WITH_PARTS}) WHERE split = 'conformal'),
      (SELECT UNNEST([0.9::DOUBLE, 0.95::DOUBLE]) AS c) GROUP BY c"""
SETS = f"""
    SELECT customerID, label, confidence, (1 - prob) <= quantile AS includes_churn,
      prob <= quantile AS includes_no_churn,
      ((1 - prob) <= quantile)::INT + (prob <= quantile)::INT AS set_size
    FROM (SELECT * FROM ({WITH_PARTS}) WHERE split = 'test'), ({QUANTILES})"""


def _parts(spark, sf_dir):
    rows = splitting.add_split(scored(spark, sf_dir), PARTS)
    return rows.where("split = 'conformal'"), rows.where("split = 'test'")


def _sets(spark, sf_dir):
    held, test = _parts(spark, sf_dir)
    return conformal.prediction_sets(
        test.select("customerID", "label", "prob"), conformal.calibrate(held))


@query("c01_conformal_quantiles", check(
    f"SELECT confidence, ROUND(quantile, 6) AS quantile FROM ({QUANTILES})", "scored"))
def c01(spark, sf_dir):
    return rounded(conformal.calibrate(_parts(spark, sf_dir)[0]))


@query("c02_prediction_sets", check(
    f"SELECT customerID, confidence, includes_churn, includes_no_churn FROM ({SETS})", "scored"))
def c02(spark, sf_dir):
    return _sets(spark, sf_dir).select(
        "customerID", "confidence", "includes_churn", "includes_no_churn")


@query("c03_set_summary", check(
    f"SELECT customerID, confidence, set_size, set_size = 2 AS is_uncertain FROM ({SETS})",
    "scored"))
def c03(spark, sf_dir):
    return _sets(spark, sf_dir).select("customerID", "confidence", "set_size", "is_uncertain")


@query("c04_coverage_report", check(f"""
    SELECT confidence, n, ROUND(coverage, 6) AS coverage,
      ROUND(coverage - confidence, 6) AS coverage_gap, ROUND(mean_set_size, 6) AS mean_set_size,
      empty_sets, singletons, ambiguous, ROUND(singletons / n::DOUBLE, 6) AS singleton_rate
    FROM (SELECT confidence, COUNT(*) AS n, AVG((CASE WHEN label = 1 THEN includes_churn
            ELSE includes_no_churn END)::INT) AS coverage, AVG(set_size) AS mean_set_size,
          COUNT(*) FILTER (WHERE set_size = 0) AS empty_sets,
          COUNT(*) FILTER (WHERE set_size = 1) AS singletons,
          COUNT(*) FILTER (WHERE set_size = 2) AS ambiguous
        FROM ({SETS}) GROUP BY confidence)""", "scored"))
def c04(spark, sf_dir):
    return rounded(conformal.coverage_report(_sets(spark, sf_dir)))


@query("c05_saved_quantiles", check(
    f"SELECT confidence, ROUND(quantile, 6) AS quantile FROM ({QUANTILES})", "scored"))
def c05(spark, sf_dir):
    path = conformal.save_quantiles(
        conformal.calibrate(_parts(spark, sf_dir)[0]), scratch_path(spark, "conformal"))
    return rounded(spark.read.parquet(path))


# ---- uplift ------------------------------------------------------------------------------

STRATA = ["Contract", "InternetService", "tenure_group"]
ELIGIBLE = """SELECT customerID, Contract, InternetService, tenure_group, label,
    CASE WHEN TechSupport = 'Yes' THEN 1 ELSE 0 END AS treated
  FROM features WHERE InternetService <> 'No'"""
EFFECTS = f"""SELECT e.customerID, r.base AS base_churn_prob, r.treated_rate - r.base AS cate
  FROM ({ELIGIBLE}) e LEFT JOIN (
    SELECT Contract, InternetService, tenure_group, AVG(label) FILTER (WHERE treated = 0) AS base,
      AVG(label) FILTER (WHERE treated = 1) AS treated_rate FROM ({ELIGIBLE}) GROUP BY 1, 2, 3) r
  USING (Contract, InternetService, tenure_group)
  WHERE treated = 0"""
QUADRANT = """CASE WHEN base_churn_prob >= 0.5::DOUBLE AND cate <= -0.05::DOUBLE
    THEN 'Persuadable (Target)'
  WHEN base_churn_prob < 0.5::DOUBLE AND cate <= 0 THEN 'Sure Thing (Ignore)'
  WHEN base_churn_prob >= 0.5::DOUBLE AND cate > -0.05::DOUBLE THEN 'Lost Cause (Ignore)'
  WHEN base_churn_prob < 0.5::DOUBLE AND cate > 0 THEN 'Sleeping Dog (Do Not Disturb)'
  ELSE 'Unknown' END AS uplift_segment"""


def _effects(spark, sf_dir):
    return uplift.stratum_effects(uplift.eligible(model_rows(spark, sf_dir)), STRATA)


@query("u01_eligible", check(
    f"SELECT customerID, treated, label FROM ({ELIGIBLE})", "features"))
def u01(spark, sf_dir):
    return uplift.eligible(model_rows(spark, sf_dir)).select("customerID", "treated", "label")


@query("u03_stratum_effects", check(
    "SELECT customerID, ROUND(base_churn_prob, 6) AS base_churn_prob, ROUND(cate, 6) AS cate "
    f"FROM ({EFFECTS})", "features"))
def u03(spark, sf_dir):
    return rounded(_effects(spark, sf_dir).select("customerID", "base_churn_prob", "cate"))


@query("u04_quadrants", check(f"SELECT customerID, {QUADRANT} FROM ({EFFECTS})", "features"))
def u04(spark, sf_dir):
    return uplift.segment(_effects(spark, sf_dir)).select("customerID", "uplift_segment")


@query("u05_segment_summary", check(f"""
    SELECT uplift_segment, COUNT(*) AS customers, ROUND(AVG(cate), 6) AS mean_cate
    FROM (SELECT cate, {QUADRANT} FROM ({EFFECTS})) GROUP BY uplift_segment""", "features"))
def u05(spark, sf_dir):
    return rounded(uplift.segment_summary(uplift.segment(_effects(spark, sf_dir))))


# ---- leaderboards ------------------------------------------------------------------------
# The scorecards play the part of trained models: every number can be checked in SQL.

FOLDS = 5
SCAN = {"Contract": "contract_prob", "Internet": "internet_prob", "Tenure": "tenure_prob",
        "Dummy": "dummy_prob"}
# The "tuned" version of each scorecard adds half of the full score.
TUNED = {"Contract": "contract_prob", "Internet": "internet_prob", "Tenure": "tenure_prob"}


def _cards(spark, sf_dir, columns, blend=0.0, extra=None):
    """(model, customerID, label, fold, prob) rows of several scorecards."""
    rows = splitting.add_fold(scored(spark, sf_dir), FOLDS)
    mixed = {m: F.col(c) * (1.0 - blend) + F.col("prob") * blend for m, c in columns.items()}
    mixed |= {m: F.col(c) for m, c in (extra or {}).items()}
    return rows.select("customerID", "label", "fold", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), c.alias("prob")) for m, c in mixed.items()])))


def _cards_sql(columns, blend=0.0, extra=None) -> str:
    fold = f"FLOOR({hash_share_sql('fold:')} * {FOLDS})::INT AS fold"
    mixed = {m: f"{c} * {1.0 - blend}::DOUBLE + prob * {blend}::DOUBLE"
             for m, c in columns.items()}
    mixed |= extra or {}
    return " UNION ALL ".join(
        f"SELECT customerID, label, {fold}, '{m}' AS model, {c} AS prob FROM scored"
        for m, c in mixed.items())


FULL = {"Full": "prob"}


def scan_rows(spark, sf_dir):
    return _cards(spark, sf_dir, SCAN)


def tuned_rows(spark, sf_dir):
    return _cards(spark, sf_dir, TUNED, 0.5, FULL)


SCAN_SQL, TUNED_SQL = _cards_sql(SCAN), _cards_sql(TUNED, 0.5, FULL)


def _cv_sql(view: str) -> str:
    return f"""SELECT model, AVG(average_precision) AS cv_pr_auc_mean,
        STDDEV_POP(average_precision) AS cv_pr_auc_std, AVG(roc_auc) AS cv_roc_auc_mean,
        STDDEV_POP(roc_auc) AS cv_roc_auc_std, COUNT(*) AS folds
      FROM ({ranking_sql(view, 'model, fold')}) GROUP BY model"""


def scan_board(spark, sf_dir):
    return leaderboard.cv_summary(leaderboard.fold_scores(scan_rows(spark, sf_dir)))


def tuned_board(spark, sf_dir):
    return leaderboard.cv_summary(leaderboard.fold_scores(tuned_rows(spark, sf_dir)))


CV_ROUNDED = ("model, folds, ROUND(cv_pr_auc_mean, 6) AS cv_pr_auc_mean, "
              "ROUND(cv_pr_auc_std, 6) AS cv_pr_auc_std, "
              "ROUND(cv_roc_auc_mean, 6) AS cv_roc_auc_mean, "
              "ROUND(cv_roc_auc_std, 6) AS cv_roc_auc_std")


@query("m03_class_weights", check("""
    SELECT label, COUNT(*) AS n,
      ROUND((SELECT COUNT(*) FROM scored) / (2.0::DOUBLE * COUNT(*)), 6) AS balanced_weight,
      CASE WHEN label = 1 THEN 2.76::DOUBLE ELSE 1.0::DOUBLE END AS fixed_weight
    FROM scored GROUP BY label""", "scored"))
def m03(spark, sf_dir):
    from lapsewatch.operators.training import class_weights
    return rounded(class_weights(scored(spark, sf_dir)))


@query("m04_cv_summary", check(
    f"WITH t AS ({TUNED_SQL}) SELECT {CV_ROUNDED} FROM ({_cv_sql('t')})", "scored"))
def m04(spark, sf_dir):
    return rounded(tuned_board(spark, sf_dir))


@query("m07_release_gates", check(f"""
    SELECT ROUND(roc_auc, 6) AS roc_auc, ROUND(average_precision, 6) AS average_precision,
      ROUND(recall, 6) AS recall,
      roc_auc >= 0.82::DOUBLE AND average_precision >= 0.65::DOUBLE AND recall >= 0.70::DOUBLE
        AS passed,
      roc_auc >= 0.60::DOUBLE AND average_precision >= 0.30::DOUBLE AND recall >= 0.50::DOUBLE
        AS passed_relaxed
    FROM (SELECT {RATIOS} FROM (SELECT {AT_CUT} FROM scored)), ({ranking_sql('scored')})""",
    "scored"))
def m07(spark, sf_dir):
    row = metrics.flat_metrics(scored(spark, sf_dir), CUT)
    return rounded(row.select(
        "roc_auc", "average_precision", "recall", metrics.passes_gates().alias("passed"),
        metrics.passes_gates(0.60, 0.30, 0.50).alias("passed_relaxed")))


@query("m08_scan_leaderboard", check(
    f"WITH t AS ({SCAN_SQL}) SELECT {CV_ROUNDED} FROM ({_cv_sql('t')})", "scored"))
def m08(spark, sf_dir):
    return rounded(scan_board(spark, sf_dir).orderBy(F.desc("cv_pr_auc_mean")))


@query("m10_tuning_lift", check(f"""
    WITH s AS ({SCAN_SQL}), t AS ({TUNED_SQL})
    SELECT model, ROUND(a.cv_pr_auc_mean, 6) AS scan_cv_pr_auc,
      ROUND(b.cv_pr_auc_mean, 6) AS tuned_cv_pr_auc,
      ROUND(b.cv_pr_auc_mean - a.cv_pr_auc_mean, 4) AS lift
    FROM (SELECT * FROM ({_cv_sql('s')}) WHERE model <> 'Dummy'
          ORDER BY cv_pr_auc_mean DESC, model LIMIT 5) a JOIN ({_cv_sql('t')}) b USING (model)""",
    "scored"))
def m10(spark, sf_dir):
    return rounded(leaderboard.tuning_lift(scan_board(spark, sf_dir), tuned_board(spark, sf_dir)))


@query("m11_running_best", check(f"""
    WITH t AS ({TUNED_SQL})
    SELECT model AS study, ROUND(threshold * 100)::INT AS trial, ROUND(f1, 6) AS value,
      ROUND(MAX(f1) OVER (PARTITION BY model ORDER BY threshold), 6) AS running_best
    FROM ({sweep_sql('t', 'model')}) q0""", "scored"))
def m11(spark, sf_dir):
    trials = metrics.threshold_sweep(tuned_rows(spark, sf_dir), ["model"]).select(
        F.col("model").alias("study"), F.round(F.col("threshold") * 100).cast("int")
        .alias("trial"), F.col("f1").alias("value"))
    return rounded(leaderboard.running_best(trials))


TEST_ROWS = f"SELECT * FROM t WHERE {hash_share_sql()} >= 0.8::DOUBLE"


def _final_sql() -> str:
    return f"""SELECT model, threshold, precision, recall, f1, savings, rows, roc_auc,
        average_precision AS pr_auc, cv_pr_auc_mean
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY model ORDER BY total_cost, threshold) AS k
            FROM ({sweep_sql('test_rows', 'model')}))
        JOIN ({ranking_sql('test_rows', 'model')}) USING (model)
        JOIN (SELECT model, cv_pr_auc_mean FROM ({_cv_sql('t')})) USING (model) WHERE k = 1"""


FINAL_WITH = f"WITH t AS ({TUNED_SQL}), test_rows AS ({TEST_ROWS}), f AS ({_final_sql()})"
FINAL_ROUNDED = ", ".join(
    f"ROUND({c}, 6) AS {c}" for c in ("precision", "recall", "f1", "roc_auc", "pr_auc",
                                      "cv_pr_auc_mean")) + ", model, threshold, savings, rows"


def final_board(spark, sf_dir):
    rows = splitting.add_split(tuned_rows(spark, sf_dir), splitting.TRAIN_TEST)
    final = leaderboard.final_results(rows.where("split = 'test'"))
    return final.join(tuned_board(spark, sf_dir).select("model", "cv_pr_auc_mean"), "model")


@query("m12_champion_by_gates", check(f"""
    {FINAL_WITH} SELECT {FINAL_ROUNDED}, TRUE AS passes_gates FROM f
    WHERE f.roc_auc >= 0.60::DOUBLE AND f.pr_auc >= 0.30::DOUBLE AND f.recall >= 0.50::DOUBLE
      AND f.precision >= 0.20::DOUBLE
    ORDER BY f.cv_pr_auc_mean DESC, f.pr_auc DESC, savings DESC, model LIMIT 1""", "scored"))
def m12(spark, sf_dir):
    gated = leaderboard.with_gates(final_board(spark, sf_dir), 0.60, 0.30, 0.50, 0.20)
    return rounded(leaderboard.champion(gated))


@query("m12_champion_fallback", check(f"""
    {FINAL_WITH} SELECT {FINAL_ROUNDED}, FALSE AS passes_gates FROM f
    ORDER BY f.cv_pr_auc_mean DESC, f.pr_auc DESC, model LIMIT 1""", "scored"))
def m12_fallback(spark, sf_dir):
    return rounded(leaderboard.champion(leaderboard.with_gates(final_board(spark, sf_dir))))


@query("m13_final_summary", check(f"""
    {FINAL_WITH}, s AS ({SCAN_SQL})
    SELECT {FINAL_ROUNDED}, ROUND(scan, 6) AS scan_cv_pr_auc,
      ROUND(f.cv_pr_auc_mean - scan, 4) AS pr_auc_lift
    FROM (SELECT model, cv_pr_auc_mean AS scan FROM ({_cv_sql('s')})) RIGHT JOIN f USING (model)""",
    "scored"))
def m13(spark, sf_dir):
    return rounded(leaderboard.final_summary(scan_board(spark, sf_dir),
                                             final_board(spark, sf_dir)))


@query("m17_generalisation_gap", check(f"""
    {FINAL_WITH} SELECT model, ROUND(f.cv_pr_auc_mean, 6) AS cv_pr_auc_mean,
      ROUND(f.pr_auc, 6) AS pr_auc, ROUND(f.cv_pr_auc_mean - f.pr_auc, 6) + 0.0::DOUBLE AS gap
    FROM f""", "scored"))
def m17(spark, sf_dir):
    return rounded(leaderboard.generalisation_gap(final_board(spark, sf_dir)))


@query("q19_business_ranking", check(
    f"{FINAL_WITH} SELECT model, threshold, savings FROM f", "scored"))
def q19(spark, sf_dir):
    return leaderboard.business_ranking(final_board(spark, sf_dir))


# Student's t at 1 - 0.05/2 and 1 - (0.05/6)/2 with 4 degrees of freedom.
T_05, T_BONFERRONI = 2.7764451051977987, 4.851008443

PAIRS = f"""
    WITH t AS ({TUNED_SQL}), s AS ({ranking_sql('t', 'model, fold')})
    SELECT a.model AS model_a, b.model AS model_b, AVG(a.average_precision) AS mean_a,
      AVG(b.average_precision) AS mean_b, AVG(a.average_precision - b.average_precision) AS m,
      VAR_SAMP(a.average_precision - b.average_precision) AS v
    FROM s a JOIN s b USING (fold) WHERE a.model < b.model GROUP BY 1, 2"""


def _fold_scores(spark, sf_dir):
    return leaderboard.fold_scores(tuned_rows(spark, sf_dir)).select(
        "model", "fold", F.col("average_precision").alias("score"))


@query("m20_corrected_t_test", check(f"""
    SELECT model_a, model_b, ROUND(mean_a, 4) AS mean_a, ROUND(mean_b, 4) AS mean_b,
      ROUND(m, 4) AS mean_diff, ROUND(m / SQRT(v * (0.2::DOUBLE + 0.25::DOUBLE)), 4)
        AS t_statistic,
      ROUND(m - {T_05}::DOUBLE * SQRT(v * (0.2::DOUBLE + 0.25::DOUBLE)), 4) AS ci_lower,
      ROUND(m + {T_05}::DOUBLE * SQRT(v * (0.2::DOUBLE + 0.25::DOUBLE)), 4) AS ci_upper,
      ABS(m / SQRT(v * (0.2::DOUBLE + 0.25::DOUBLE))) > {T_05}::DOUBLE AS is_significant
    FROM ({PAIRS})""", "scored"))
def m20(spark, sf_dir):
    tested = comparison.corrected_t_test(
        comparison.paired(_fold_scores(spark, sf_dir)), 0.25, FOLDS)
    return rounded(tested.drop("p_value", "cohens_d", "effect"), 4)


@query("m21_effect_size", check(f"""
    SELECT model_a, model_b, ROUND(d, 4) AS cohens_d, CASE WHEN ABS(d) < 0.2::DOUBLE
      THEN 'negligible' WHEN ABS(d) < 0.5::DOUBLE THEN 'small' WHEN ABS(d) < 0.8::DOUBLE
      THEN 'medium' ELSE 'large' END AS effect
    FROM (SELECT *, m / SQRT(v) AS d FROM ({PAIRS}))""", "scored"))
def m21(spark, sf_dir):
    tested = comparison.corrected_t_test(
        comparison.paired(_fold_scores(spark, sf_dir)), 0.25, FOLDS)
    return rounded(tested.select("model_a", "model_b", "cohens_d", "effect"), 4)


@query("m22_all_pairs_bonferroni", check(f"""
    SELECT model_a, model_b, ROUND(m, 4) AS mean_diff,
      ABS(m / SQRT(v * 0.45::DOUBLE)) > {T_BONFERRONI}::DOUBLE AS is_significant,
      ROUND(0.05::DOUBLE / 6, 6) AS bonferroni_alpha
    FROM ({PAIRS})""", "scored"))
def m22(spark, sf_dir):
    tested = comparison.all_pairs(_fold_scores(spark, sf_dir), 0.25, FOLDS, models=4)
    return rounded(tested.select(
        "model_a", "model_b", "mean_diff", "is_significant", "bonferroni_alpha"), 4,
        bonferroni_alpha=6)


@query("m22_all_pairs_p_values")
def m22_p(spark, sf_dir):
    return comparison.all_pairs(_fold_scores(spark, sf_dir), 0.25, FOLDS, models=4)
