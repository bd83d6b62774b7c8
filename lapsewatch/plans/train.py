"""Queries that fit models (E06, FS4, FS5, FS7, A22, M, U02, S07, S09).

SQL cannot fit a model, so these return facts of the fitted model that SQL can state: which rows,
names, models and sections there must be, and for each whether it has the property it must have.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from lapsewatch import constants as K
from lapsewatch.operators import (
    calibration, conformal, drift, importance, leaderboard, metrics, prepare, scoring, splitting, training,
    uplift,
)
from lapsewatch.operators.encoding import routed_stages, vector_names
from lapsewatch.operators.smalltables import materialise
from lapsewatch.plans.evaluate import (
    AT_CUT, COUNTS, CUT, RATIOS, SCAN_SQL, c04, ranking_sql, scan_rows, u05,
)
from lapsewatch.plans.explore import CHARGES, hash_share_sql, rounded
from lapsewatch.plans.intake import model_rows
from lapsewatch.plans.monitor import DATED_VIEWS, codes, dated_sides, findings_sql
from lapsewatch.plans.oracle import check
from lapsewatch.plans.registry import CHECKS, query
from lapsewatch.session import scratch_path
from lapsewatch.sources import files
from lapsewatch.sources.tables import scored, subscribers

# Settings of the registered fits where they are not the operators' defaults.
FAST = {"maxIter": 50}
# Bound of the labelled rows that the registered tree ensembles are fitted on; they are measured,
# where they are, on all other rows. Single trees and linear models take all rows.
TREE_ROWS = 3000
FIT_ROWS = {"gradient_boosting": TREE_ROWS, "random_forest": TREE_ROWS}


def names_sql(names, **facts) -> str:
    """A row per name with constant facts."""
    extra = "".join(f", {value} AS {fact}" for fact, value in facts.items())
    return f"SELECT UNNEST([{', '.join(repr(n) for n in names)}]) AS feature{extra}"


# Slots of the routed vector: one per level, scaled number and flag.
SLOTS = " UNION ALL ".join(
    [f"SELECT DISTINCT '{c}__hot_' || {c} AS feature FROM features" for c in K.CATEGORICAL]
    + [f"SELECT '{c}__scaled'" for c in K.NUMERIC] + [f"SELECT '{c}'" for c in K.BINARY])
TEST_ROWS = f"SELECT customerID, label, TRUE AS is_probability FROM clean WHERE {hash_share_sql()} >= 0.8::DOUBLE"


def as_probability(df):
    return df.select("customerID", "label", F.col("prob").between(0.0, 1.0).alias("is_probability"))


def train_rows(spark, sf_dir):
    """Clean customers with a class weight: what a model pipeline takes."""
    return training.with_weight(prepare.clean(subscribers(spark, sf_dir)))


def engineered(spark, sf_dir):
    return training.with_weight(model_rows(spark, sf_dir))


def linear(select=False, **routes):
    return training.model_pipeline("logistic_regression", FAST, select=select, engineer=False,
                                   **routes)


def boosted(select=True):
    return training.model_pipeline("gradient_boosting", select=select)


def _as_report(spark, findings):
    """What a JSON report of the findings says when it is read back."""
    path = files.write_report(findings, scratch_path(spark, "report"))
    return spark.read.schema(findings.schema).json(path)


@query("s07_json_report", check(
    f"SELECT feature, method, is_drifted FROM ({findings_sql(DATED_VIEWS)})", "features"))
def s07(spark, sf_dir):
    findings = drift.feature_findings(*dated_sides(spark, sf_dir))
    return _as_report(spark, findings).select("feature", "method", "is_drifted")


@query("s07_conformal_json", CHECKS["c04_coverage_report"])
def s07_conformal(spark, sf_dir):
    return _as_report(spark, c04(spark, sf_dir))


@query("s07_uplift_json", CHECKS["u05_segment_summary"])
def s07_uplift(spark, sf_dir):
    return _as_report(spark, u05(spark, sf_dir))


@query("e06_importance_selection", check(
    f"SELECT feature, TRUE AS follows_rule FROM ({SLOTS})", "features"))
def e06(spark, sf_dir):
    """Every slot, and whether it was kept exactly if its importance reaches half the mean."""
    from pyspark.ml import Pipeline
    rows = engineered(spark, sf_dir)
    encoded = Pipeline(stages=routed_stages(output="all_features")).fit(rows).transform(rows)
    selector = training.ImportanceSelector()
    kept = set(vector_names(selector.fit(encoded).transform(encoded)))
    weights = selector.importances_
    return spark.createDataFrame(
        [(n, bool((n in kept) == (w >= 0.5 * weights.mean())))
         for n, w in zip(vector_names(encoded, "all_features"), weights)],
        "feature string, follows_rule boolean")


def _rank_facts(table, score: str, rank: str):
    """Per feature: whether its score and rank agree with the feature ranked before it."""
    from pyspark.sql import Window
    before = Window.orderBy(rank)  # a row per feature
    return table.select(
        "feature", (F.coalesce(F.round(F.lag(score).over(before), 6) >= F.round(score, 6), F.lit(True))
                    & (F.col(rank) == F.row_number().over(before))).alias("in_order"))


@query("fs4_forest_importance", names_sql(K.MODEL_INPUTS, in_order="TRUE", adds_up="TRUE"))
def fs4(spark, sf_dir):
    from lapsewatch.operators.selection import ranked
    scores = importance.forest_importance(codes(spark, sf_dir), K.MODEL_INPUTS, rows=TREE_ROWS)
    total = scores.agg(F.sum("rf_importance")).first()[0]
    return _rank_facts(ranked(scores, "rf_importance", "rf_rank"), "rf_importance", "rf_rank").withColumn(
        "adds_up", F.lit(abs(total - 1) < 1e-9))


@query("fs5_permutation_importance", names_sql(K.MODEL_INPUTS, in_order="TRUE", spread="TRUE"))
def fs5(spark, sf_dir):
    from lapsewatch.operators.selection import ranked
    scores = materialise(importance.permutation_importance(codes(spark, sf_dir), K.MODEL_INPUTS), "scores")
    return _rank_facts(ranked(scores, "perm_mean", "perm_rank"), "perm_mean", "perm_rank").join(
        scores.select("feature", (F.col("perm_std") >= 0).alias("spread")), "feature")


@query("fs7_full_selection", names_sql(K.MODEL_INPUTS, has_fate="TRUE", votes_decide="TRUE"))
def fs7(spark, sf_dir):
    """Every feature, whether a stage decided on it, and whether its votes say if it is selected."""
    table = importance.full_selection(model_rows(spark, sf_dir), K.MODEL_INPUTS, fit_rows=TREE_ROWS)
    return table.select(
        "feature",
        F.when(F.col("stage") == "ranked", F.col("votes").isNotNull()).otherwise(
            F.col("stage").isin("variance", "correlation") & F.col("votes").isNull()).alias("has_fate"),
        F.coalesce(F.col("selected") == (F.col("votes") >= 2), F.lit(True)).alias("votes_decide"))


FIRST_SEVEN = ["tenure_group", "is_month_to_month", "service_adoption_count",
               "has_protection_bundle", "charge_to_tenure_ratio", "is_fiber_optic",
               "avg_charge_per_service"]


@query("a22_feature_set_comparison", """
    SELECT * FROM (VALUES ('raw', 19, TRUE), ('raw_plus_7', 26, TRUE), ('all', 47, TRUE),
      ('selected', 20, TRUE)) t(feature_set, n_features, better_than_base)""")
def a22(spark, sf_dir):
    """Four feature sets by cross-validated average precision; "selected" are the twenty features
    that share most information with the label."""
    from lapsewatch.operators.selection import ranked
    from lapsewatch.plans.monitor import mi_scores
    raw = CHARGES + K.CATEGORICAL[:16]
    best = ranked(mi_scores(spark, sf_dir), "mi_score", "mi_rank").where("mi_rank <= 20").collect()
    rows = codes(spark, sf_dir)
    base = rows.agg(F.avg("label")).first()[0]
    compared = importance.compare_feature_sets(rows, {
        "raw": raw, "raw_plus_7": raw + FIRST_SEVEN, "all": K.MODEL_INPUTS,
        "selected": [r["feature"] for r in best]})
    return compared.select("feature_set", "n_features", (F.col("cv_pr_auc") > base).alias("better_than_base"))


@query("m01_model_factory", check(TEST_ROWS, "clean"))
def m01(spark, sf_dir):
    rows = splitting.add_split(train_rows(spark, sf_dir), splitting.TRAIN_TEST)
    model = training.fit(boosted(), rows.where("split = 'train'"), TREE_ROWS, in_task=True)
    return as_probability(training.score(model, rows.where("split = 'test'")))


@query("m02_algorithm_registry", f"""
    SELECT UNNEST({sorted(training.ALGORITHMS)}) AS model, TRUE AS better_than_chance""")
def m02(spark, sf_dir):
    """Every registered algorithm with its defaults, fitted on the training part, measured on the
    rest."""
    rows = splitting.add_split(engineered(spark, sf_dir), splitting.TRAIN_TEST)
    parts = []
    for name in training.ALGORITHMS:
        built = training.model_pipeline(name, select=False, engineer=False)
        model = training.fit(built, rows.where("split = 'train'"), FIT_ROWS.get(name))
        parts.append(materialise(training.score(model, rows.where("split = 'test'")).select(
            F.lit(name).alias("model"), "label", "prob"), "predictions"))
    return metrics.ranking_scores(training._union(parts), ["model"]).select(
        "model", (F.col("roc_auc") > 0.6).alias("better_than_chance"))


@query("m04_cross_validation", """
    SELECT 'logistic_regression' AS model, TRUE AS better_than_chance, TRUE AS has_spread""")
def m04(spark, sf_dir):
    predictions = training.cross_validate(engineered(spark, sf_dir), linear())
    scores = leaderboard.fold_scores(predictions, [], "fold")
    board = leaderboard.cv_summary(scores.withColumn("model", F.lit("logistic_regression")))
    return board.select("model", (F.col("cv_roc_auc_mean") > 0.6).alias("better_than_chance"),
                        (F.col("cv_pr_auc_std") > 0).alias("has_spread"))


@query("m05_isotonic_calibration", "SELECT TRUE AS is_monotone, TRUE AS keeps_mean, TRUE AS in_range")
def m05(spark, sf_dir):
    """The calibrated map on the rows it was fitted on: monotone, between 0 and 1, and with the
    mean of the labels."""
    rows = splitting.add_split(engineered(spark, sf_dir))
    model = training.fit(linear(), rows.where("split = 'train'"))
    held = materialise(training.score(model, rows.where("split = 'validation'")).select(
        "label", "prob"), "held-out")
    mapped = calibration.apply_isotonic(held, calibration.fit_isotonic(held))
    # Ranked by either value, neighbours of one slice must not fall; slices are compared by range.
    steps = mapped.select(F.floor(F.col("prob") * 1000).alias("slot"), "prob", "calibrated")
    from pyspark.sql import Window
    inside = steps.withColumn("fall", F.col("calibrated") < F.lag("calibrated").over(
        Window.partitionBy("slot").orderBy("prob")))
    slots = inside.groupBy("slot").agg(
        F.max(F.coalesce("fall", F.lit(False))).alias("fall"), F.min("calibrated").alias("low"),
        F.max("calibrated").alias("high"))
    # At most a thousand slots.
    between = slots.withColumn("fall", F.col("fall") | F.coalesce(
        F.col("low") < F.lag("high").over(Window.orderBy("slot")), F.lit(False)))
    facts = mapped.agg((F.abs(F.avg("calibrated") - F.avg("label")) < 1e-6).alias("keeps_mean"),
                       F.bool_and(F.col("calibrated").between(0.0, 1.0)).alias("in_range"))
    return between.agg((~F.max("fall")).alias("is_monotone")).join(facts)


SECTIONS = {
    "cross_validation": ["roc_auc_mean", "roc_auc_std", "pr_auc_mean", "pr_auc_std"],
    "threshold": ["threshold"],
    "fairness": ["min_parity_ratio", "max_tpr_disparity", "max_fpr_disparity", "overall_fair"],
}


def _experiment(spark, sf_dir):
    """The linear model through the whole experiment."""
    return training.experiment(engineered(spark, sf_dir), linear())


@query("m06_findings")
def m06_findings(spark, sf_dir):
    """Every finding with its value."""
    return _experiment(spark, sf_dir)


@query("m06_training_experiment", " UNION ALL ".join(
    f"SELECT '{s}' AS section, UNNEST({names}) AS name, TRUE AS is_finite" for s, names in SECTIONS.items()))
def m06(spark, sf_dir):
    """The whole experiment; of its findings the sections with a fixed list of names."""
    return _experiment(spark, sf_dir).where(F.col("section").isin(*SECTIONS)).select(
        "section", "name", (F.col("value").isNotNull() & ~F.isnan("value")).alias("is_finite"))


# Settings of the scan where they are not the operators' defaults: every algorithm is fitted
# once per fold there.
SCAN_SETTINGS = {
    "gradient_boosting": {"maxIter": 20}, "random_forest": {"numTrees": 50, "maxDepth": 8},
    "logistic_regression": {"maxIter": 20}, "linear_svc": {"maxIter": 10},
}


def algorithms():
    """A pipeline of every registered algorithm."""
    return {name: training.model_pipeline(name, SCAN_SETTINGS.get(name), select=False, engineer=False)
            for name in training.ALGORITHMS}


BOARD = sorted(training.ALGORITHMS)


def scan_board(spark, sf_dir):
    """Every algorithm next to the guess, by five folds."""
    return training.scan(materialise(engineered(spark, sf_dir), "engineered"), algorithms(), fit_rows=FIT_ROWS)


@query("m08_leaderboard")
def m08_leaderboard(spark, sf_dir):
    """The board itself."""
    return scan_board(spark, sf_dir)


@query("m08_algorithm_scan", f"""
    SELECT UNNEST({BOARD}) AS model, TRUE AS better_than_dummy UNION ALL SELECT 'Dummy', FALSE""")
def m08(spark, sf_dir):
    board = materialise(scan_board(spark, sf_dir), "board")
    dummy = board.where("model = 'Dummy'").first()["cv_pr_auc_mean"]
    return board.select("model", (F.col("cv_pr_auc_mean") > dummy).alias("better_than_dummy"))


TRIALS = 50


def trials_of(spark, sf_dir):
    """The declared search: fifty points of the boosted space."""
    return training.search(codes(spark, sf_dir), K.MODEL_INPUTS, trials=TRIALS)


@query("m09_hyperparameter_search", f"""
    SELECT UNNEST(RANGE(0, {TRIALS}))::INT AS trial, TRUE AS in_space, TRUE AS follows_rule, TRUE AS best_is_best""")
def m09(spark, sf_dir):
    """Every trial: its point lies in the space, it is pruned exactly if the rule says so, and the
    best row is the highest finished one."""
    space = training.SEARCH_SPACE
    table = trials_of(spark, sf_dir)
    rows = sorted(table.collect(), key=lambda r: r["trial"])
    best = training.best_trial(table).first()
    finished = [r["value"] for r in rows if not r["pruned"]]
    facts = []
    for i, r in enumerate(rows):
        point = json.loads(r["params"])
        inside = point.keys() == space.keys() and all(space[n][0] <= v <= space[n][1] for n, v in point.items())
        scores = json.loads(r["scores"])
        rule = training.should_prune(scores, [json.loads(x["scores"]) for x in rows[:i] if not x["pruned"]], 3)
        facts.append((i, inside, r["pruned"] == rule, best["value"] == max(finished)))
    return spark.createDataFrame(
        facts, "trial int, in_space boolean, follows_rule boolean, best_is_best boolean")


@query("m09_trials")
def m09_trials(spark, sf_dir):
    """The trials themselves as read back from the CSV they are written to, each with the best finished
    mean so far, and the best of all marked."""
    table = materialise(trials_of(spark, sf_dir), "trials")
    path = files.write_csv(table.orderBy(F.desc("value")), scratch_path(spark, "trials"))
    back = spark.read.schema(table.schema).option("header", True).csv(path)
    finished = F.when(~F.col("pruned"), F.col("value"))
    upto = leaderboard.running_best(back.withColumns({"study": F.lit("boosted"), "finished": finished}),
                                    value="finished")
    best = training.best_trial(back).select("params", F.lit(True).alias("is_best"))
    return upto.drop("study", "finished").join(best, "params", "left").fillna(False, ["is_best"])


@query("s09_tuning_results_csv", f"""
    SELECT UNNEST({[*BOARD, 'Dummy']}) AS model, TRUE AS as_written""")
def s09(spark, sf_dir):
    """The scan leaderboard written as CSV and read back: every row as it was."""
    board = materialise(scan_board(spark, sf_dir), "board")
    path = files.write_csv(board, scratch_path(spark, "leaderboard"))
    back = spark.read.schema(board.schema).option("header", True).csv(path)
    same = reduce(and_, [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in board.columns])
    return board.alias("a").join(back.alias("b"), "model", "left").select("model", same.alias("as_written"))


@query("m14_save_and_load", check("SELECT customerID, label, TRUE AS is_probability, TRUE AS same FROM clean", "clean"))
def m14(spark, sf_dir):
    """Scores of a model before it is saved and after it is loaded."""
    rows = train_rows(spark, sf_dir)
    first = training.fit(training.model_pipeline("logistic_regression", FAST, select=False), rows)
    path = training.save_model(first, scratch_path(spark, "model"))
    model = training.load_or_train(path, lambda: training.fit(boosted(), rows))
    both = training.score(model, training.score(first, rows, "before").withColumnRenamed("before", "_before"))
    return both.select("customerID", "label", F.col("prob").between(0.0, 1.0).alias("is_probability"),
                       (F.col("prob") == F.col("_before")).alias("same"))


@query("m15_run_log", check(f"""
    WITH c AS (SELECT {AT_CUT} FROM scored)
    SELECT 'run-1' AS run_id, key, value FROM (
      SELECT 'algorithm' AS key, 'scorecard' AS value UNION ALL SELECT 'threshold', '0.3'
      UNION ALL SELECT 'test_tp', CAST(tp AS VARCHAR) FROM c
      UNION ALL SELECT 'test_fp', CAST(fp AS VARCHAR) FROM c
      UNION ALL SELECT 'test_fn', CAST(fn AS VARCHAR) FROM c
      UNION ALL SELECT 'test_tn', CAST(tn AS VARCHAR) FROM c)""", "scored"))
def m15(spark, sf_dir):
    counts = metrics.confusion(scored(spark, sf_dir), CUT).first().asDict()
    path = scratch_path(spark, "runs")
    training.log_run(spark, path, "run-1", {"algorithm": "scorecard", "threshold": CUT})
    training.log_run(spark, path, "run-1", {**counts, "note": "texts are left out"}, "test_")
    return spark.read.parquet(path)


def _scored_linear(spark, sf_dir):
    rows = splitting.add_split(engineered(spark, sf_dir), splitting.TRAIN_TEST)
    model = training.fit(linear(), rows.where("split = 'train'"))
    return training.score(model, rows.where("split = 'test'")).select(
        "customerID", "label", "prob")


@query("m16_top_importances", check(f"""
    SELECT UNNEST(RANGE(1, 21))::INT AS place, TRUE AS is_slot, TRUE AS in_order
    FROM (SELECT COUNT(*) FROM ({SLOTS}))""", "features"))
def m16(spark, sf_dir):
    from pyspark.sql import Window
    rows = engineered(spark, sf_dir)
    model = training.fit(
        training.model_pipeline("gradient_boosting", select=False, engineer=False), rows, TREE_ROWS,
        in_task=True)
    listed = set(vector_names(model.transform(rows.limit(0))))
    # Twenty rows.
    before = F.lag("importance").over(Window.orderBy("place"))
    return training.importances(model, rows).select(
        "place", F.col("feature").isin(*listed).alias("is_slot"),
        (F.coalesce(before >= F.col("importance"), F.lit(True)) & F.col("importance").between(0.0, 1.0))
        .alias("in_order"))


def _benchmark(spark, sf_dir):
    return training.benchmark(materialise(engineered(spark, sf_dir), "engineered"), {
        "logistic_regression": linear(),
        "decision_tree": training.model_pipeline("decision_tree", select=False, engineer=False)})


@query("m18_measures")
def m18_measures(spark, sf_dir):
    """What the benchmark measured."""
    return _benchmark(spark, sf_dir)


@query("m18_model_benchmark", """
    SELECT UNNEST(['logistic_regression', 'decision_tree']) AS model, TRUE AS in_range, TRUE AS is_timed""")
def m18(spark, sf_dir):
    board = _benchmark(spark, sf_dir)
    measures = [F.col(f"{m}_mean").between(0.0, 1.0) & (F.col(f"{m}_std") >= 0) for m in training.BENCHMARKED]
    return board.select("model", (measures[0] & measures[1] & measures[2]).alias("in_range"),
                        (F.col("ms_per_row_mean") > 0).alias("is_timed"))


BENCH_SQL = f"""WITH t AS ({SCAN_SQL})
    SELECT model, AVG(roc_auc) AS roc_auc_mean, STDDEV_POP(roc_auc) AS roc_auc_std,
      AVG(f1) AS f1_mean, STDDEV_POP(f1) AS f1_std, AVG(brier) AS brier_mean,
      STDDEV_POP(brier) AS brier_std
    FROM (SELECT *, {RATIOS} FROM (SELECT model, fold, {COUNTS.format(t='0.5::DOUBLE')},
            AVG(POWER(prob - label, 2)) AS brier FROM t GROUP BY model, fold))
      JOIN ({ranking_sql('t', 'model, fold')}) USING (model, fold) GROUP BY model"""


@query("m18_benchmark_scores", check(
    "SELECT model, " + ", ".join(
        f"ROUND({m}_{s}, 6) AS {m}_{s}" for m in training.BENCHMARKED for s in ("mean", "std"))
    + f" FROM ({BENCH_SQL})", "scored"))
def m18_scores(spark, sf_dir):
    return rounded(training.benchmark_table(scan_rows(spark, sf_dir)))


@query("s07_benchmark_json", CHECKS["m18_benchmark_scores"])
def s07_benchmark(spark, sf_dir):
    return _as_report(spark, m18_scores(spark, sf_dir))


@query("m18_benchmark_highlights", check(f"""
    SELECT ARG_MAX(model, roc_auc_mean) AS best_roc_auc, ARG_MIN(model, brier_mean) AS best_brier
    FROM ({BENCH_SQL})""", "scored"))
def m18_highlights(spark, sf_dir):
    return training.benchmark_highlights(training.benchmark_table(scan_rows(spark, sf_dir)))


SIZES = tuple(i / 10 for i in range(1, 11))
CURVE_SQL = f"""
    WITH rows AS (SELECT label, prob, FLOOR({hash_share_sql('fold:')} * 5)::INT AS f,
        FLOOR({hash_share_sql('size:')} * 100)::INT + 1 AS step FROM scored),
      t AS (SELECT size, fold, CASE WHEN f = fold THEN 'validation' ELSE 'train' END AS part,
              label, prob
            FROM rows, (SELECT UNNEST({[*SIZES]}::DOUBLE[]) AS size),
              (SELECT UNNEST(RANGE(0, 5))::INT AS fold)
            WHERE step <= ROUND(size * 100))
    SELECT size, ROUND(AVG(average_precision) FILTER (WHERE part = 'train'), 4) AS train_mean,
      ROUND(STDDEV_POP(average_precision) FILTER (WHERE part = 'train'), 4) AS train_std,
      ROUND(AVG(average_precision) FILTER (WHERE part = 'validation'), 4) AS validation_mean,
      ROUND(STDDEV_POP(average_precision) FILTER (WHERE part = 'validation'), 4)
        AS validation_std
    FROM ({ranking_sql('t', 'size, fold, part')}) GROUP BY size"""


def card_curve(spark, sf_dir):
    """Learning curve of the full scorecard: rows are counted per step before they are repeated
    for every size and fold they belong to."""
    rows = splitting.add_nested_share(splitting.add_fold(scored(spark, sf_dir)), 100)
    cells = rows.groupBy("fold", "size_step", "prob", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = F.array(*[F.lit(s) for s in SIZES])
    spread = cells.withColumnRenamed("fold", "f").withColumns({
        "size": F.explode(F.filter(sizes, lambda s: F.col("size_step") <= F.round(s * 100))),
    }).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn(
        "part", F.when(F.col("f") == F.col("fold"), "validation").otherwise("train"))
    return training.curve_table(metrics.ranking_scores(
        spread, ["size", "fold", "part"], weight="n"))


@query("m19_curve_table", check(CURVE_SQL, "scored"))
def m19_table(spark, sf_dir):
    return card_curve(spark, sf_dir)


@query("m19_curve_diagnosis", check(f"""
    WITH c AS (SELECT *, validation_mean - LAG(validation_mean) OVER (ORDER BY size) AS step,
        ROW_NUMBER() OVER (ORDER BY size DESC) AS back FROM ({CURVE_SQL}))
    SELECT final_gap, slope, CASE WHEN final_gap > 0.05::DOUBLE THEN 'high_variance'
        WHEN final < 0.60::DOUBLE THEN 'high_bias' ELSE 'well_fitted' END AS diagnosis
    FROM (SELECT ROUND(MAX(train_mean - validation_mean) FILTER (WHERE back = 1), 4) AS final_gap,
        MAX(validation_mean) FILTER (WHERE back = 1) AS final,
        ROUND(AVG(step) FILTER (WHERE back <= 2), 6) AS slope FROM c)""", "scored"))
def m19_diagnosis(spark, sf_dir):
    return training.diagnose_curve(card_curve(spark, sf_dir))


@query("m19_fitted_curve")
def m19_fitted(spark, sf_dir):
    """The curve itself: means and deviations per size."""
    return training.learning_curve(engineered(spark, sf_dir), linear(), SIZES, k=2)


@query("m19_learning_curves", f"""
    SELECT UNNEST({[*SIZES]}::DOUBLE[]) AS size, TRUE AS in_range""")
def m19(spark, sf_dir):
    """A fitted curve of ten sizes."""
    curve = m19_fitted(spark, sf_dir)
    return curve.select("size", (F.col("train_mean").between(0.0, 1.0) & F.col("validation_mean").between(0.0, 1.0)
                                 & (F.col("train_std") >= 0)).alias("in_range"))


@query("u02_two_model_effects", check("""
    SELECT customerID, TRUE AS is_probability, TRUE AS in_quadrant FROM features
    WHERE InternetService <> 'No' AND TechSupport <> 'Yes'""", "features"))
def u02(spark, sf_dir):
    """Effects from one classifier per arm, summed up by quadrant."""
    rows = uplift.eligible(training.with_weight(model_rows(spark, sf_dir), 1.0))
    covariates = [c for c in K.CATEGORICAL if c not in ("TechSupport", "InternetService")]
    # Flags that contain the treatment are no covariates either.
    flags = [b for b in K.BINARY if b not in ("has_protection_bundle", "senior_no_support",
                                              "has_internet", "has_no_internet_addons")]
    built = training.model_pipeline(
        "logistic_regression", FAST, select=False, engineer=False, categorical=covariates,
        numeric=CHARGES, binary=flags)
    scored = uplift.effects(rows, *uplift.fit_two_models(rows, built))
    return uplift.segment(scored).select(
        "customerID", (F.col("base_churn_prob").between(0.0, 1.0)
                       & (F.col("base_churn_prob") + F.col("cate")).between(0.0, 1.0)).alias("is_probability"),
        (F.col("uplift_segment") == uplift.quadrant(F.col("base_churn_prob"), F.col("cate"))).alias("in_quadrant"))


@query("r01_score_with_model", check(f"""
    SELECT customerID, TRUE AS decided, 3 AS explained, 2 AS sets
    FROM clean WHERE {hash_share_sql()} >= 0.8::DOUBLE""", "clean"))
def r01_model(spark, sf_dir):
    """The full response from a fitted model: fitted on the first part, conformal quantiles from
    the calibration part, answers for the rest."""
    rows = splitting.add_split(engineered(spark, sf_dir), splitting.WITH_CALIBRATION)
    model = training.fit(linear(), rows.where("split = 'train'"))
    quantiles = conformal.calibrate(training.score(model, rows.where("split = 'conformal'")))
    answers = scoring.explain(model, rows.where("split = 'test'"))
    response = scoring.with_request_id(scoring.full_response(answers, 0.3, quantiles))
    return response.select(
        "customerID", (F.col("will_churn") == (F.col("prob") >= 0.3)).alias("decided"),
        F.size("explanation").alias("explained"), F.size("conformal").alias("sets"))


@query("r03_champion_contributions")
def r03_champion(spark, sf_dir):
    """Boosted trees explain their own answers: the three strongest contributions of every held-out row."""
    rows = splitting.add_split(engineered(spark, sf_dir), splitting.TRAIN_TEST)
    model = training.fit(training.model_pipeline(
        "gradient_boosting", {"maxIter": 20}, engineer=False), rows.where("split = 'train'"), TREE_ROWS)
    answers = scoring.explain(model, rows.where("split = 'test'"))
    return answers.select("customerID", "prob", F.explode("explanation").alias("feature", "term"))
