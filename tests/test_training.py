import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsewatch import constants as K
from lapsewatch.operators import boosting, importance, metrics, splitting, training, uplift
from lapsewatch.plans.intake import model_rows
from lapsewatch.plans.train import engineered, linear, train_rows


def test_unknown_algorithm():
    with pytest.raises(ValueError, match="nope"):
        training.classifier("nope")


def test_model_beats_chance_and_survives_saving(spark, sf_dir, tmp_path):
    rows = splitting.add_split(train_rows(spark, sf_dir), splitting.TRAIN_TEST)
    pipeline = training.model_pipeline("gradient_boosting", {"maxIter": 3, "maxDepth": 3},
                                       selector={"maxIter": 2, "maxDepth": 2})
    model = training.fit(pipeline, rows.where("split = 'train'"))
    scored = training.score(model, rows.where("split = 'test'"))
    assert scored.where("prob < 0 OR prob > 1").isEmpty()
    assert metrics.ranking_scores(scored).first().roc_auc > 0.5
    loaded = training.load_or_train(training.save_model(model, str(tmp_path / "m")), lambda: None)
    again = training.score(loaded, rows.where("split = 'test'"))
    assert scored.select("customerID", "prob").exceptAll(again.select("customerID", "prob")).isEmpty()


def test_missing_model_falls_back_to_training(tmp_path):
    assert training.load_or_train(str(tmp_path / "none"), lambda: "trained") == "trained"
    assert training.load_or_train(None, lambda: "trained") == "trained"


def test_unseen_category_scores(spark, sf_dir):
    rows = engineered(spark, sf_dir)
    model = training.fit(linear(), rows)
    odd = rows.limit(3).withColumn("Contract", F.lit("Five year"))
    assert training.score(model, odd).where("prob BETWEEN 0 AND 1").count() == 3


def test_cross_validation_scores_every_row_once(spark, sf_dir):
    rows = engineered(spark, sf_dir)
    held = training.cross_validate(rows, linear(), k=2)
    assert held.count() == rows.count()


def test_search_keeps_every_trial_and_follows_the_rule(spark, sf_dir):
    names = ["tenure", "MonthlyCharges", "composite_churn_risk", "contract_numeric"]
    rows = model_rows(spark, sf_dir).select("customerID", "label", *names)
    space = {**training.SEARCH_SPACE, "maxIter": (20, 60, 20), "maxDepth": (2, 4, 1)}
    table = training.search(rows, names, space, trials=9, k=3, rows=900)
    found = sorted(table.collect(), key=lambda r: r.trial)
    assert [r.trial for r in found] == list(range(9))
    finished = []
    for r in found:
        means = json.loads(r.scores)
        assert r.pruned == training.should_prune(means, finished, 3) and r.folds == len(means) == (2 if r.pruned else 3)
        finished += [] if r.pruned else [means]
    best = training.best_trial(table).first()
    assert best.value == max(r.value for r in found if not r.pruned) and best.n_completed + best.n_pruned == 9
    again = training.search(rows.repartition(3), names, space, trials=9, k=3, rows=900)
    assert sorted(again.collect()) == sorted(table.collect())


def test_boosted_rounds_learn_and_score():
    draw = np.random.default_rng(1)
    x = np.c_[draw.integers(0, 4, 1500), draw.standard_normal((1500, 3))].astype(float)
    x[::50, 2] = np.nan
    y = (draw.random(1500) < 1 / (1 + np.exp(-3 * (x[:, 0] * (x[:, 1] > 0) - 1)))).astype(int)
    codes = boosting.binned(x)
    assert codes.max() < boosting.BINS and len(set(codes[:, 0])) == 4
    train, held = np.arange(1000), np.arange(1000, 1500)
    point = {"maxIter": 300, "stepSize": 0.1, "maxDepth": 3, "minInstancesPerNode": 5, "subsamplingRate": 0.8}
    value, rounds = boosting.fit_and_score(codes, y, train, held, point, 3)
    assert value > y[held].mean() + 0.25 and rounds < 300
    assert boosting.fit_and_score(codes, y, train, held, point, 3) == (value, rounds)
    levels = boosting.grow(codes, y - 0.5, np.ones(1500), train, 4, 40)
    out = boosting.apply(codes, levels)
    for leaf in np.unique(out[train]):
        inside = out[train] == leaf
        assert inside.sum() >= 40 and leaf == pytest.approx((y[train][inside] - 0.5).sum() / (inside.sum() + 1))


def test_average_precision_with_ties():
    label, score = np.array([1, 0, 1, 0, 1]), np.array([0.9, 0.5, 0.5, 0.5, 0.1])
    assert boosting.average_precision(label, score) == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 4 + 1 / 3 * 3 / 5)


def test_pruning_rule():
    finished = [[0.5, 0.6, 0.6], [0.6, 0.7, 0.7], [0.7, 0.8, 0.8], [0.5, 0.5, 0.5], [0.9, 0.9, 0.9]]
    assert not training.should_prune([0.1], finished, 3)
    assert training.should_prune([0.9, 0.69], finished, 3)
    assert not training.should_prune([0.9, 0.7], finished, 3)
    assert not training.should_prune([0.1, 0.1, 0.1], finished, 3)
    assert not training.should_prune([0.1, 0.1], finished[:4], 3)


def test_permutation_importance_finds_the_signal(spark):
    rows = spark.range(2000).select(
        F.col("id").cast("string").alias("customerID"),
        (F.col("id") % 2).cast("double").alias("signal"),
        (F.col("id") % 7).cast("double").alias("noise"),
        F.when(F.col("id") % 10 < 8, F.col("id") % 2).otherwise(1 - F.col("id") % 2)
        .cast("int").alias("label"))
    got = {r.feature: r.perm_mean for r in importance.permutation_importance(
        rows, ["signal", "noise"], repeats=2).collect()}
    assert got["signal"] > 0.1 and abs(got["noise"]) < 0.05


def test_two_model_effects_keep_untreated_rows(spark, sf_dir):
    rows = uplift.eligible(training.with_weight(model_rows(spark, sf_dir), 1.0))
    built = training.model_pipeline("logistic_regression", {"maxIter": 5}, select=False,
                                    engineer=False, categorical=["Contract"], numeric=["tenure"],
                                    binary=[])
    scored = uplift.effects(rows, *uplift.fit_two_models(rows, built))
    assert scored.count() == rows.where("treated = 0").count()
    assert scored.where("abs(cate) > 1").isEmpty()


def test_class_weights_balance(spark, sf_dir):
    table = {r.label: r for r in training.class_weights(engineered(spark, sf_dir)).collect()}
    assert table[0].n * table[0].balanced_weight == pytest.approx(table[1].n * table[1].balanced_weight)
    assert table[1].fixed_weight == K.POSITIVE_CLASS_WEIGHT


def test_broken_model_is_an_error(tmp_path):
    (tmp_path / "metadata").mkdir()
    assert training.has_model(str(tmp_path)) and not training.has_model(str(tmp_path / "none"))
    with pytest.raises(Exception):
        training.load_or_train(str(tmp_path), lambda: "trained")


def test_side_by_side_items_keep_their_local_properties(spark):
    """Each waits until all have set theirs, then reads its own."""
    context, all_set = spark.sparkContext, threading.Barrier(4, timeout=60)

    def work(n):
        context.setLocalProperty("item", str(n))
        all_set.wait()
        return context.getLocalProperty("item")

    assert training.side_by_side(spark, work, range(4)) == ["0", "1", "2", "3"]
    assert context.getLocalProperty("item") is None


def test_side_by_side_keeps_the_order_and_raises(spark):
    assert training.side_by_side(spark, lambda n: spark.range(n).count(), range(20)) == list(range(20))
    with pytest.raises(ZeroDivisionError):
        training.side_by_side(spark, lambda n: 1 // n, [1, 0])


def test_scan_ranks_models_and_bounds_only_their_fits(spark, sf_dir):
    rows = engineered(spark, sf_dir)
    tree = training.model_pipeline("decision_tree", select=False, engineer=False)
    held = training.out_of_fold(rows, {"linear": linear(), "tree": tree}, k=2, fit_rows={"tree": 300})
    assert {(r.model, r["count"]) for r in held.groupBy("model").count().collect()} == {
        ("linear", rows.count()), ("tree", rows.count())}
    board = training.scan(rows, {"linear": linear()}, k=2).collect()
    assert [r.model for r in board] == ["linear", "Dummy"]
