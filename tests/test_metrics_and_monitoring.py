import math
import random

import pytest
from pyspark.sql import functions as F

from lapsewatch.functions import tails
from lapsewatch.functions.scalars import bin_of, step_of
from lapsewatch.operators import comparison, conformal, drift, fairness, metrics, ranking, selection


def scored(spark, pairs):
    return spark.createDataFrame([(int(y), float(p)) for y, p in pairs], "label int, prob double")


def brute_auc(pairs):
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
    return wins / (len(pos) * len(neg))


def brute_average_precision(pairs):
    total, n_pos = 0.0, sum(y for y, _ in pairs)
    for cut in {p for _, p in pairs}:
        at = [y for y, p in pairs if p >= cut]
        total += sum(y for y, p in pairs if p == cut) / n_pos * sum(at) / len(at)
    return total


@pytest.mark.parametrize("shape", ["spread", "hot", "constant"])
def test_ranking_scores_against_brute_force(spark, shape):
    source = random.Random(3)
    draw = {"spread": lambda: source.random(), "constant": lambda: 0.5,
            "hot": lambda: 0.25 if source.random() < 0.4 else round(source.random(), 2)}[shape]
    pairs = [(source.random() < 0.3, draw()) for _ in range(400)]
    row = metrics.ranking_scores(scored(spark, pairs)).first()
    assert row.roc_auc == pytest.approx(brute_auc(pairs))
    assert row.average_precision == pytest.approx(brute_average_precision(pairs))


def test_ranking_scores_per_group_and_single_class(spark):
    rows = spark.createDataFrame(
        [("a", 1, 0.9), ("a", 0, 0.1), ("b", 0, 0.5), ("b", 0, 0.7)],
        "g string, label int, prob double")
    found = {r.g: r for r in metrics.ranking_scores(rows, ["g"]).collect()}
    assert found["a"].roc_auc == 1.0 and found["a"].average_precision == 1.0
    assert math.isnan(found["b"].roc_auc)


def test_perfect_predictions(spark):
    perfect = scored(spark, [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.3), (0, 0.2), (0, 0.1)])
    row = metrics.flat_metrics(perfect, 0.5).first()
    assert (row.roc_auc, row.f1, row.total_cost, row.savings) == (1.0, 1.0, 0.0, 1500.0)


def test_threshold_sweep_against_brute_force(spark):
    source = random.Random(5)
    pairs = [(source.random() < 0.4, source.choice([i / 100 for i in range(101)] + [1.0, 0.0, 0.29]))
             for _ in range(300)]
    table = {round(r.threshold, 2): r for r in metrics.threshold_sweep(scored(spark, pairs)).collect()}
    assert len(table) == 99
    for i in range(1, 100):
        t = i / 100
        want = (sum(1 for y, p in pairs if p >= t and y), sum(1 for y, p in pairs if p >= t and not y))
        assert (table[t].tp, table[t].fp) == want
    best = metrics.cost_optimal(metrics.threshold_sweep(scored(spark, pairs))).first()
    assert best.threshold <= 0.5


def test_f1_optimal_default(spark):
    assert metrics.f1_optimal(metrics.threshold_sweep(scored(spark, [(0, 0.4), (0, 0.9)]))).first().threshold == 0.5


def test_steps_and_bins_on_exact_edges(spark):
    rows = spark.createDataFrame([(i, i / 100) for i in range(101)], "i int, p double")
    got = rows.select("i", step_of(F.col("p"), 100).alias("s"), bin_of(F.col("p"), 10).alias("b")).collect()
    for r in got:
        assert r.s == r.i
        assert r.b == max(0, math.ceil(r.i / 10) - 1)


@pytest.mark.parametrize("p, tier", [(0.60, "HIGH"), (0.5999, "MEDIUM"), (0.35, "MEDIUM"), (0.3499, "LOW")])
def test_risk_tiers(spark, p, tier):
    assert spark.range(1).select(metrics.risk_tier(F.lit(p)).alias("t")).first().t == tier


def test_quantiles_with_a_hot_value(spark):
    import numpy as np
    source = random.Random(11)
    values = [7.0] * 200 + [source.gauss(0, 50) for _ in range(399)]
    rows = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    fractions = {f"q{i}": i / 10 for i in range(11)}
    row = ranking.exact_quantiles(rows, "v", fractions, ["g"]).first()
    for name, q in fractions.items():
        assert row[name] == pytest.approx(float(np.percentile(values, q * 100)))


def test_fairness_micro_cases(spark):
    rows = spark.createDataFrame(
        [("A", 1, 0.9), ("A", 1, 0.8), ("A", 0, 0.1), ("A", 0, 0.2),
         ("B", 1, 0.9), ("B", 0, 0.1), ("B", 0, 0.2), ("B", 1, 0.3)],
        "group_name string, label int, prob double")
    parity = fairness.demographic_parity(rows, ["group_name"], 0.5).first()
    assert (parity.parity_ratio, parity.passes, parity.min_rate_group) == (0.5, False, "B")
    odds = fairness.equalised_odds(rows, ["group_name"], 0.5).first()
    assert (odds.tpr_disparity, odds.fpr_disparity, odds.satisfies) == (0.5, 0.0, False)
    none = fairness.demographic_parity(rows, ["group_name"], 0.99).first()
    assert (none.parity_ratio, none.passes, none.min_rate_group) == (0.0, False, "N/A")


def test_conformal_quantile_and_small_sample(spark):
    rows = scored(spark, [(1, 1 - i / 100) for i in range(1, 20)])
    got = {r.confidence: r["quantile"] for r in conformal.calibrate(rows).collect()}
    assert got[0.90] == pytest.approx(0.18) and got[0.95] == pytest.approx(0.19)
    few = conformal.calibrate(scored(spark, [(1, 0.9), (0, 0.2)])).collect()
    assert all(r["quantile"] == 1.0 for r in few)


def column(spark, values, name="x"):
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


def numpy_psi(ref, cur):
    import numpy as np
    edges = np.unique(np.percentile(ref, np.linspace(0, 100, 11)))
    if len(edges) < 3:
        return 0.0
    p = np.histogram(ref, edges)[0] / len(ref) + 1e-6
    q = np.histogram(cur, edges)[0] / len(cur) + 1e-6
    return float(((q - p) * np.log(q / p)).sum())


@pytest.mark.parametrize("shift", [0, 30])
def test_psi_against_numpy(spark, shift):
    source = random.Random(42)
    ref = [source.gauss(50, 10) for _ in range(500)]
    cur = [source.gauss(50 + shift, 10) for _ in range(500)]
    row = drift.psi(column(spark, ref), column(spark, cur), ["x"]).first()
    assert row.psi == pytest.approx(numpy_psi(ref, cur))
    assert row.is_drifted == (shift > 0)
    assert row.reference_std == pytest.approx(__import__("numpy").std(ref))


def test_psi_of_constant_and_repeated_values(spark):
    assert drift.psi(column(spark, [5] * 50), column(spark, [5] * 40 + [6]), ["x"]).first().psi == 0.0
    ref, cur = [0] * 60 + [1] * 30 + list(range(2, 12)), [0] * 20 + [1] * 60 + [50] * 20
    assert drift.psi(column(spark, ref), column(spark, cur), ["x"]).first().psi == pytest.approx(
        numpy_psi(ref, cur))


def test_psi_skips_missing_and_empty(spark):
    ref, cur = column(spark, [1, 2, 3]), column(spark, [1]).where("x > 5")
    assert drift.psi(ref, cur, ["x", "y"]).collect() == []


def test_unseen_category_drifts(spark):
    ref = spark.createDataFrame([("a",)] * 50 + [("b",)] * 50, "c string")
    cur = spark.createDataFrame([("a",)] * 50 + [("z",)] * 50, "c string")
    row = drift.categorical_drift(ref, cur, ["c"]).first()
    assert row.n_categories == 3 and row.is_drifted
    assert not drift.categorical_drift(ref, ref, ["c"]).first().is_drifted
    assert drift.categorical_drift(ref.where("c = 'a'"), cur.where("c = 'a'"), ["c"]).collect() == []


def test_prediction_drift(spark):
    def shift(a, b):
        return drift.prediction_drift(column(spark, a, "prob"), column(spark, b, "prob")).first().drift_score
    assert shift([0.5], [0.6]) == 0.2 and shift([0.0], [0.4]) == 0.0


def test_report_without_drift(spark):
    ref = column(spark, range(100))
    row = drift.report(drift.feature_findings(ref, ref)).first()
    assert not row.overall_drift and row.drifted_features == "" and row.n_numerical == 1


def test_severity(spark):
    got = spark.range(1).select(*[drift.severity(F.lit(x)).alias(str(i))
                                  for i, x in enumerate([0.05, 0.10, 0.25, 0.26])]).first()
    assert list(got) == ["none", "moderate", "moderate", "significant"]


def test_tail_functions_against_tables():
    assert tails.student_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert tails.student_critical(0.05, 4) == pytest.approx(2.7764451, abs=1e-6)
    assert tails.chi_square_upper(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi_square_upper(15.507313056, 8) == pytest.approx(0.05, abs=1e-9)
    assert tails.student_two_sided(0.0, 7) == pytest.approx(1.0)


def test_identical_models_do_not_differ(spark):
    rows = spark.createDataFrame(
        [(m, f, 0.8 + f / 100) for m in ("a", "b") for f in range(5)],
        "model string, fold int, score double")
    row = comparison.all_pairs(rows, 0.25, 5, 2).first()
    assert row.t_statistic == 0.0 and not row.is_significant and row.effect == "negligible"


def test_consensus_counts_votes(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "feature string")

    def ranking_of(name, order):
        return spark.createDataFrame([(f, i + 1) for i, f in enumerate(order)], f"feature string, {name} int")
    table = selection.consensus(names, {
        "x": ranking_of("x", "abc"), "y": ranking_of("y", "bac"), "z": ranking_of("z", "a")}, top_n=1)
    got = {r.feature: (r.votes, r.selected, r.avg_rank) for r in table.collect()}
    assert got["a"] == (2, True, pytest.approx(4 / 3))
    assert got["b"] == (1, False, 2.0) and got["c"] == (0, False, 3.0)


def test_wide_quantiles_are_exact(spark):
    import numpy as np
    from lapsewatch.operators.brackets import wide_quantiles
    source = np.random.default_rng(1)
    table = {"a": source.normal(size=9000), "b": source.integers(0, 4, 9000).astype(float),
             "c": np.round(source.exponential(size=9000), 2)}
    group, fractions = source.integers(0, 2, 9000), [0.0, 0.1, 0.5, 0.75, 1.0]
    rows = [tuple(float(table[c][i]) for c in "abc") + (int(group[i]),) for i in range(9000)]
    rows += [(float("nan"), None, None, 0)] * 3
    df = spark.createDataFrame(rows, "a double, b double, c double, g int").withColumn(
        "empty", F.lit(None).cast("double"))
    found = wide_quantiles(df, ["a", "b", "c", "empty"], fractions)
    assert set(found) == {("a", 0), ("b", 0), ("c", 0)}
    halves = wide_quantiles(df, ["a", "c"], fractions, "g")
    for c in "abc":
        assert found[c, 0] == pytest.approx(list(np.quantile(table[c], fractions)), abs=1e-12)
    for c in "ac":
        for g in (0, 1):
            want = np.quantile(table[c][group == g], fractions)
            assert halves[c, g] == pytest.approx(list(want), abs=1e-12)
