"""Path contributions add up to the answers of fitted ensembles."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lapsewatch.operators import attribution, scoring, training
from lapsewatch.operators.encoding import vector_names
from lapsewatch.plans.train import engineered

PARAMS = {"gradient_boosting": {"maxIter": 6, "maxDepth": 4}, "random_forest": {"numTrees": 5, "maxDepth": 4},
          "decision_tree": {"maxDepth": 4}}


@pytest.mark.parametrize("algorithm", sorted(PARAMS))
def test_contributions_add_up_to_the_answer(spark, sf_dir, algorithm):
    rows = engineered(spark, sf_dir)
    model = training.fit(training.model_pipeline(algorithm, PARAMS[algorithm], select=False, engineer=False), rows)
    scored = model.transform(rows)
    forest = attribution.Forest.of(attribution.tree_table(model.stages[-1], spark))
    answer = "rawPrediction" if algorithm == "gradient_boosting" else "probability"
    found = attribution.attributed(scored, forest, vector_names(scored)).select(
        vector_to_array(answer)[1].alias("answer"), "margin", "strongest", "contributions").collect()
    assert len(found) == rows.count()
    names = vector_names(scored)
    for r in found:
        assert r.margin == pytest.approx(r.answer, abs=1e-9)
        terms = np.array(r.contributions)
        assert [t.term for t in r.strongest] == pytest.approx(sorted(terms, key=abs, reverse=True)[:3])
        assert all(terms[names.index(t.feature)] == t.term for t in r.strongest)


def test_categories_and_missing_numbers(spark):
    """A split on three categories and one on a number; a missing number goes right."""
    nodes = [(0, 2.0, 0, 1.0, 1, 2, 0, [0.0, 2.0], 3), (0, 2.0, 1, 3.0, -1, -1, -1, [], -1),
             (0, 2.0, 2, 0.5, 3, 4, 1, [7.5], -1), (0, 2.0, 3, -1.0, -1, -1, -1, [], -1), (0, 2.0, 4, 4.0, -1, -1, -1, [], -1)]
    forest = attribution.Forest.of(spark.createDataFrame(nodes, attribution.NODES))
    x = np.array([[0, 1.0], [2, 9.0], [1, 7.5], [1, 8.0], [1, np.nan]])
    assert forest.bias == 2.0 and forest.depth == 2
    assert forest.contributions(x).tolist() == [[4.0, 0.0], [4.0, 0.0], [-1.0, -3.0], [-1.0, 7.0], [-1.0, 7.0]]


def test_explanations_of_a_boosted_pipeline(spark, sf_dir):
    rows = engineered(spark, sf_dir).limit(300)
    model = training.fit(training.model_pipeline(
        "gradient_boosting", {"maxIter": 3, "maxDepth": 3}, selector={"maxIter": 2, "maxDepth": 2}, engineer=False), rows)
    told = scoring.explain(model, rows)
    assert told.where(F.size("explanation") == 3).count() == told.where("prob BETWEEN 0 AND 1").count() == 300
