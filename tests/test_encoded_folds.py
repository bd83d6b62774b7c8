"""Folds whose rows are encoded once against whole pipelines fitted and applied fold by fold."""

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from lapsewatch.operators import splitting, training
from lapsewatch.plans.train import engineered, linear


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    odd = F.when(F.hash("customerID") % 97 == 0, "Rare").otherwise(F.col("Contract"))
    return engineered(spark, sf_dir).withColumn("Contract", odd).persist()


def sums(df, keys):
    found = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("label").alias("p"), F.sum("prob").alias("s"),
                                  F.sum(F.col("prob") * F.col("prob")).alias("q")).collect()
    return {tuple(r[k] for k in keys): (r.n, r.p, r.s, r.q) for r in found}


def test_predictions_are_those_of_whole_pipelines(rows, monkeypatch):
    """One table of vectors for two models of one encoding and fold; the answers stay."""
    tree = training.model_pipeline("decision_tree", select=False, engineer=False)
    written = []
    plain = training.materialise
    monkeypatch.setattr(training, "materialise", lambda df, name: written.append(name) or plain(df, name))
    found = sums(training.out_of_fold(rows, {"linear": linear(), "tree": tree}, 2), ["model", "fold"])
    assert written.count("vectors") == 2
    dealt = splitting.add_fold(rows, 2).persist()
    for name, pipeline in (("linear", linear()), ("tree", tree)):
        for fold in range(2):
            model = Pipeline(stages=pipeline.getStages()).fit(training.spread(dealt).where(F.col("fold") != fold))
            want = sums(training.score(model, dealt.where(F.col("fold") == fold)), ["fold"])[fold,]
            assert found[name, fold] == pytest.approx(want, rel=1e-6)


def test_curve_reads_vectors(rows, monkeypatch):
    written = []
    plain = training.materialise
    monkeypatch.setattr(training, "materialise", lambda df, name: written.append(name) or plain(df, name))
    quick = training.model_pipeline("logistic_regression", {"maxIter": 5}, select=False, engineer=False)
    curve = training.learning_curve(rows, quick, [0.5, 1.0], 2).collect()
    assert written.count("vectors") == 4 and sorted(r.size if not callable(r.size) else r["size"] for r in curve) == [0.5, 1.0]
    monkeypatch.setattr(training, "_has_encoding", lambda pipeline: False)
    again = {r["size"]: r for r in training.learning_curve(rows, quick, [0.5, 1.0], 2).collect()}
    for r in curve:
        assert tuple(r)[1:] == pytest.approx(tuple(again[r["size"]])[1:], abs=2e-4)
