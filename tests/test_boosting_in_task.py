"""Boosted trees grown in one task against Spark's own fit."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from lapsewatch.operators import boosting, training


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(4)
    made = [(float(a), float(b), float(c), int(draw.random() < 1 / (1 + np.exp(-3 * (a * (b > 0) - 1)))))
            for a, b, c in zip(draw.integers(0, 4, 1200), draw.standard_normal(1200), draw.random(1200))]
    df = spark.createDataFrame(made, "a double, b double, c double, label int").withColumn(
        "weight", F.when(F.col("label") == 1, 2.0).otherwise(1.0))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).persist()



def test_all_rows_give_sparks_own_trees(rows):
    """Without draws nothing is left to chance: answers and importances are Spark's."""
    stage = GBTClassifier(**training.SPEC, maxIter=6, maxDepth=3, stepSize=0.3, seed=1)
    assert boosting.fits_in_task(stage, rows)
    spark_s, mine = stage.fit(rows), boosting.fit_in_task(stage, rows)
    assert type(mine) is type(spark_s) and mine.getNumTrees == 6
    assert np.allclose(spark_s.featureImportances.toArray(), mine.featureImportances.toArray())
    assert list(mine.treeWeights) == list(spark_s.treeWeights)
    for tree, other in zip(mine.trees, spark_s.trees):
        assert tree.numNodes == other.numNodes and tree.depth == other.depth
    from pyspark.ml.functions import vector_to_array
    both = spark_s.transform(rows).select("a", "b", "c", vector_to_array("probability")[1].alias("p")).join(
        mine.transform(rows).select("a", "b", "c", vector_to_array("probability")[1].alias("q")), ["a", "b", "c"])
    assert both.where("abs(p - q) > 1e-9").count() == 0 and both.count() == 1200


def test_draws_go_by_rows_not_by_partitions(rows):
    stage = GBTClassifier(**training.SPEC, maxIter=5, subsamplingRate=0.8, seed=3)
    one, other = (boosting.fit_in_task(stage, rows.repartition(n)) for n in (2, 5))
    assert one.toDebugString.split("\n")[1:] == other.toDebugString.split("\n")[1:]


def test_a_bounded_fit_runs_few_jobs(spark, rows):
    """A job for every level of every tree would be a hundred."""
    from pyspark.ml import Pipeline
    df = rows.drop("features").withColumn("customerID", F.monotonically_increasing_id().cast("string"))
    built = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"),
                             training.classifier("gradient_boosting", maxIter=20)])
    spark.sparkContext.setJobGroup("bounded", "bounded")
    try:
        model = training.fit(built, df, 600, in_task=True)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("bounded")) < 25
    assert model.transform(df).where("prediction = label").count() > 800


def test_missing_numbers_are_an_error(rows):
    odd = VectorAssembler(inputCols=["a", "b", "d"], outputCol="features", handleInvalid="keep").transform(
        rows.drop("features").withColumn("d", F.when(F.col("a") > 1, F.col("c"))))
    with pytest.raises(Exception, match="NaN"):
        boosting.fit_in_task(training.classifier("gradient_boosting", maxIter=2), odd)
