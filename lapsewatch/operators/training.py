"""Model training with Spark ML: factory, cross-validation, calibration, search, benchmarks.

Every fit and every prediction runs on the executors; the driver handles metrics of a few rows.
Predictions of a cross-validation are written once to the shared folder before they are measured,
so losing an executor never repeats a fit.
"""

from __future__ import annotations

import json
import math
import random
import statistics
import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewatch import constants as K
from lapsewatch.operators import boosting, calibration, fairness, features, metrics, splitting
from lapsewatch.operators.encoding import routed_stages, vector_names
from lapsewatch.operators.smalltables import as_they_lie, materialise, spread
from lapsewatch.session import scratch_path

SPEC = dict(featuresCol="features", labelCol="label", weightCol="weight")

# The algorithms a configuration may name, with their defaults.
ALGORITHMS: dict[str, Callable[..., Estimator]] = {
    "gradient_boosting": lambda **p: GBTClassifier(**SPEC, seed=K.SEED, **{
        "maxIter": 100, "stepSize": 0.05, "maxDepth": 5, "subsamplingRate": 0.8, **p}),
    "random_forest": lambda **p: RandomForestClassifier(**SPEC, seed=K.SEED, **{
        "numTrees": 300, "maxDepth": 12, **p}),
    "decision_tree": lambda **p: DecisionTreeClassifier(**SPEC, seed=K.SEED, **p),
    "logistic_regression": lambda **p: LogisticRegression(**SPEC, **{"maxIter": 100, **p}),
    "linear_svc": lambda **p: LinearSVC(**SPEC, **p),
}


def classifier(algorithm: str, **params) -> Estimator:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm}; known: {', '.join(ALGORITHMS)}")
    return ALGORITHMS[algorithm](**params)


class FeatureStage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The 28 features as a pipeline stage, so a saved model takes clean customer rows."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return features.engineer(dataset)


class ImportanceSelector(Estimator):
    """Keeps the vector slots whose importance reaches a share of the mean importance."""

    def __init__(self, share: float = 0.5, input_col: str = "all_features",
                 output_col: str = "features", **params):
        super().__init__()
        self.share, self.input_col, self.output_col = share, input_col, output_col
        self.params_ = {"maxIter": 10, "maxDepth": 4, **params}

    def _fit(self, dataset: DataFrame) -> VectorSlicer:
        return self.chosen(self.judge().fit(dataset))

    def judge(self) -> Estimator:
        return classifier("gradient_boosting", **self.params_).setFeaturesCol(self.input_col)

    def chosen(self, judge: Transformer) -> VectorSlicer:
        importances = self.importances_ = judge.featureImportances.toArray()
        limit = self.share * importances.mean()
        kept = [i for i, x in enumerate(importances) if x >= limit]
        return VectorSlicer(inputCol=self.input_col, outputCol=self.output_col, indices=kept)


def model_pipeline(algorithm: str = "gradient_boosting", params: Mapping | None = None,
                   select: bool = True, engineer: bool = True,
                   selector: Mapping | None = None, **routes: Sequence[str]) -> Pipeline:
    """Features -> encoding -> importance selection -> classifier; any part can be changed."""
    vector = "all_features" if select else "features"
    stages = [FeatureStage()] if engineer else []
    stages += routed_stages(output=vector, **routes)
    if select:
        stages.append(ImportanceSelector(**(selector or {})))
    stages.append(classifier(algorithm, **(params or {})))
    return Pipeline(stages=stages)


def class_weights(df: DataFrame, fixed: float = K.POSITIVE_CLASS_WEIGHT) -> DataFrame:
    """Per class: rows, the balancing weight n / (2 * rows), and the fixed positive weight."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumns({
        "balanced_weight": total / (2.0 * F.col("n")),
        "fixed_weight": F.when(F.col("label") == 1, F.lit(fixed)).otherwise(F.lit(1.0)),
    })


def with_weight(df: DataFrame, weight: float | str = K.POSITIVE_CLASS_WEIGHT) -> DataFrame:
    """``weight`` column: a factor for positives, or "balanced"."""
    if weight == "balanced":
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
        up, down = row["n"] / (2.0 * row["p"]), row["n"] / (2.0 * (row["n"] - row["p"]))
    else:
        up, down = float(weight), 1.0
    return df.withColumn("weight", F.when(F.col("label") == 1, up).otherwise(F.lit(down)))


#: Partitions of a bounded fit.
BOUNDED_PARTS = 8


def fit(pipeline: Pipeline, df: DataFrame, rows: int | None = None, in_task: bool = False) -> PipelineModel:
    """Fit on rows kept in memory (or on disk) for the many passes of the stages.

    ``rows`` bounds the labelled rows that the fit takes, chosen by a hash of the key. With ``in_task``
    boosted trees of a bounded fit are grown in one task, not through a job for each level of each tree.
    """
    in_task = in_task and rows is not None
    kept = spread(splitting.at_most(df, rows), most=BOUNDED_PARTS if in_task else None).persist()
    try:
        return _fit_bounded(pipeline, kept) if in_task else pipeline.fit(kept)
    finally:
        kept.unpersist()


def _fit_bounded(pipeline: Pipeline, rows: DataFrame) -> PipelineModel:
    """The stages fitted one by one: boosted trees in a task, what else takes many jobs on rows read as they lie."""
    def learn(stage: Estimator, rows: DataFrame) -> Transformer:
        if boosting.fits_in_task(stage, rows):
            return boosting.fit_in_task(stage, rows)
        return stage.fit(as_they_lie(rows) if stage.hasParam("featuresCol") else rows)

    fitted = []
    for stage in pipeline.getStages():
        if isinstance(stage, ImportanceSelector):
            stage = stage.chosen(learn(stage.judge(), rows))
        elif isinstance(stage, Estimator):
            stage = learn(stage, rows)
        fitted.append(stage)
        rows = stage.transform(rows)
    return PipelineModel(fitted)


def positive_probability(df: DataFrame) -> Column:
    """Probability of class 1; a classifier without one gives the logistic of its margin."""
    if "probability" in df.columns:
        return vector_to_array("probability")[1]
    return 1.0 / (1.0 + F.exp(-vector_to_array("rawPrediction")[1]))


def score(model: PipelineModel, df: DataFrame, name: str = "prob") -> DataFrame:
    """Input columns plus the churn probability."""
    scored = model.transform(df)
    return scored.withColumn(name, positive_probability(scored)).select(*df.columns, name)


#: Fits of one call that run beside each other.
PARALLEL = 8


def side_by_side(spark: SparkSession, work: Callable, items: Iterable) -> list:
    """Results of ``work`` on each item, in order, some at a time.

    A fit is a chain of small jobs that leaves most cores idle; Spark shares them among the fits.
    Every item has its own copy of the session's local properties: Spark notes there which query a
    thread runs, and one copy for all would let them overwrite each other's note.
    """
    with ThreadPoolExecutor(PARALLEL) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(work), i) for i in items]]


def _fit_on(pipeline: Pipeline, rows: DataFrame, most: int | None) -> PipelineModel:
    """A fit on rows that are in memory already, or on a part of them that is taken out first."""
    return pipeline.fit(rows) if most is None else fit(pipeline, rows, most, True)


def _signature(stages: Sequence) -> str:
    """What stages do, the same for stages that do the same."""
    def of(stage) -> str:
        own = {k: v for k, v in vars(stage).items() if not k.startswith("_") and k != "uid" and not hasattr(v, "parent")}
        return f"{type(stage).__name__} { {p.name: v for p, v in sorted(stage._paramMap.items(), key=str)} } {own}"

    return " | ".join(map(of, stages))


def encoded_once(spark: SparkSession, rows: DataFrame, asked: Mapping, train: Callable[..., Column],
                 held: Callable[..., Column]) -> dict:
    """For each item of ``asked`` (its pipeline): the classifier left to fit, the rows encoded and written, the encoder.

    The encoding is fitted on the rows of ``train(item)`` alone and applied to them and to those of ``held(item)``. Items that ask for the same encoding of the
    same rows share one table; a fit, its passes and its predictions then read vectors, not all columns again.
    """
    tables: dict[str, tuple] = {}
    for item, pipeline in asked.items():
        head = pipeline.getStages()[:-1]
        tables.setdefault(f"{_signature(head)} | {train(item)}", (item, head))

    def encode(entry: tuple) -> tuple[DataFrame, PipelineModel]:
        item, head = entry
        model, last = Pipeline(stages=head).fit(rows.where(train(item))), asked[item].getStages()[-1]
        kept = [c for c in ("fold", "size_step", "label", "weight") if c in rows.columns]
        used = rows.where(train(item) | held(item))
        return materialise(model.transform(used).select(*kept, last.getFeaturesCol()), "vectors"), model

    done = dict(zip(tables, side_by_side(spark, encode, tables.values())))
    return {item: (p.getStages()[-1], *done[f"{_signature(p.getStages()[:-1])} | {train(item)}"])
            for item, p in asked.items()}


def _has_encoding(pipeline: Pipeline) -> bool:
    """Whether more than a projection stands before the classifier."""
    return any(isinstance(stage, Estimator) for stage in pipeline.getStages()[:-1])


def out_of_fold(df: DataFrame, pipelines: Mapping[str, Pipeline], k: int = 5, with_train: bool = False,
                fit_rows: Mapping[str, int] | None = None) -> DataFrame:
    """Out-of-fold predictions (model, fold, part, label, prob); everything is refitted in each fold.

    All models and folds are fitted side by side, and what each predicts is written at once.
    ``fit_rows`` bounds the labelled rows that the fits of a model take; all rows are predicted.
    """
    rows, bounds = spread(splitting.add_fold(df, k)).persist(), fit_rows or {}

    asked = [(m, f) for m in pipelines for f in range(k)]

    def predictions(item: tuple[str, int]) -> DataFrame:
        (name, fold), (pipeline, source, *_) = item, encoded.get(item, (pipelines[item[0]], rows))
        inside = source.where(F.col("fold") != fold)
        model = _fit_on(pipeline, inside, bounds.get(name))
        held = {"validation": source.where(F.col("fold") == fold)}
        if with_train:
            held["train"] = inside
        return materialise(_union([
            score(model, part).select(F.lit(name).alias("model"), F.lit(fold).alias("fold"),
                                      F.lit(of).alias("part"), "label", "prob")
            for of, part in held.items()]), "cv-predictions")

    try:
        rows.count()  # in memory before the fits ask for them together
        encoded = _encoded_folds(df.sparkSession, rows, pipelines, asked, bounds)
        return _union(side_by_side(df.sparkSession, predictions, asked))
    finally:
        rows.unpersist()


def _encoded_folds(spark: SparkSession, rows: DataFrame, pipelines: Mapping[str, Pipeline],
                   asked: Sequence[tuple[str, int]], bounds: Mapping[str, int]) -> dict:
    """The encoded rows of every (model, fold) whose fit takes all rows."""
    whole = {item: pipelines[item[0]] for item in asked
             if bounds.get(item[0]) is None and _has_encoding(pipelines[item[0]])}
    return encoded_once(spark, rows, whole, lambda item: F.col("fold") != item[1], lambda item: F.col("fold") == item[1])


def cross_validate(df: DataFrame, pipeline: Pipeline, k: int = 5, with_train: bool = False,
                   fit_rows: int | None = None) -> DataFrame:
    """Out-of-fold predictions (fold, part, label, prob) of one pipeline."""
    bounds = {} if fit_rows is None else {"one": fit_rows}
    return out_of_fold(df, {"one": pipeline}, k, with_train, bounds).drop("model")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def dummy_predictions(df: DataFrame, k: int = 5) -> DataFrame:
    """A stratified guess: 1 with the probability of the base rate, fixed by the key."""
    rate = df.agg(F.avg(F.col("label").cast("double"))).scalar()
    return splitting.add_fold(df, k).select(
        "fold", F.lit("validation").alias("part"), "label",
        (splitting.hash_share(salt="dummy:") < rate).cast("double").alias("prob"))


def scan(df: DataFrame, pipelines: Mapping[str, Pipeline], k: int = 5,
         fit_rows: Mapping[str, int] | None = None) -> DataFrame:
    """Leaderboard of several pipelines and a dummy by cross-validated average precision."""
    from lapsewatch.operators import leaderboard
    guess = dummy_predictions(df, k).withColumn("model", F.lit("Dummy"))
    scores = leaderboard.fold_scores(out_of_fold(df, pipelines, k, fit_rows=fit_rows).unionByName(guess))
    return leaderboard.cv_summary(scores).orderBy(F.desc("cv_pr_auc_mean"))


def importances(model: PipelineModel, df: DataFrame, top: int = 20) -> DataFrame:
    """Largest importances of the fitted classifier with the names of their slots."""
    last = model.stages[-1]
    names = vector_names(model.transform(df.limit(0)))
    weights = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(n, float(w)) for n, w in zip(names, weights.toArray())]
    rows = sorted(rows, key=lambda r: (-abs(r[1]), r[0]))[:top]
    return df.sparkSession.createDataFrame(
        [(i + 1, n, w) for i, (n, w) in enumerate(rows)], "place int, feature string, importance double")


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def has_model(path: str) -> bool:
    """Whether a model was saved there, asked of whatever store the path is in."""
    try:
        SparkSession.active().read.text(f"{path}/metadata")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def load_or_train(path: str | None, train: Callable[[], PipelineModel]) -> PipelineModel:
    """The saved model when there is one, else a freshly trained one. A broken one is an error."""
    return PipelineModel.load(path) if path and has_model(path) else train()


def log_run(spark: SparkSession, path: str, run_id: str, values: Mapping[str, object],
            prefix: str = "") -> None:
    """Append one run's parameters or numeric metrics as (run_id, key, value) rows."""
    rows = [(run_id, f"{prefix}{key}", str(value)) for key, value in values.items()
            if not (prefix and not isinstance(value, (int, float)))]
    spark.createDataFrame(rows, "run_id string, key string, value string").write.mode(
        "append").parquet(path)


def experiment(df: DataFrame, pipeline: Pipeline, k: int = 3,
               attributes: Sequence[str] = ("gender", "SeniorCitizen"),
               fit_rows: int | None = None) -> DataFrame:
    """Split, cross-validate, fit, calibrate and choose a threshold on validation rows, then
    measure on test rows: (section, name, value) findings with the release gates.

    ``fit_rows`` bounds the labelled rows of each fit; all others are measured as they are.
    """
    rows = splitting.add_split(df)
    train = rows.where("split = 'train'").drop("split")
    folds = metrics.ranking_scores(cross_validate(train, pipeline, k, fit_rows=fit_rows), ["fold"])
    model = fit(pipeline, train, fit_rows)
    held = materialise(
        score(model, rows.where("split <> 'train'")).select(
            "customerID", "split", "label", "prob", *attributes), "held-out")
    validation = held.where("split = 'validation'")
    isotonic = calibration.fit_isotonic(validation)
    calibrated = materialise(
        calibration.apply_isotonic(held, isotonic).withColumnRenamed("prob", "raw_prob")
        .withColumnRenamed("calibrated", "prob"), "calibrated")
    sweep = metrics.threshold_sweep(calibrated.where("split = 'validation'"))
    threshold = metrics.cost_optimal(sweep).first()["threshold"]
    test = calibrated.where("split = 'test'")

    def findings(section: str, one_row: DataFrame) -> DataFrame:
        numbers = one_row.select(*[F.col(c).cast("double").alias(c) for c, t in one_row.dtypes
                                   if t not in ("string",)])
        return numbers.unpivot([], numbers.columns, "name", "value").select(
            F.lit(section).alias("section"), "name", "value")

    flat = metrics.flat_metrics(test, threshold).withColumn("passes_gates", metrics.passes_gates())
    cv = folds.agg(
        F.avg("roc_auc").alias("roc_auc_mean"), F.stddev_pop("roc_auc").alias("roc_auc_std"),
        F.avg("average_precision").alias("pr_auc_mean"),
        F.stddev_pop("average_precision").alias("pr_auc_std"))
    audit = fairness.audit(test, attributes, threshold).agg(
        F.min("parity_ratio").alias("min_parity_ratio"),
        F.max("tpr_disparity").alias("max_tpr_disparity"),
        F.max("fpr_disparity").alias("max_fpr_disparity"),
        F.bool_and("overall_fair").alias("overall_fair"))
    chosen = flat.select(F.lit(threshold).alias("threshold"))
    return _union([
        findings("cross_validation", cv), findings("threshold", chosen), findings("test", flat),
        findings("calibration", calibration.compare_stages(test, "raw_prob", "prob")),
        findings("fairness", audit)])


# Search space as (low, high, scale) or (low, high, step).
SEARCH_SPACE = {
    "maxIter": (100, 1000, 50),
    "stepSize": (0.01, 0.3, "log"),
    "maxDepth": (3, 12, 1),
    "minInstancesPerNode": (5, 50, 1),
    "subsamplingRate": (0.5, 1.0, "linear"),
    "weight": (1.0, 5.0, "linear"),
}


def draw(space: Mapping[str, tuple], source: random.Random) -> dict[str, float]:
    """One random point of a search space."""
    point = {}
    for name, (low, high, kind) in space.items():
        if kind == "log":
            point[name] = math.exp(source.uniform(math.log(low), math.log(high)))
        elif kind == "linear":
            point[name] = source.uniform(low, high)
        else:
            point[name] = low + kind * source.randrange((high - low) // kind + 1)
    return point


#: Labelled rows that a search is run on, chosen by a hash of the key: every trial holds them.
SEARCH_ROWS = 4000


def search(codes: DataFrame, features: Sequence[str], space: Mapping[str, tuple] = SEARCH_SPACE,
           trials: int = 50, k: int = 3, seed: int = K.SEED, startup: int = 5,
           rows: int = SEARCH_ROWS) -> DataFrame:
    """Random search for boosted trees by mean average precision; weak trials end early.

    ``codes`` has customerID, label and the features as numbers. At most about ``rows`` labelled
    rows are taken (a bound: each trial is one task on the same binned sample). All trials run a
    fold side by side; those that ``should_prune`` ends do not get the next one, exactly as if
    they had run one after the other. Inside a trial, rounds end early as well. ``weight`` in a
    point is the weight of the positive class. ``scores`` lists the means reached after each fold.
    """
    spark = codes.sparkSession
    sample = splitting.add_fold(splitting.at_most(codes, rows), k).orderBy("customerID").select(
        "fold", "label", *features).toPandas()
    fold, label = sample["fold"].to_numpy(), sample["label"].to_numpy()
    matrix = boosting.binned(sample[list(features)].to_numpy(float))
    source = random.Random(seed)
    points = [draw(space, source) for _ in range(trials)]

    def work(batches):
        for batch in batches:
            found = [boosting.fit_and_score(
                matrix, label, np.flatnonzero(fold != f), np.flatnonzero(fold == f), points[t], seed + t)
                for t, f in zip(batch["trial"], batch["fold"])]
            yield batch.assign(score=[s for s, _ in found], rounds=[n for _, n in found])

    means: list[list[float]] = [[] for _ in points]
    rounds = [0] * trials
    pruned = [False] * trials
    for f in range(k):
        open_ = [t for t in range(trials) if not pruned[t]]
        # A task each, so that a long trial holds up no other.
        asked = spark.createDataFrame([(t, f) for t in open_], "trial int, fold int").repartitionByRange(
            len(open_), "trial")
        reached = asked.mapInPandas(work, "trial int, fold int, score double, rounds int").collect()
        for r in reached:
            means[r.trial].append((sum(means[r.trial][-1:]) * f + r.score) / (f + 1))
            rounds[r.trial] += r.rounds
        for t in open_:
            finished = [means[o] for o in range(t) if not pruned[o]]
            pruned[t] = should_prune(means[t], finished, k, startup)
    return spark.createDataFrame(
        [(t, json.dumps(points[t], sort_keys=True), len(means[t]), rounds[t], means[t][-1], pruned[t],
          json.dumps(means[t])) for t in range(trials)],
        "trial int, params string, folds int, rounds int, value double, pruned boolean, scores string")


def should_prune(means: Sequence[float], finished: Sequence[Sequence[float]], k: int,
                 startup: int = 5) -> bool:
    """Whether a trial ends after its last fold so far: its mean is below the median of finished
    trials at that fold. Not after the first fold, not after the last, and only once ``startup``
    trials have finished."""
    fold = len(means) - 1
    if not 0 < fold < k - 1 or len(finished) < startup:
        return False
    return means[-1] < statistics.median(other[fold] for other in finished)


def best_trial(table: DataFrame) -> DataFrame:
    """One row: the best finished trial, its parameters and score, and how many ended how."""
    done = F.struct(F.col("value"), -F.col("trial"), F.col("params"))
    return table.agg(
        F.max(F.when(~F.col("pruned"), done)).alias("best"), F.count_if("pruned").alias("n_pruned"),
        F.count_if(~F.col("pruned")).alias("n_completed")).select(
        F.col("best.value").alias("value"), F.col("best.params").alias("params"), "n_pruned", "n_completed")


def benchmark(df: DataFrame, pipelines: Mapping[str, Pipeline], k: int = 5,
              fit_rows: Mapping[str, int] | None = None) -> DataFrame:
    """Per model: mean and deviation over folds of ROC-AUC, F1 at 0.5 and Brier score, and the
    milliseconds per scored row. Fits run side by side; scoring is timed alone."""
    rows, bounds = spread(splitting.add_fold(df, k)).persist(), fit_rows or {}
    asked, parts, times = [(m, f) for m in pipelines for f in range(k)], [], []
    try:
        rows.count()
        encoded = _encoded_folds(df.sparkSession, rows, pipelines, asked, bounds)

        def fitted(item: tuple[str, int]) -> PipelineModel:
            if item not in encoded:
                return _fit_on(pipelines[item[0]], rows.where(F.col("fold") != item[1]), bounds.get(item[0]))
            last, vectors, head = encoded[item]
            # Scoring is timed from the columns on, as a model is used.
            return PipelineModel([head, last.fit(vectors.where(F.col("fold") != item[1]))])

        models = side_by_side(df.sparkSession, fitted, asked)
        for (name, fold), model in zip(asked, models):
            held = score(model, rows.where(F.col("fold") == fold)).select(
                F.lit(name).alias("model"), F.lit(fold).alias("fold"), "label", "prob")
            start = time.perf_counter()
            parts.append(materialise(held, "benchmark"))
            times.append((name, fold, time.perf_counter() - start))
    finally:
        rows.unpersist()
    spent = df.sparkSession.createDataFrame(times, "model string, fold int, seconds double")
    return benchmark_table(_union(parts), spent)


BENCHMARKED = ("roc_auc", "f1", "brier")


def benchmark_folds(predictions: DataFrame) -> DataFrame:
    """ROC-AUC, F1 at 0.5 and Brier score per (model, fold)."""
    keys = ["model", "fold"]
    at_half = predictions.groupBy(*keys).agg(
        *metrics.confusion_columns(0.5), metrics.brier().alias("brier"),
        F.count(F.lit(1)).alias("n")).withColumns(metrics.precision_recall_f1())
    return at_half.join(metrics.ranking_scores(predictions, keys), keys)


def benchmark_table(predictions: DataFrame, spent: DataFrame | None = None) -> DataFrame:
    """Mean and deviation over folds; ``spent`` adds the scoring time per (model, fold)."""
    folds, measures = benchmark_folds(predictions), BENCHMARKED
    if spent is not None:
        folds = folds.join(spent, ["model", "fold"]).withColumn(
            "ms_per_row", F.col("seconds") * 1000.0 / F.col("n"))
        measures = (*measures, "ms_per_row")
    return folds.groupBy("model").agg(*[
        a for c in measures
        for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])


def benchmark_highlights(table: DataFrame) -> DataFrame:
    """The model with the best ROC-AUC, the best calibrated one and, when timed, the fastest."""
    best = [F.max_by("model", "roc_auc_mean").alias("best_roc_auc"),
            F.min_by("model", "brier_mean").alias("best_brier")]
    if "ms_per_row_mean" in table.columns:
        best.append(F.min_by("model", "ms_per_row_mean").alias("fastest"))
    return table.agg(*best)


def learning_curve(df: DataFrame, pipeline: Pipeline, sizes: Sequence[float], k: int = 5
                   ) -> DataFrame:
    """Train and validation average precision per training share: mean and deviation over folds.

    The shares are nested: a larger one contains the smaller ones.
    """
    rows = spread(splitting.add_nested_share(splitting.add_fold(df, k), 100)).persist()

    def inside(item: tuple[float, int]) -> Column:
        return (F.col("fold") != item[1]) & (F.col("size_step") <= round(item[0] * 100))

    asked = [(size, fold) for size in sizes for fold in range(k)]

    def predictions(item: tuple[float, int]) -> DataFrame:
        (size, fold), (last, source, *_) = item, encoded.get(item, (pipeline, rows))
        train = source.where(inside(item))
        model = last.fit(train)
        held = {"train": train, "validation": source.where(F.col("fold") == fold)}
        return materialise(_union([
            score(model, part).select(F.lit(float(size)).alias("size"), F.lit(fold).alias("fold"),
                                      F.lit(name).alias("part"), "label", "prob")
            for name, part in held.items()]), "learning-curve")

    try:
        rows.count()
        encoded = encoded_once(df.sparkSession, rows, dict.fromkeys(asked, pipeline) if _has_encoding(pipeline) else {},
                               inside, lambda item: F.col("fold") == item[1])
        written = _union(side_by_side(df.sparkSession, predictions, asked))
    finally:
        rows.unpersist()
    scores = metrics.ranking_scores(written, ["size", "fold", "part"])
    return curve_table(scores)


def curve_table(scores: DataFrame) -> DataFrame:
    """Fold scores (size, part, average_precision) as one row per size (4 dp)."""
    def of(part: str, aggregate) -> Column:
        return F.round(aggregate(F.when(F.col("part") == part, F.col("average_precision"))), 4)

    return scores.groupBy("size").agg(
        of("train", F.avg).alias("train_mean"), of("train", F.stddev_pop).alias("train_std"),
        of("validation", F.avg).alias("validation_mean"),
        of("validation", F.stddev_pop).alias("validation_std"))


def diagnose_curve(curve: DataFrame) -> DataFrame:
    """Final gap, slope of the last steps and a verdict; one row per curve, few sizes each."""
    from pyspark.sql import Window
    order = Window.orderBy("size")
    last_first = Window.orderBy(F.desc("size"))
    step = F.col("validation_mean") - F.lag("validation_mean").over(order)
    placed = curve.withColumns({"step": step, "from_end": F.row_number().over(last_first)})
    rolled = placed.agg(
        F.max(F.when(F.col("from_end") == 1, F.col("train_mean") - F.col("validation_mean")))
        .alias("gap"),
        F.max(F.when(F.col("from_end") == 1, F.col("validation_mean"))).alias("final"),
        F.avg(F.when(F.col("from_end") <= 2, F.col("step"))).alias("slope"),
        F.count(F.lit(1)).alias("sizes"))
    gap = F.round("gap", 4)
    return rolled.select(
        gap.alias("final_gap"),
        F.when(F.col("sizes") >= 3, F.round("slope", 6)).otherwise(F.lit(0.0)).alias("slope"),
        F.when(gap > 0.05, "high_variance").when(F.col("final") < 0.60, "high_bias")
        .otherwise("well_fitted").alias("diagnosis"))
