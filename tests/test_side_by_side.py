"""Forests and boosted trees that are fitted side by side, every draw and fold in a task of its own."""

import json
import random
import threading

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from tremorgrid.operators import boosting, forests, models


@pytest.fixture(scope="module")
def table(spark):
    """Two features of which ``a`` decides the class, three folds."""
    rng = random.Random(5)
    rows = [(n, n % 3, n % 3 + rng.uniform(0, 0.8), rng.random(), n // 3 % 3) for n in range(270)]
    return spark.createDataFrame(rows, "n int, label_id int, a double, b double, fold int")


def never(*args, **kwargs):
    raise AssertionError("Spark's learner was called")


BUILDERS = {
    "rf": lambda **p: RandomForestClassifier(featuresCol="scaled", labelCol="label_id", seed=42, **p),
    "gbc": lambda **p: models.gradient_boosting(3, **p),
}


@pytest.mark.parametrize("family, draws", [
    ("rf", [{"numTrees": 1, "maxDepth": 0, "featureSubsetStrategy": "sqrt"},
            {"numTrees": 30, "maxDepth": 5, "featureSubsetStrategy": "0.9"}]),
    ("gbc", [{"maxIter": 1, "maxDepth": 0, "stepSize": 0.1}, {"maxIter": 20, "maxDepth": 2, "stepSize": 0.2}]),
])
def test_search(monkeypatch, spark, table, family, draws):
    monkeypatch.setattr(models.CrossValidator, "fit", never)
    monkeypatch.setattr(models.Pipeline, "fit", never)
    model, best, trials = models.random_search_cv(table, ["a", "b"], BUILDERS[family], draws, 3)
    scores = [r["best_score"] for r in trials.orderBy("model_order").collect()]
    assert best == draws[1] and scores[0] < 0.5 < 0.95 < scores[1]
    assert [json.loads(r["params"]) for r in trials.orderBy("model_order").collect()] == draws
    again = models.random_search_cv(table.orderBy("b"), ["a", "b"], BUILDERS[family], draws, 3)[2]
    assert scores == [r["best_score"] for r in again.orderBy("model_order").collect()]
    out = models.predicted(model, table).select(
        (F.col("prediction") == F.col("label_id")).alias("right"), F.aggregate("probs", F.lit(0.0), lambda s, p: s + p).alias("sum"))
    rows = out.collect()
    assert len(rows) == 270 and sum(r["right"] for r in rows) > 260 and all(abs(r["sum"] - 1) < 1e-9 for r in rows)


def test_each_fold_is_predicted_by_a_forest_that_has_not_seen_it(monkeypatch, table):
    monkeypatch.setattr(models.Pipeline, "fit", never)
    # Classes are exchanged in fold 0, so a forest of the other folds is wrong there, and only there if it never saw it.
    odd = table.withColumn("label_id", F.when(F.col("fold") == 0, (F.col("label_id") + 1) % 3).otherwise(F.col("label_id")))
    pipeline = models.scaled_pipeline(["a", "b"], models.top20_forest(60, 4))
    out = models.cross_val_predict(odd, pipeline, 3, ["n"]).groupBy("fold").agg(
        F.count("*").alias("rows"), F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("right"))
    found = {r["fold"]: (r["rows"], r["right"]) for r in out.collect()}
    assert {n: rows for n, (rows, _) in found.items()} == {0: 90, 1: 90, 2: 90}
    assert found[0][1] < 0.1


def test_larger_tables_and_other_parameters_are_for_spark(monkeypatch, table):
    monkeypatch.setattr(forests, "TASK_CELLS", 2 * 270 - 1)
    model, _, trials = models.random_search_cv(table, ["a", "b"], BUILDERS["rf"], [{"numTrees": 3}], 3)
    assert isinstance(model, PipelineModel) and trials.first()["best_score"] > 0.8
    assert forests.plan_of(RandomForestClassifier(impurity="entropy")) is None
    assert forests.plan_of(GBTClassifier(weightCol="w")) is None
    assert forests.plan_of(models.top20_forest()) == forests.ForestPlan(389, 30, 2, "log2", 1.0, 42)


@pytest.mark.parametrize("column, value", [("a", None), ("b", float("nan")), ("label_id", None)])
def test_missing_values_are_an_error(table, column, value):
    odd = table.withColumn(column, F.when(F.col("n") == 7, F.lit(value)).otherwise(F.col(column)))
    with pytest.raises(ValueError):
        forests.gathered(odd, ["a", "b"])


def test_trees_end_in_pure_leaves_or_at_the_least_size():
    rng = np.random.default_rng(1)
    values, labels = rng.random((400, 6)), rng.integers(0, 3, 400)
    binned, _ = forests.binned_values(values)
    plan = forests.ForestPlan(8, 40, 1, "all", 1.0, 0)
    feature, _, left, right, shares = forests.grow(binned, labels, 3, plan, 8, rng)
    ended = feature < 0
    assert (left[~ended] > 0).all() and (right[~ended] == left[~ended] + 1).all() and (left[ended] < 0).all()
    assert len(feature) == 8 + 2 * (~ended).sum()
    assert (shares[ended].max(axis=1) == 1).mean() > 0.95  # rows of one bin in every feature cannot be parted
    short = forests.grow(binned, labels, 3, plan._replace(depth=1, least=150), 8, rng)
    assert len(short[0]) <= 8 * 3
    assert [forests.subset_size(s, 64, 9) for s in ("sqrt", "log2", "0.9", "all", "auto", "onethird", "5")] == [8, 6, 58, 64, 8, 22, 5]


def test_boosting_counts_only_drawn_rows():
    """A node is split only where both sides have ``least`` drawn rows."""
    values = np.arange(64.0)[:, None]
    binned, inner = forests.binned_values(values)
    edges = np.hstack([inner, [[np.inf]]])
    slope, weight = np.where(values.T < 60, 1.0, -1.0), (np.arange(64) < 62).astype(float)
    assert boosting._grow(binned, edges, slope, weight, 1, 2)[1][0, 0] == 59
    assert boosting._grow(binned, edges, slope, weight, 1, 3)[1][0, 0] < 59


def test_network_trials_run_side_by_side(monkeypatch, spark):
    """Two trials are under way at once, and the best is the first of those with the highest accuracy."""
    met, seen = threading.Barrier(2, timeout=60), []

    def crossed(df, estimator, folds, keep, **kwargs):
        seen.append(estimator.getStages()[-1].getLayers())
        met.wait()
        right = 0 if estimator.getStages()[-1].getLayers()[1] == 32 else 1
        return spark.createDataFrame([(0, 0, 0, [1.0, 0.0]), (1, 1, right, [0.5, 0.5])],
                                     "fold int, y_true int, y_pred int, probs array<double>")

    rows = [([n / 10, 1 - n / 10], n % 2, n % 2, n % 5 == 0) for n in range(20)]
    table = spark.createDataFrame(rows, "x array<double>, label_id int, fold int, holdout boolean")
    monkeypatch.setattr(models, "cross_val_predict", crossed)
    _, best, study = models.tune_neural(table, "time", 2, 2, 4, ["x"], max_iter=2)
    draws = models.sample_params(models.NETWORK_SPACE, 4, 42)
    found = study.orderBy("model_order").collect()
    assert [json.loads(r["params"]) for r in found] == draws and len(seen) == 4
    assert [r["best_score"] for r in found] == [0.5 if d["first"] == 32 else 1.0 for d in draws]
    assert best == next(d for d in draws if d["first"] != 32)


def test_a_small_table_is_fitted_from_one_file_and_a_large_one_from_more(spark, monkeypatch):
    df = spark.range(0, 300, 1, 12).selectExpr("id", "id % 7 AS a", "id % 5 AS b")
    small = models.cut_for_fits(df, ["a", "b"])
    assert len(small.inputFiles()) == 1
    monkeypatch.setattr(models, "FIT_VALUES", 100)
    large = models.cut_for_fits(df, ["a", "b"])
    assert len(large.inputFiles()) == 6
    for table in (small, large):
        assert sorted(table.collect()) == sorted(df.collect())
    assert models.cut_for_fits(df.where("false"), ["a"]).count() == 0


def test_kinds_are_compared_on_a_table_of_one_file(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "cross_val_predict", lambda table, *a, **k: seen.append((len(table.inputFiles()), table.count())) or
                        table.selectExpr("fold", "label_id AS y_true", "label_id AS y_pred", "array(0.5D, 0.5D) AS probs"))
    df = spark.range(0, 60, 1, 12).selectExpr("cast(id % 3 AS int) AS fold", "cast(id % 2 AS int) AS label_id", "id * 0.1D AS a")
    models.compare_classifiers(df, ["a"], 2, 3)
    assert seen == [(1, 60)] * 8
