"""The registered model queries ask for the whole job: folds, trees, depth, draws and trials of the operators."""

from pathlib import Path

import pytest

from tremorgrid.operators import models
from tremorgrid.plans import catalog_models

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


class Called(Exception):
    pass


def asked(monkeypatch, spark, query, operator):
    """Arguments by name with which ``query`` calls ``operator``, which is not run."""
    import inspect

    signature = inspect.signature(getattr(models, operator))

    def record(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Called(bound.arguments)

    with monkeypatch.context() as patch:
        patch.setattr(models, operator, record)
        patch.setattr(catalog_models.fx, "_STORED", {})  # nothing that an earlier test has stored
        with pytest.raises(Called) as called:
            query(spark, SMALL)
    return called.value.args[0]


def test_whole_jobs(monkeypatch, spark):
    c = catalog_models
    boosted = asked(monkeypatch, spark, c.boosted_baseline, "boosted_baseline")
    assert (boosted["folds"], boosted["trees"], boosted["depth"]) == (5, 300, 5)
    assert boosted["df"].select("fold").distinct().count() == 5
    forest = asked(monkeypatch, spark, c.train_top20_forest, "train_top20_forest")
    assert (forest["folds"], forest["trees"], forest["depth"]) == (5, 389, 30)
    predicted = asked(monkeypatch, spark, c.cross_val_predict, "cross_val_predict")
    assert predicted["folds"] == 5 and predicted["estimator"].getStages()[-1].getNumTrees() == 389
    served = asked(monkeypatch, spark, c.top20_model, "top20_forest")
    assert (served["trees"], served["depth"]) == (389, 30)
    assert asked(monkeypatch, spark, c.compare_classifiers, "compare_classifiers")["folds"] == 5
    network = asked(monkeypatch, spark, c.neural, "neural_cv")
    assert network["folds"] == 5 and network["hidden"] == [64] and "maxIter" not in network["params"]
    tuned = asked(monkeypatch, spark, c.tune_neural, "tune_neural")
    assert (tuned["folds"], tuned["trials"], tuned["max_iter"]) == (5, 15, 60)


def test_windows_are_made_once_for_the_serving_table(monkeypatch, spark):
    """The folds, which read their input twice, are dealt over written rows."""
    def dealt(df, folds):
        raise Called({"plan": df._jdf.queryExecution().executedPlan().toString()})

    monkeypatch.setattr(catalog_models.splits, "group_kfold", dealt)
    monkeypatch.setattr(catalog_models.fx, "_STORED", {})
    with pytest.raises(Called) as called:
        catalog_models.top20_table(spark, SMALL)
    plan = called.value.args[0]["plan"]
    assert "Scan parquet" in plan and "ArrowEvalPython" not in plan and "Exchange" not in plan


def test_search_families(monkeypatch, spark):
    """Both families, 30 draws each from the stated spaces, and one winner."""
    seen = []

    def search(df, columns, build, draws, folds, parallelism=4):
        seen.append((draws, folds, build(**draws[0])))
        rows = [(n, "{}", (n + 10 * len(seen)) / 100) for n in range(len(draws))]
        return None, None, spark.createDataFrame(rows, "model_order int, params string, best_score double")

    monkeypatch.setattr(models, "random_search_cv", search)
    trials = catalog_models.random_search_cv(spark, SMALL).collect()
    assert [(len(draws), folds) for draws, folds, _ in seen] == [(30, 5), (30, 5)]
    for (draws, _, _), family in zip(seen, ("gbc", "rf")):
        assert draws == models.sample_params(models.SEARCH_SPACES[family], 30, 42)
    assert [(r["family"], r["model_order"]) for r in trials if r["winner"]] == [("rf", 29)]


def test_boosted_predictions(monkeypatch, spark):
    """The query returns every prediction, and those of a planted class beat the majority class."""
    whole = models.boosted_baseline

    def few_trees(df, columns, classes, **kwargs):
        planted = df.withColumn("f0", df["label_id"].cast("double"))
        return whole(planted, ["f0", "f1"], classes, folds=5, trees=2, depth=2, keep=kwargs["keep"])

    monkeypatch.setattr(models, "boosted_baseline", few_trees)
    monkeypatch.setattr(catalog_models.fx, "_STORED", {})
    rows = catalog_models.boosted_predictions(spark, SMALL).collect()
    assert {r["fold"] for r in rows} == set(range(5))
    assert len(rows) == len({r["window_index"] for r in rows}) == catalog_models.feature_table(spark, SMALL).count()
    truth = [r["y_true"] for r in rows]
    accuracy = sum(r["y_true"] == r["y_pred"] for r in rows) / len(rows)
    assert accuracy > max(truth.count(k) for k in set(truth)) / len(rows)


def test_clusters_settle(spark):
    """Rows that take more than 100 rounds: no row is nearer to the mean of another cluster than to that of its own."""
    import numpy as np
    from pyspark.sql import functions as F

    columns = [f"c{n}" for n in range(8)]
    table = spark.range(0, 8000, 1, 2).select("id", *[F.randn(seed=n).alias(c) for n, c in enumerate(columns)])
    found = models.kmeans_cluster(table, columns).select("cluster", *columns).toPandas()
    rows, cluster = found[columns].to_numpy(), found["cluster"].to_numpy()
    means = np.stack([rows[cluster == n].mean(axis=0) for n in range(3)])
    away = ((rows[:, None] - means) ** 2).sum(axis=2)
    assert (away.argmin(axis=1) == cluster).all()
