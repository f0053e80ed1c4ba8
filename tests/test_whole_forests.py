"""Forests are fitted on every row, and their trees stay in the tasks and the shared folder."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorgrid.operators import forests, models
from tremorgrid.plans import catalog_models

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def late(spark):
    """3,000 rows of which the 1,800 with the smallest hashes of their features are class 0 and the others class 1."""
    rng = random.Random(7)
    rows = [(n, n % 50, n % 5, rng.random(), rng.random()) for n in range(3000)]
    table = spark.createDataFrame(rows, "n int, file int, fold int, a double, b double")
    first = {r["n"] for r in models.training_rows(table, ["a", "b"], 1800).collect()}
    return spark.createDataFrame([(*r, int(r[0] not in first)) for r in rows],
                                 "n int, file int, fold int, a double, b double, label_id int")


def test_the_serving_forest_and_its_folds_see_every_row(late):
    model, predictions = models.train_top20_forest(late, trees=12, depth=12, keep=["n"], columns=["a", "b"])
    out = predictions.collect()
    assert sorted(r["n"] for r in out) == list(range(3000)) and {r["fold"] for r in out} == set(range(5))
    assert 300 < sum(r["y_pred"] for r in out)  # 0 if the rows with the smallest hashes were all that is seen
    assert models.predicted(model, late).where("prediction = 1 and label_id = 1").count() > 300


def test_trees_do_not_meet_in_the_driver(monkeypatch, late):
    """The cells that are collected are bins and edges of the table, whatever the number of trees."""
    got, whole = [], type(late).collect

    def collected(df):
        rows = whole(df)
        got.extend(len(x) for r in rows for c in r for x in (c if isinstance(c, list) else [c]) if isinstance(x, (bytes, bytearray)))
        return rows

    monkeypatch.setattr(type(late), "collect", collected)
    pipeline = models.scaled_pipeline(["a", "b"], models.top20_forest(40, 12))
    out = models.cross_val_predict(late, pipeline, 5, ["n"])
    assert 0 < sum(got) <= 6 * 3000 * 8 + 5 * (2 * 3000 + 2 * 31 * 8)  # classes and folds, bins and edges
    assert out.count() == 3000


def test_folds_one_at_a_time_give_the_same_in_any_order_of_rows(monkeypatch, late):
    def asked(table):
        rows = models.cross_val_predict(table, models.scaled_pipeline(["a", "b"], models.top20_forest(30, 6)), 5, ["n"]).collect()
        return {r["n"]: (r["y_pred"], tuple(r["probs"])) for r in rows}

    once = asked(late)
    monkeypatch.setattr(forests, "TASK_CELLS", 1)
    monkeypatch.setattr(forests, "VOTE_ROWS", 97)
    assert once == asked(late.orderBy(F.desc("b")).repartition(7))
    assert all(abs(sum(p) - 1) < 1e-9 for _, p in once.values())


def test_a_stored_forest_is_saved_and_loaded(spark, late, tmp_path):
    model = models.fit_forest(late, models.scaled_pipeline(["b", "a"], models.top20_forest(30, 8)))
    assert isinstance(model, models.StoredForest) and sum(len(t.roots) for t in forests._stored_trees(model.path)) == 30
    models.save_model(model, str(tmp_path / "kept"), ["b", "a"], spark, kind="forest")
    again, metadata = models.load_model(str(tmp_path / "kept"), spark)
    assert metadata == {"features": ["b", "a"], "kind": "forest"} and again.path != model.path

    def given(m):
        return {r["n"]: (r["class"], tuple(r["probs"])) for r in models.score_windows(late, m).collect()}

    assert given(model) == given(again) and len(given(again)) == 3000


def test_importances_are_those_of_spark_for_a_planted_feature(spark):
    rng = random.Random(1)
    rows = [(0, n % 2, n % 2 + rng.uniform(0, 0.9), rng.random()) for n in range(400)]
    table = spark.createDataFrame(rows, "fold int, label_id int, a double, b double")
    pipeline = models.scaled_pipeline(["a", "b"], models.top20_forest(25, 4))
    ours, spark_s = (models.top_features(m, ["a", "b"], spark).collect() for m in (models.fit_forest(table, pipeline), pipeline.fit(table)))
    assert [r["feature"] for r in ours] == [r["feature"] for r in spark_s] == ["a", "b"]
    assert sum(r["importance"] for r in ours) == pytest.approx(1)
    assert ours[0]["importance"] == pytest.approx(spark_s[0]["importance"], abs=0.05)


@pytest.mark.parametrize("column, value", [("a", None), ("b", float("nan")), ("label_id", None)])
def test_missing_values_are_an_error(late, column, value):
    odd = late.withColumn(column, F.when(F.col("n") == 7, F.lit(value)).otherwise(F.col(column)))
    with pytest.raises(Exception, match="null"):
        models.fit_forest(odd, models.scaled_pipeline(["a", "b"], models.top20_forest(2, 2)))


def test_larger_tables_are_for_spark(monkeypatch, late):
    monkeypatch.setattr(forests, "TABLE_CELLS", 2 * 3000 - 1)
    model = models.fit_forest(late, models.scaled_pipeline(["a", "b"], models.top20_forest(2, 2)))
    assert model.stages[-1].getNumTrees == 2


@pytest.mark.parametrize("classes", [2, 3, 9])
def test_small_and_large_nodes_are_split_by_the_same_rule(monkeypatch, classes):
    """Pairs of entries, histograms and a plain search find the same first best split."""
    rng = np.random.default_rng(classes)
    binned = rng.integers(0, 6, (300, 5)).astype(np.uint8)
    labels, count = rng.integers(0, classes, 300), np.array([2, 3, 4, 5, 8, 9, 16, 17, 24, 25, 60])
    node, row = np.repeat(np.arange(len(count)), count), rng.integers(0, 300, count.sum())
    weight = rng.integers(1, 4, len(row)).astype(float)
    asked = np.array([rng.permutation(5)[:3] for _ in count])
    given = binned, labels, classes, row, node, weight, asked, 2
    found = forests._best_splits(*given)
    monkeypatch.setattr(forests, "NEAR_PAIRS", -1)
    by_histogram = forests._best_splits(*given)
    there = found[0] >= 0
    assert np.array_equal(found[0], by_histogram[0]) and there.sum() > 6
    assert all(np.array_equal(a[there], b[there]) for a, b in zip(found[1:], by_histogram[1:]))
    for n in range(len(count)):
        mine, best = node == n, (-1.0, 0, 0)
        for place, feature in enumerate(asked[n]):
            for b in range(forests.BINS):
                low = binned[row[mine], feature] <= b
                sides = [np.bincount(labels[row[mine]][s], weight[mine][s], classes) for s in (low, ~low)]
                if min(x.sum() for x in sides) >= 2:
                    score = sum((x * x).sum() / x.sum() for x in sides)
                    best = max(best, (score, -place, -b))
        assert found[0][n] == pytest.approx(best[0])
        if best[0] >= 0:
            assert (found[1][n], found[2][n]) == (-best[1], -best[2])


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
def test_the_served_model_is_fitted_on_all_windows(monkeypatch, spark):
    def never(*args, **kwargs):
        raise AssertionError("rows were chosen")

    small = models.top20_forest(6, 3)
    monkeypatch.setattr(models, "training_rows", never)
    monkeypatch.setattr(models, "top20_forest", lambda *a: small)
    monkeypatch.setattr(catalog_models.fx, "_STORED", {})
    ranked = catalog_models.top_features(spark, SMALL).collect()
    assert len(ranked) == 20 and sum(r["importance"] for r in ranked) == pytest.approx(1)
