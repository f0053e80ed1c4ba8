"""Boosted trees and networks that stop early."""

import numpy as np
import pytest

from tremorgrid.operators import boosting, models


def planted(rows=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, 6))
    return x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int) + (x[:, 3] > 0.8)


def test_planted_classes_are_learned():
    x, y = planted()
    model = boosting.fit_boosted(x, y, 3, rounds=80, rate=0.1)
    more, truth = planted(400, 1)
    accuracy = (boosting.margins(model, more).argmax(axis=1) == truth).mean()
    assert accuracy > np.bincount(truth).max() / len(truth) + 0.2
    p = boosting.probabilities(boosting.margins(model, more))
    assert np.allclose(p.sum(axis=1), 1) and len(model.leaf) <= 80


def test_a_single_split_is_the_best_one():
    x = np.array([[float(n), float(n % 3)] for n in range(40)])
    y = (x[:, 0] >= 17).astype(int)
    model = boosting.fit_boosted(x, y, 2, rounds=1, depth=1, rate=1.0, subsample=1.0, patience=None)
    left = _sides(model, x)
    assert (left == (y == 0)).all() or (left == (y == 1)).all() or abs(int(left.sum()) - 17) <= 1


def _sides(model, x):
    return x[:, model.feature[0, 0, 0]] <= model.threshold[0, 0, 0]


@pytest.mark.parametrize("drawn", [1.0, 0.7])
def test_histograms_of_a_few_features_at_a_time_give_the_same_trees(monkeypatch, drawn):
    x, y = planted(500)
    settings = dict(rounds=6, depth=4, subsample=drawn, patience=None)
    whole, seen, count = boosting.fit_boosted(x, y, 3, **settings), [], np.bincount
    monkeypatch.setattr(boosting, "STEP_PAIRS", 1100)
    monkeypatch.setattr(boosting.np, "bincount", lambda at, *a, **k: seen.append(len(at)) or count(at, *a, **k))
    few = boosting.fit_boosted(x, y, 3, **settings)
    assert max(seen) <= 1100 and all(np.array_equal(a, b) for a, b in zip(whole, few))


def test_noise_stops_early():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(300, 5)), rng.integers(0, 3, 300)
    model = boosting.fit_boosted(x, y, 3, rounds=200, patience=5)
    assert len(model.leaf) < 60


def test_constant_and_missing_classes():
    x, y = np.ones((20, 2)), np.zeros(20, dtype=int)
    model = boosting.fit_boosted(x, y, 3, rounds=3)
    assert (boosting.margins(model, x).argmax(axis=1) == 0).all()


def test_folds_on_the_cluster(spark):
    x, y = planted(240)
    rows = [(n, int(n % 4), int(y[n]), *map(float, x[n])) for n in range(len(x))]
    names = [f"f{n}" for n in range(6)]
    df = spark.createDataFrame(rows, "id int, fold int, label_id int, " + ", ".join(f"{n} double" for n in names))
    got = models.boosted_baseline(df, names, 3, folds=4, trees=40, rate=0.1, keep=["id"]).collect()
    assert sorted(r.id for r in got) == list(range(240)) and {r.fold for r in got} == set(range(4))
    accuracy = sum(r.y_true == r.y_pred for r in got) / len(got)
    assert accuracy > np.bincount(y).max() / len(y) + 0.1
    assert all(r.y_pred == int(np.argmax(r.probs)) for r in got)
    few = models.training_rows(df, names, 50).collect()
    assert len(few) == 50 and sorted(few) == sorted(models.training_rows(df.repartition(7), names, 50).collect())


@pytest.mark.parametrize("noise", [True, False])
def test_network_ends_at_its_best_weights(spark, noise):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 4))
    y = rng.integers(0, 2, 80) if noise else (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(int(n), [float(v) for v in x[n]], int(y[n])) for n in range(80)],
                               "id int, x array<double>, label_id int").withColumn("features", array_to_vector("x"))
    train, valid = df.where("id < 50"), df.where("id >= 50")
    model, losses = models.fit_with_patience(train, valid, [12], 2, max_iter=100, step=10, patience=2)
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    measure = MulticlassClassificationEvaluator(labelCol="label_id", probabilityCol="probability", metricName="logLoss")
    assert measure.evaluate(model.transform(valid)) == pytest.approx(min(losses), abs=1e-6)
    if noise:
        assert len(losses) < 10 and losses[-1] > min(losses)
    assert model.transform(df.withColumn("more", F.lit(1))).count() == 80
