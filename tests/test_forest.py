import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tremorgrid.operators import models


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(3)
    rows = [(n, n % 3, *[rng.gauss(n % 3 * 0.5, 1) for _ in range(4)], 7.0) for n in range(600)]
    table = spark.createDataFrame(rows, "n int, label_id int, a double, b double, c double, `d.e` double, f double")
    table = table.withColumnRenamed("d.e", "d")
    columns = ["a", "b", "c", "d", "f"]
    return models.scaled_pipeline(columns, models.top20_forest(25, 12)).fit(table.where("n % 4 > 0")), table


def test_a_forest_by_its_numbers_equals_the_pipeline(spark, fitted):
    model, table = fitted
    assert len(models.forest_of(model, spark).roots) == 25
    ours = models.predicted(model, table).select("n", F.col("prediction").alias("p"), F.col("probs").alias("q"))
    assert "ArrowEvalPython" in ours._jdf.queryExecution().executedPlan().toString()  # not Spark's walk row by row
    theirs = model.transform(table).select("n", "prediction", vector_to_array("probability").alias("probs"))
    both = ours.join(theirs, "n").collect()
    assert len(both) == 600 and all(r.p == r.prediction and r.q == r.probs for r in both)


@pytest.mark.parametrize("value", [None, float("nan")])
def test_missing_features_are_an_error(fitted, value):
    model, table = fitted
    odd = table.withColumn("b", F.when(F.col("n") == 5, F.lit(value)).otherwise(F.col("b")))
    with pytest.raises(Exception, match="null or NaN"):
        models.predicted(model, odd).collect()


def test_other_models_are_applied_by_spark(spark, fitted):
    _, table = fitted
    pipeline = models.scaled_pipeline(["a", "b"], models.classifier_kinds(3, 2)["Logistic Regression"])
    model = pipeline.fit(table)
    assert models.forest_of(model, spark) is None
    assert models.predicted(model, table).where("size(probs) = 3").count() == 600
