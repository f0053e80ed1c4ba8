"""Training, searching and applying models with Spark ML.

Tables have ``file``, a numeric ``label_id`` and feature columns; group folds come from ``splits``.
"""

from __future__ import annotations

import json
import math
import random
import time
import uuid
from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool
from typing import TYPE_CHECKING, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
    NaiveBayes, OneVsRest, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from tremorgrid.functions.expressions import predicted_class, top_class
from tremorgrid.operators import metrics
from tremorgrid.operators.features import TOP20
from tremorgrid.session import cut, own_dir

if TYPE_CHECKING:
    from tremorgrid.operators import boosting

#: Labelled rows that boosted trees are fitted on, partitions they are gathered in, and memory for the statistics of a forest's level.
BOOSTING_ROWS = 4_000
FIT_PARTITIONS = 4
LEVEL_MB = 1024
#: Values (rows times columns) of a table for each file that it is written in to be fitted on.
FIT_VALUES = 1 << 20
#: Rounds after which k-means stops unsettled, and the movement of all centres at which it has settled.
CLUSTER_ROUNDS, SETTLED = 100_000, 1e-9


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores with the population deviation; a constant column becomes 0."""
    stats = df.agg(*[F.avg(c).alias(f"m{n}") for n, c in enumerate(columns)],
                   *[F.stddev_pop(c).alias(f"s{n}") for n, c in enumerate(columns)]).first()
    scaled = {}
    for n, c in enumerate(columns):
        mean, spread = stats[f"m{n}"], stats[f"s{n}"]
        if mean is not None:
            scaled[c] = (F.col(c) - F.lit(mean)) / F.lit(spread if spread else 1.0)
    return df.withColumns(scaled)


def assemble(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name, handleInvalid="error").transform(df)


def pca_embed(df: DataFrame, columns: list[str], components: int = 2) -> DataFrame:
    """Principal components of the scaled features, as columns ``pc1``, ``pc2``, …"""
    ready = assemble(standard_scale(df, columns), columns, "_scaled")
    model = PCA(k=components, inputCol="_scaled", outputCol="_pc").fit(ready)
    parts = vector_to_array(F.col("_pc"))
    return model.transform(ready).select(
        *[c for c in df.columns if c not in columns], *[parts[n].alias(f"pc{n + 1}") for n in range(components)])


def kmeans_cluster(df: DataFrame, columns: list[str], k: int = 3, seed: int = 42) -> DataFrame:
    """Cluster the (already scaled) features; adds ``features`` and ``cluster``.

    Rounds go on until no row changes its cluster, however many that takes: a row that moves shifts a centre by far
    more than ``SETTLED``, and sums in another order by far less.
    """
    ready = assemble(df, columns)
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster", maxIter=CLUSTER_ROUNDS,
                  tol=SETTLED).fit(ready).transform(ready)


def explore_unsupervised(df: DataFrame, columns: list[str], label: str = "label", k: int = 3, seed: int = 42) -> DataFrame:
    """Clusters against labels: Rand index, mutual information, squared-Euclidean silhouette."""
    clustered = kmeans_cluster(standard_scale(df, columns), columns, k, seed)
    clustered = cut(clustered.select(label, "cluster", "features"))
    score = metrics.silhouette(clustered, "features", "cluster")
    ari = metrics.adjusted_rand_index(clustered, label, "cluster").withColumn("_k", F.lit(1))
    nmi = metrics.normalized_mutual_info(clustered, label, "cluster").withColumn("_k", F.lit(1))
    return ari.join(nmi, "_k").drop("_k").withColumn("silhouette_squared_euclidean", F.lit(score))


def gradient_boosting(classes: int, **params) -> Estimator:
    """Boosted trees: binary directly, more classes one against the rest."""
    booster = GBTClassifier(featuresCol="scaled", labelCol="label_id", seed=42, **params)
    if classes == 2:
        return booster
    return OneVsRest(classifier=booster, featuresCol="scaled", labelCol="label_id", parallelism=4)


def scaled_pipeline(columns: list[str], classifier: Estimator) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error"),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        classifier,
    ])


def training_rows(df: DataFrame, columns: list[str], fit_rows: int | None, seed: int = 42) -> DataFrame:
    """``fit_rows`` rows of ``df`` to fit a model on, all of them where there are no more or without a bound.

    The rows with the smallest hashes of the feature columns are taken, so a rerun fits on the same rows and repeated
    rows cannot break the bound. They lie in few partitions: an iterative fit over a bounded table costs its rounds
    of tasks, not its rows.
    """
    if fit_rows is None:
        return df
    return df.orderBy(F.xxhash64(*columns, F.lit(seed))).limit(fit_rows).repartition(FIT_PARTITIONS)


def cut_for_fits(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` written in as few files as its size asks for.

    An iteration of a fit is a job with a task for each file, and with many files a second stage that adds up their
    sums; on a small table that is all its time.
    """
    df = cut(df)
    return cut(df.repartition(math.ceil(max(df.count(), 1) * len(columns) / FIT_VALUES)))


def cross_val_predict(
    df: DataFrame, estimator: Estimator, folds: int, keep: list[str], fold: str = "fold", parallelism: int = 4,
    stored: bool = False, fit_fold: Callable[[DataFrame, int], Model] | None = None,
) -> DataFrame:
    """Out-of-fold prediction of every row: ``keep``, fold, ``y_true``, ``y_pred`` and ``probs`` if known.

    One fit per fold on the stored table, up to ``parallelism`` at a time as in ``CrossValidator``;
    predictions are unioned, never gathered. A table that the caller has ``stored`` is not written again.
    ``fit_fold`` fits in place of ``estimator``; it gets the training rows and the fold that they leave out.
    A forest on a table whose bins a task can hold is fitted by ``forests``, bundles of trees side by side, each of
    which votes on the rows left out where it is fitted.
    """
    table = df if stored else cut(df)
    truth = [F.col("label_id").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred")]
    scored = None if fit_fold else predicted_by_forests(table, estimator, folds, fold)
    if scored is not None:
        return scored.select(*keep, fold, *truth, "probs")

    def fit(held):
        chosen = table.where(F.col(fold) != held).persist()
        try:
            return fit_fold(chosen, held) if fit_fold else estimator.fit(chosen)
        finally:
            chosen.unpersist()

    with ThreadPool(min(parallelism, folds)) as pool:
        fitted = pool.map(inheritable_thread_target(fit), range(folds))
    out = None
    for held, model in enumerate(fitted):
        part = predicted(model, table.where(F.col(fold) == held)).select(*keep, fold, *truth, "probs")
        out = part if out is None else out.unionByName(part)
    return out


def forest_plan(estimator: Estimator):
    """Columns and plan of a forest made by ``scaled_pipeline``; None for any other estimator."""
    from tremorgrid.operators import forests

    stages = estimator.getStages() if isinstance(estimator, Pipeline) else []
    plan = forests.plan_of(stages[-1]) if len(stages) == 3 and isinstance(stages[0], VectorAssembler) else None
    return (list(stages[0].getInputCols()), plan) if isinstance(plan, forests.ForestPlan) else None


def predicted_by_forests(table: DataFrame, estimator: Estimator, folds: int, fold: str = "fold") -> DataFrame | None:
    """The rows of all folds predicted by forests of the others, if ``estimator`` is a forest and the table small enough."""
    from tremorgrid.operators import forests

    asked = forest_plan(estimator)
    parts = asked and forests.by_columns(table, asked[0], list(range(folds)), fold)
    return forests.predicted_by_others(parts, len(asked[0]), asked[1], folds) if parts else None


def boosted_baseline(
    df: DataFrame, columns: list[str], classes: int, folds: int = 5, trees: int = 300, depth: int = 5,
    rate: float = 0.05, subsample: float = 0.8, keep: list[str] | None = None, fit_rows: int = BOOSTING_ROWS,
    patience: int | None = 20,
) -> DataFrame:
    """Out-of-fold predictions of boosted trees; ``df`` carries stratified folds in ``fold``.

    Each fit sees at most ``fit_rows`` rows and ends ``patience`` rounds after its least validation loss, or after
    ``trees`` rounds. Trees ask only for the order of values, so features need no scaling.
    """
    from tremorgrid.operators.boosting import boosted_cross_val

    return boosted_cross_val(df, columns, classes, folds, keep, fit_rows, rounds=trees, depth=depth, rate=rate,
                             subsample=subsample, patience=patience)


def top20_forest(trees: int = 389, depth: int = 30, seed: int = 42) -> RandomForestClassifier:
    """A deep forest. Each row's node is kept between levels, so a level ships its splits and not the trees, and there
    is memory for the statistics of many nodes at once. A leaf minimum of 2 stands for a split minimum of 5 rows,
    which Spark's forest does not have: nodes of fewer than 4 rows are not split."""
    return RandomForestClassifier(
        featuresCol="scaled", labelCol="label_id", numTrees=trees, maxDepth=depth, featureSubsetStrategy="log2",
        minInstancesPerNode=2, cacheNodeIds=True, maxMemoryInMB=LEVEL_MB, seed=seed)


def train_top20_forest(
    df: DataFrame, folds: int = 5, trees: int = 389, depth: int = 30, keep: list[str] | None = None, columns=TOP20,
) -> tuple[PipelineModel | StoredForest, DataFrame]:
    """The serving forest, fitted on all rows, and its out-of-fold predictions by group fold."""
    pipeline, table = scaled_pipeline(list(columns), top20_forest(trees, depth)), cut(df)
    predictions = cross_val_predict(table, pipeline, folds, keep or [], stored=True)
    return fit_forest(table, pipeline), predictions


def fit_forest(df: DataFrame, pipeline: Pipeline) -> PipelineModel | StoredForest:
    """A pipeline of ``scaled_pipeline`` with a forest, fitted on all rows: by ``forests`` if a task can hold the table's bins.

    Trees ask only for the order of values, so the stored forest has no use for the scaler.
    """
    from tremorgrid.operators import forests

    asked = forest_plan(pipeline)
    parts = asked and forests.by_columns(df, asked[0], [-1])
    if parts:
        return forests.stored_forest(parts, *asked)
    chosen = df.persist()
    try:
        return pipeline.fit(chosen)
    finally:
        chosen.unpersist()


def top_features(model: PipelineModel | StoredForest, names: Iterable[str], spark: SparkSession, keep: int = 20) -> DataFrame:
    """Features ranked by forest importance; the table has one row per model input."""
    importances = model.importances if isinstance(model, StoredForest) else model.stages[-1].featureImportances.toArray()
    rows = [(name, float(value), n) for n, (name, value) in enumerate(zip(names, importances))]
    return spark.createDataFrame(rows, "feature string, importance double, _n int").orderBy(
        F.desc("importance"), "_n").limit(keep).drop("_n")


class Forest(NamedTuple):
    """A fitted forest as plain numbers: its input columns with means and scales, the first node of each tree, and per
    node its feature (-1 for a leaf), threshold, children, and the share of each class among a leaf's rows."""

    inputs: list[str]
    mean: np.ndarray
    scale: np.ndarray
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    shares: np.ndarray


class StoredForest(NamedTuple):
    """A fitted forest whose trees lie in a folder that all executors share: its input columns, the greatest value of each
    bin but the last by column, and the importance of each column, as Spark's forest reckons it."""

    path: str
    inputs: list[str]
    edges: np.ndarray
    importances: np.ndarray


def forest_of(model: Model, spark: SparkSession) -> Forest | None:
    """The numbers of a pipeline fitted by ``scaled_pipeline`` with a forest; None for any other model.

    They are read from the files that Spark saves the model in: one row per node, of a model that the driver holds.
    """
    stages = getattr(model, "stages", [])
    kinds = (VectorAssembler, StandardScalerModel, RandomForestClassificationModel)
    if len(stages) != 3 or not all(map(isinstance, stages, kinds)):
        return None
    assembler, scaler, trees = stages
    if (assembler.getHandleInvalid(), scaler.getWithMean(), scaler.getWithStd(), trees.isSet("thresholds")) != ("error", True, True, False):
        return None
    path = f"{own_dir(spark)}/forest-{uuid.uuid4().hex}"
    trees.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select(
        "treeID", "id", "leftChild", "rightChild", "impurityStats", "split.featureIndex", "split.numCategories",
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")).toPandas()
    nodes = nodes.sort_values(["treeID", "id"], ignore_index=True)
    inner = (nodes["leftChild"] >= 0).to_numpy()
    if (nodes["numCategories"].to_numpy()[inner] != -1).any():
        return None
    number, tree = nodes["id"].to_numpy(), nodes["treeID"].to_numpy()
    roots = np.flatnonzero(np.diff(tree, prepend=-1))
    first = roots[np.searchsorted(tree[roots], tree)]  # nodes of a tree are numbered from 0 without gaps
    if not (number == np.arange(len(nodes)) - first).all():
        return None
    stats = np.stack(nodes["impurityStats"].to_numpy()).astype(float)
    sums = np.zeros(len(stats))
    for column in stats.T:
        sums += column
    deviation = scaler.std.toArray()
    return Forest(
        list(assembler.getInputCols()), scaler.mean.toArray(),
        np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation != 0), roots,
        np.where(inner, nodes["featureIndex"], -1).astype(np.int64), np.where(inner, nodes["threshold"], 0.0),
        np.where(inner, first + nodes["leftChild"], -1), np.where(inner, first + nodes["rightChild"], -1),
        np.divide(stats, sums[:, None], out=np.zeros_like(stats), where=sums[:, None] != 0))


def forest_votes(forest: Forest, values: np.ndarray) -> np.ndarray:
    """Sums of the class shares of the leaves that each row (a row of ``values``) reaches, tree after tree."""
    scaled = (values - forest.mean) * forest.scale
    cells, width = scaled.ravel(), scaled.shape[1]
    votes = np.zeros((len(values), forest.shares.shape[1]))
    leaf = np.empty(len(values), dtype=np.int64)
    for root in forest.roots.tolist():
        rows, node = np.arange(len(values)), np.full(len(values), root)
        while len(rows):
            feature = forest.feature[node]
            ended = feature < 0
            if ended.any():
                leaf[rows[ended]] = node[ended]
                going = ~ended
                rows, node, feature = rows[going], node[going], feature[going]
            low = cells[rows * width + feature] <= forest.threshold[node]
            node = np.where(low, forest.left[node], forest.right[node])
        votes += forest.shares[leaf]
    return votes


class BoostedTrees(NamedTuple):
    """Boosted trees as plain numbers, with their input columns."""

    inputs: list[str]
    trees: boosting.Boosted


def boosted_votes(model: BoostedTrees, values: np.ndarray) -> np.ndarray:
    from tremorgrid.operators import boosting

    return boosting.probabilities(boosting.margins(model.trees, values))


def stored_votes(forest: StoredForest, values: np.ndarray) -> np.ndarray:
    from tremorgrid.operators import forests

    return forests.stored_votes(forest, values)


def predicted(model: Model | Forest | StoredForest | BoostedTrees, df: DataFrame) -> DataFrame:
    """``df``, batch or streaming, with the model's ``prediction`` and ``probs`` (null if it has none).

    A forest is applied by its numbers, a batch of rows at a time through one tree after the other, with the same sums
    in the same order as Spark's forest, which walks all trees for each row and is some ten times slower.
    """
    known = {Forest: forest_votes, StoredForest: stored_votes, BoostedTrees: boosted_votes}
    forest = model if type(model) in known else forest_of(model, df.sparkSession)
    if forest is None:
        scored = model.transform(df)
        return scored.withColumn(
            "probs", vector_to_array("probability") if "probability" in scored.columns else F.lit(None).cast("array<double>"))

    ballot = known[type(forest)]

    @F.arrow_udf("prediction double, probs array<double>")
    def run(*columns: pa.Array) -> pa.Array:
        values = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns])
        if np.isnan(values).any():
            raise ValueError("null or NaN among the features of a row")
        votes = ballot(forest, values)
        sums = np.zeros(len(votes))
        for column in votes.T:
            sums += column
        votes /= sums[:, None]
        ends = np.arange(len(votes) + 1, dtype=np.int32) * votes.shape[1]
        best = votes.argmax(axis=1) if len(votes) else np.zeros(0)
        return pa.StructArray.from_arrays(
            [pa.array(best.astype(float)), pa.ListArray.from_arrays(pa.array(ends), pa.array(votes.ravel()))],
            names=["prediction", "probs"])

    scored = df.withColumn("_model", run(*[F.col(f"`{c}`") for c in forest.inputs]))
    return scored.select(*[F.col(f"`{c}`") for c in df.columns], "_model.prediction", "_model.probs")


# Search ranges of each model family.
SEARCH_SPACES: dict[str, dict[str, list]] = {
    "gbc": {
        "maxIter": [50 + 25 * n for n in range(15)],
        "stepSize": [round(0.01 * n, 2) for n in range(1, 21)],
        "maxDepth": [2, 3, 4, 5, 6],
        "minInstancesPerNode": [1, 2, 3, 4],
        "subsamplingRate": [round(0.6 + 0.05 * n, 2) for n in range(9)],
    },
    "rf": {
        "numTrees": [100 + 26 * n for n in range(20)],
        "maxDepth": [10, 20, 30],
        "minInstancesPerNode": [1, 2, 3, 4],
        "featureSubsetStrategy": ["sqrt", "log2", "0.5", "0.7", "0.9"],
    },
}


def sample_params(space: dict[str, list], count: int, seed: int) -> list[dict]:
    """Distinct random draws from a grid, the same for the same seed."""
    rng, seen, out = random.Random(seed), set(), []
    size = 1
    for values in space.values():
        size *= len(values)
    while len(out) < min(count, size):
        draw = {name: rng.choice(values) for name, values in space.items()}
        key = tuple(sorted(draw.items()))
        if key not in seen:
            seen.add(key)
            out.append(draw)
    return out


def random_search_cv(
    df: DataFrame,
    columns: list[str],
    build: Callable[..., Estimator],
    draws: list[dict],
    folds: int,
    parallelism: int = 4,
) -> tuple[PipelineModel | StoredForest | BoostedTrees, dict, DataFrame]:
    """Try parameter draws over the group folds of ``fold``; refit the best by mean accuracy.

    Forests and boosted trees on a table that a task can hold are fitted by ``forests``, every draw and fold in a task
    of its own, on all rows. Otherwise each draw is one stage list for Spark's ``CrossValidator``, which keeps the table
    cached for the run and fits up to ``parallelism`` models at a time. ``predicted`` applies the model of either.
    """
    from tremorgrid.operators import forests

    table = cut(df.withColumn("fold", F.col("fold").cast("int")))
    plans = [forests.plan_of(build(**draw)) for draw in draws]
    rows = forests.gathered(table, columns) if plans and None not in plans else None
    if rows is not None:
        scores = [sum(found) / folds for found in forests.accuracies(table, rows, plans, folds)]
        best = max(range(len(draws)), key=lambda n: (scores[n], -n))
        return forests.fit_all(table, rows, columns, plans[best]), draws[best], trials_table(df.sparkSession, draws, scores)
    pipeline = Pipeline(stages=[])
    stages = [{pipeline.stages: scaled_pipeline(columns, build(**draw)).getStages()} for draw in draws]
    search = CrossValidator(
        estimator=pipeline, estimatorParamMaps=stages, numFolds=folds, foldCol="fold", parallelism=parallelism,
        evaluator=MulticlassClassificationEvaluator(labelCol="label_id", metricName="accuracy"))
    fitted = search.fit(table)
    scores = [float(score) for score in fitted.avgMetrics]
    best = max(range(len(draws)), key=lambda n: (scores[n], -n))
    return fitted.bestModel, draws[best], trials_table(df.sparkSession, draws, scores)


def trials_table(spark: SparkSession, draws: list[dict], scores: list[float]) -> DataFrame:
    return spark.createDataFrame(
        [(n, json.dumps(draw), scores[n]) for n, draw in enumerate(draws)],
        "model_order int, params string, best_score double")


def classifier_kinds(classes: int, inputs: int) -> dict[str, Estimator]:
    """The model kinds that are compared, by display name."""
    common = {"featuresCol": "scaled", "labelCol": "label_id"}
    return {
        "Gradient Boosting Classifier": gradient_boosting(classes, maxIter=20, maxDepth=3, stepSize=0.1),
        "Random Forest Classifier": RandomForestClassifier(numTrees=100, maxDepth=10, seed=42, **common),
        "Decision Tree Classifier": DecisionTreeClassifier(maxDepth=10, seed=42, **common),
        "Logistic Regression": LogisticRegression(maxIter=100, **common),
        "Naive Bayes": NaiveBayes(modelType="gaussian", **common),
        "SVM - Linear Kernel": OneVsRest(classifier=LinearSVC(maxIter=50, **common), parallelism=4, **common),
        "MLP Classifier": MultilayerPerceptronClassifier(layers=[inputs, 32, classes], maxIter=60, seed=42, **common),
        "Dummy Classifier": LogisticRegression(maxIter=0, elasticNetParam=1.0, regParam=1e6, **common),
    }


def compare_classifiers(df: DataFrame, columns: list[str], classes: int, folds: int, kinds: dict[str, Estimator] | None = None) -> DataFrame:
    """Leaderboard of the model kinds by out-of-fold predictions, with fitting time."""
    kinds = kinds or classifier_kinds(classes, len(columns))
    everything, times, table = None, [], cut_for_fits(df, columns)  # one table for all kinds
    for name, classifier in kinds.items():
        begun = time.perf_counter()
        scored = cross_val_predict(table, scaled_pipeline(columns, classifier), folds, [], stored=True, parallelism=folds)
        part = cut(scored.withColumn("model", F.lit(name)))
        times.append((name, round(time.perf_counter() - begun, 3)))
        everything = part if everything is None else everything.unionByName(part)
    board = metrics.cv_leaderboard(everything, classes, "probs")
    seconds = df.sparkSession.createDataFrame(times, "model string, seconds double")
    return board.join(F.broadcast(seconds), "model").orderBy(F.desc("accuracy"), "model")


def yeo_johnson(x, lam: float):
    """The power transform of one column for a fixed exponent."""
    up = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def fit_power_exponents(df: DataFrame, columns: list[str], grid: list[float]) -> dict[str, float]:
    """Exponent with the highest likelihood for each column; one pass, counts combined on the map side."""
    long = df.select(F.expr("stack({}, {}) as (feature, x)".format(
        len(columns), ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns))))
    x = F.col("x")
    shift = F.sum(F.signum(x) * F.log1p(F.abs(x)))
    n = F.count("x")
    likelihoods = [
        (-n / 2 * F.log(F.var_pop(yeo_johnson(x, lam))) + (lam - 1) * shift).alias(f"l{k}")
        for k, lam in enumerate(grid)
    ]
    best = {}
    for row in long.groupBy("feature").agg(*likelihoods).collect():  # one row per feature column
        values = [row[f"l{k}"] for k in range(len(grid))]
        usable = [k for k, v in enumerate(values) if v is not None and v == v]
        best[row["feature"]] = grid[max(usable, key=lambda k: (values[k], -k))] if usable else 1.0
    return best


def power_transform(df: DataFrame, columns: list[str], grid: list[float] | None = None) -> DataFrame:
    """Yeo-Johnson transform of each column with its own exponent, then z-scores."""
    exponents = fit_power_exponents(df, columns, grid or [n / 4 for n in range(-12, 21)])
    shaped = df.withColumns({c: yeo_johnson(F.col(c), exponents[c]) for c in columns})
    return standard_scale(shaped, columns)


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    return Imputer(strategy="mean", inputCols=list(columns), outputCols=list(columns)).fit(df).transform(df)


def flatten_windows(df: DataFrame, kind: str, channels: list[str] | None = None, spectrogram: str = "spectrogram") -> DataFrame:
    """Network input in ``features``: window samples ("time"), spectrogram ("spec") or both ("hybrid")."""
    samples = F.concat(*[F.col(f"`{c}`") for c in channels]) if channels else None
    cells = F.flatten(spectrogram)
    parts = {"time": lambda: samples, "spec": lambda: cells, "hybrid": lambda: F.concat(samples, cells)}
    return df.withColumn("features", array_to_vector(parts[kind]().cast("array<double>")))


def neural_network(inputs: int, hidden: list[int], classes: int, seed: int = 42, **params) -> Pipeline:
    return Pipeline(stages=[
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        MultilayerPerceptronClassifier(
            layers=[inputs, *hidden, classes], featuresCol="scaled", labelCol="label_id", seed=seed,
            **{"maxIter": 60, "tol": 1e-5, **params}),
    ])


class Network(NamedTuple):
    """A fitted network as plain numbers: input means and deviations, and per layer a weight matrix with bias row."""

    mean: list[float]
    deviation: list[float]
    layers: list[list[list[float]]]


def network_of(model: PipelineModel) -> Network:
    """The numbers of a pipeline fitted by ``neural_network``: a scaler and a perceptron."""
    scaler, perceptron = model.stages[-2:]
    flat, sizes, at, layers = perceptron.weights.toArray(), perceptron.getOrDefault("layers"), 0, []
    for size, out in zip(sizes, sizes[1:]):
        weights = flat[at:at + size * out].reshape(out, size, order="F").T  # Spark stores them column by column
        at += size * out
        layers.append([*weights.tolist(), flat[at:at + out].tolist()])
        at += out
    return Network(scaler.mean.toArray().tolist(), scaler.std.toArray().tolist(), layers)


def network_probabilities(network: Network) -> Callable[[Column], Column]:
    """Class probabilities of an input array; null where the network cannot take it.

    Sigmoid hidden layers and a softmax at the end, as Spark's perceptron has them. The numbers of the network travel
    with the function, so a model can be applied to a stream without a transformer's column names in its way.
    """
    mean, deviation = np.array(network.mean), np.array(network.deviation)
    scale = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
    layers = [np.array(layer) for layer in network.layers]
    size, classes = len(mean), layers[-1].shape[1]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(column: pa.Array) -> pa.Array:
        lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(lengths == size)
        taken = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        values = taken.astype(np.float64).reshape(len(rows), size)
        usable = np.isfinite(values).all(axis=1)
        rows, values = rows[usable], (values[usable] - mean) * scale
        for n, layer in enumerate(layers):
            values = values @ layer[:-1] + layer[-1]
            if n < len(layers) - 1:
                values = 1.0 / (1.0 + np.exp(-values))
        values = np.exp(values - values.max(axis=1, keepdims=True)) if len(values) else values
        values = values / values.sum(axis=1, keepdims=True)
        there = np.zeros(len(column), dtype=bool)
        there[rows] = True
        ends = np.concatenate([[0], np.cumsum(there * classes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()), mask=pa.array(~there))

    return run


def fit_with_patience(
    train: DataFrame, valid: DataFrame, hidden: list[int], classes: int, max_iter: int = 60, step: int = 10,
    patience: int = 2, seed: int = 42, **params,
) -> tuple[PipelineModel, list[float]]:
    """A network fitted in short runs of ``step`` iterations, each continued from the weights of the one before it.

    After each run the log loss on ``valid`` (rows of other groups) is taken; after ``patience`` runs without a better
    one, or ``max_iter`` iterations, the weights with the least loss are returned, and the losses of all runs.
    """
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(train)
    ready, held = scaler.transform(train).persist(), scaler.transform(valid).persist()
    measure = MulticlassClassificationEvaluator(labelCol="label_id", probabilityCol="probability", metricName="logLoss")
    layers, weights, best, losses = [vector_size(train), *hidden, classes], None, None, []
    try:
        for done in range(0, max_iter, step):
            network = MultilayerPerceptronClassifier(
                layers=layers, featuresCol="scaled", labelCol="label_id", seed=seed,
                **{"maxIter": min(step, max_iter - done), "tol": 1e-5, **params})
            if weights is not None:
                network.setInitialWeights(weights)
            fitted = network.fit(ready)
            weights = fitted.weights
            losses.append(float(measure.evaluate(fitted.transform(held))))
            if best is None or losses[-1] < min(losses[:-1]):
                best = fitted
            if len(losses) - 1 - losses.index(min(losses)) >= patience:
                break
    finally:
        ready.unpersist()
        held.unpersist()
    return PipelineModel(stages=[scaler, best]), losses


def vector_size(df: DataFrame, column: str = "features") -> int:
    return df.select(F.size(vector_to_array(column))).first()[0]


def neural_cv(
    df: DataFrame, kind: str, classes: int, folds: int, hidden: list[int], channels=None, keep=None,
    max_iter: int = 60, patience: int | None = 2, **params,
) -> DataFrame:
    """Out-of-fold predictions of a network on one kind of input, with group folds in ``fold``.

    With ``patience``, the fold after the one left out is held back from the fit and ends it early
    (``fit_with_patience``), so the predicted rows decide nothing.
    """
    ready = cut(flatten_windows(df, kind, channels))
    network = neural_network(vector_size(ready), hidden, classes, maxIter=max_iter, **params)

    def early(train: DataFrame, held: int) -> Model:
        judge = F.col("fold") == (held + 1) % folds
        return fit_with_patience(train.where(~judge), train.where(judge), hidden, classes, max_iter, patience=patience, **params)[0]

    scored = cross_val_predict(ready, network, folds, keep or [], stored=True, fit_fold=early if patience else None)
    return scored.withColumn("model", F.lit(f"neural_{kind}"))


# Search ranges of the network.
NETWORK_SPACE = {"first": [32, 48, 64, 96], "second": [0, 16, 32, 64], "stepSize": [0.01, 0.03, 0.1]}


def tune_neural(
    df: DataFrame, kind: str, classes: int, folds: int, trials: int, channels=None, seed: int = 42, max_iter: int = 60,
) -> tuple[PipelineModel, dict, DataFrame]:
    """Random search of layer sizes by mean accuracy over group folds; the best is fitted on non-holdout rows.

    ``df`` has ``fold`` and, for the final model, ``holdout``. An iteration of a fit is a job of its own with a task for
    each of the table's few partitions, so as many fits run at a time as tasks can.
    """
    ready = cut(flatten_windows(df, kind, channels))
    inputs = vector_size(ready)

    def trial(asked: tuple[int, dict]) -> tuple[int, str, float]:
        number, draw = asked
        hidden = [width for width in (draw["first"], draw["second"]) if width]
        network = neural_network(inputs, hidden, classes, stepSize=draw["stepSize"], maxIter=max_iter)
        scored = cross_val_predict(ready, network, folds, [], stored=True, parallelism=folds).withColumn("model", F.lit(kind))
        accuracy = metrics.fold_summary(metrics.fold_metrics(scored, None)).first()["accuracy"]
        return number, json.dumps(draw), float(accuracy)

    asked = list(enumerate(sample_params(NETWORK_SPACE, trials, seed)))
    at_once = math.ceil(2 * df.sparkSession.sparkContext.defaultParallelism / folds)
    with ThreadPool(max(1, min(at_once, len(asked)))) as pool:
        study = pool.map(inheritable_thread_target(trial), asked, chunksize=1)
    best = max(study, key=lambda row: (row[2], -row[0]))
    draw = json.loads(best[1])
    hidden = [width for width in (draw["first"], draw["second"]) if width]
    final = neural_network(inputs, hidden, classes, stepSize=draw["stepSize"], maxIter=max_iter)
    fitted = final.fit(ready.where(~F.col("holdout")))
    trials_table = df.sparkSession.createDataFrame(study, "model_order int, params string, best_score double")
    return fitted, draw, trials_table


def score_windows(df: DataFrame, model: Model, stated: bool = False) -> DataFrame:
    """Apply a fitted model to windows, batch or streaming: adds class, confidence, label and probs."""
    scored = predicted(model, df)
    chosen = predicted_class(F.col("prediction"), F.col("probs")) if stated else top_class(F.col("probs"))
    return scored.withColumn("_top", chosen).select(
        *df.columns, "_top.class", "_top.confidence", "_top.label", "probs")


def save_model(model: PipelineModel | StoredForest, path: str, features: Iterable[str], spark: SparkSession, **metadata) -> None:
    """Store a fitted pipeline, or the trees of a stored forest, its feature names and its metadata side by side."""
    base = path.rstrip("/")
    kept = {"features": list(features), **metadata}
    if isinstance(model, StoredForest):
        spark.read.parquet(model.path).write.mode("overwrite").parquet(f"{base}/model")
        kept["forest"] = {"inputs": model.inputs, "edges": model.edges.tolist(), "importances": model.importances.tolist()}
    else:
        model.write().overwrite().save(f"{base}/model")
    spark.createDataFrame([(json.dumps(kept, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/metadata")


def load_model(path: str, spark: SparkSession) -> tuple[PipelineModel | StoredForest, dict]:
    base = path.rstrip("/")
    kept = json.loads(spark.read.text(f"{base}/metadata").first()[0])
    trees = kept.pop("forest", None)
    if trees is None:
        return PipelineModel.load(f"{base}/model"), kept
    return StoredForest(f"{base}/model", trees["inputs"], np.array(trees["edges"]), np.array(trees["importances"])), kept
