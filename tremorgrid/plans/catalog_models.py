"""Registered queries: metrics, splits and models."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from tremorgrid.operators import features, metrics, models, signals, splits
from tremorgrid.plans import catalog_signals
from tremorgrid.plans import fixtures as fx
from tremorgrid.plans.registry import query
from tremorgrid.session import cut

CLASSES = 3
#: Folds, draws of each family, trials and hidden layers of the model queries, as in the reference.
FOLDS, DRAWS, TRIALS = 5, 30, 15
HIDDEN = {"time": [64], "spec": [64], "hybrid": [128]}

# Metrics over prediction tables.


@query("agg5_confusion_matrix", f"""WITH {fx.SQL_EVAL}, n AS (SELECT y_true, y_pred, count(*) AS n FROM evals GROUP BY ALL),
cells AS (SELECT t::INT AS y_true, p::INT AS y_pred FROM range(3) a(t), range(3) b(p)),
full_cells AS (SELECT y_true, y_pred, coalesce(n, 0) AS n FROM cells LEFT JOIN n USING (y_true, y_pred))
SELECT *, round(n / sum(n) OVER (PARTITION BY y_true), 9) AS share FROM full_cells""")
def confusion_matrix(spark, sf_dir):
    out = metrics.confusion_matrix(fx.evaluations(spark, sf_dir), classes=CLASSES, normalize=True)
    return out.withColumn("share", F.round("share", 9))


SQL_CLASSES = f"""{fx.SQL_EVAL}, labels AS (SELECT unnest([0, 1, 2]) AS label),
counts AS (SELECT label, count(*) FILTER (y_true = label) AS support, count(*) FILTER (y_pred = label) AS predicted,
                  count(*) FILTER (y_true = label AND y_pred = label) AS hits FROM evals, labels GROUP BY label),
scores AS (SELECT *, hits / predicted AS precision, hits / support AS recall, 2 * hits / (predicted + support) AS f1 FROM counts)"""


@query("agg6_classification_report", f"""WITH {SQL_CLASSES}, report AS (
SELECT CAST(label AS VARCHAR) AS label, precision, recall, f1, support FROM scores
UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support)::BIGINT FROM scores
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM scores
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
          sum(f1 * support) / sum(support), sum(support)::BIGINT FROM scores)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM report""")
def classification_report(spark, sf_dir):
    out = metrics.classification_report(metrics.confusion_matrix(fx.evaluations(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


SQL_TABLE = fx.SQL_EVAL + """, cells AS (SELECT y_true AS u, model AS v, count(*)::DOUBLE AS n FROM evals GROUP BY ALL),
us AS (SELECT u, sum(n) AS nu FROM cells GROUP BY u), vs AS (SELECT v, sum(n) AS nv FROM cells GROUP BY v),
total AS (SELECT sum(n) AS t FROM cells)"""


@query("agg7_adjusted_rand_index", f"""WITH {SQL_TABLE},
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS b, (SELECT sum(nu * (nu - 1) / 2) FROM us) AS r,
             (SELECT sum(nv * (nv - 1) / 2) FROM vs) AS c, t * (t - 1) / 2 AS p FROM total)
SELECT round((b - r * c / p) / ((r + c) / 2 - r * c / p), 12) AS adjusted_rand_index FROM s""")
def adjusted_rand_index(spark, sf_dir):
    out = metrics.adjusted_rand_index(fx.evaluations(spark, sf_dir), "y_true", "model")
    return out.select(F.round("adjusted_rand_index", 12).alias("adjusted_rand_index"))


@query("agg8_normalized_mutual_info", f"""WITH {SQL_TABLE},
mi AS (SELECT sum(n / t * ln(n * t / (nu * nv))) AS mi FROM cells JOIN us USING (u) JOIN vs USING (v), total),
hu AS (SELECT -sum(nu / t * ln(nu / t)) AS hu FROM us, total), hv AS (SELECT -sum(nv / t * ln(nv / t)) AS hv FROM vs, total)
SELECT round(mi / ((hu + hv) / 2), 12) AS normalized_mutual_info FROM mi, hu, hv""")
def normalized_mutual_info(spark, sf_dir):
    out = metrics.normalized_mutual_info(fx.evaluations(spark, sf_dir), "y_true", "model")
    return out.select(F.round("normalized_mutual_info", 12).alias("normalized_mutual_info"))


SQL_FOLDS = fx.SQL_EVAL + """, folds AS (SELECT model, fold, avg((y_true = y_pred)::INT) AS accuracy,
  avg(-ln(greatest(least(probs[y_true + 1], 1 - 1e-7::DOUBLE), 1e-7::DOUBLE))) AS loss FROM evals GROUP BY ALL)"""


@query("agg10_fold_summary", f"""WITH {SQL_FOLDS}
SELECT model, count(*) AS folds, round(avg(accuracy), 9) AS accuracy, round(avg(loss), 9) AS loss FROM folds GROUP BY model""")
def fold_summary(spark, sf_dir):
    out = metrics.fold_summary(metrics.fold_metrics(fx.evaluations(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "loss")})


@query("agg11_true_class_prob_histogram", f"""WITH {fx.SQL_EVAL}, p AS (SELECT probs[y_true + 1] AS p FROM evals),
r AS (SELECT min(p) AS lo, max(p) AS hi FROM p),
binned AS (SELECT least(floor((p - lo) / (hi - lo) * 20)::INT + 1, 20) AS bin, count(*) AS n FROM p, r GROUP BY ALL),
every AS (SELECT b::INT AS bin FROM range(1, 21) q(b))
SELECT bin, round(lo + (bin - 1) * (hi - lo) / 20, 9) AS lower, coalesce(n, 0) AS n FROM every LEFT JOIN binned USING (bin), r""")
def true_class_histogram(spark, sf_dir):
    out = metrics.true_class_prob_histogram(fx.evaluations(spark, sf_dir))
    return out.withColumn("lower", F.round("lower", 9))


@query("agg12_cv_leaderboard", f"""WITH {fx.SQL_EVAL}, labels AS (SELECT unnest([0, 1, 2]) AS label),
c AS (SELECT model, label, count(*) FILTER (y_true = label)::DOUBLE AS t, count(*) FILTER (y_pred = label)::DOUBLE AS p,
             count(*) FILTER (y_true = label AND y_pred = label)::DOUBLE AS h FROM evals, labels GROUP BY ALL),
b AS (SELECT model, sum(t) AS s, sum(h) AS c, sum(t * p) AS tp, sum(p * p) AS pp, sum(t * t) AS tt,
             sum(h) / sum(t) AS recall, sum(t * h / p) / sum(t) AS precision, sum(t * 2 * h / (t + p)) / sum(t) AS f1 FROM c GROUP BY model),
scored AS (SELECT model, label, (y_true = label) AS pos, round(probs[label + 1], 12) AS score FROM evals, labels),
ranked AS (SELECT *, rank() OVER (PARTITION BY model, label ORDER BY score)
                     + (count(*) OVER (PARTITION BY model, label, score) - 1) / 2.0::DOUBLE AS r FROM scored),
areas AS (SELECT model, label, (sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2)
                 / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS auc, count(*) FILTER (pos) AS w FROM ranked GROUP BY ALL),
auc AS (SELECT model, sum(auc * w) / sum(w) AS auc FROM areas GROUP BY model)
SELECT model, round(c / s, 9) AS accuracy, round(recall, 9) AS recall, round(precision, 9) AS precision, round(f1, 9) AS f1,
       round((c / s - tp / (s * s)) / (1 - tp / (s * s)), 9) AS kappa,
       round((c * s - tp) / sqrt((s * s - pp) * (s * s - tt)), 9) AS mcc, round(auc, 9) AS auc FROM b JOIN auc USING (model)""")
def cv_leaderboard(spark, sf_dir):
    df = fx.evaluations(spark, sf_dir)
    rounded = df.withColumn("probs", F.transform("probs", lambda p: F.round(p, 12)))
    out = metrics.cv_leaderboard(rounded, CLASSES, "probs")
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "recall", "precision", "f1", "kappa", "mcc", "auc")})


@query("top4_leaderboard_sort", f"""WITH {SQL_FOLDS}, scores AS (SELECT model, round(avg(accuracy), 9) AS best_score FROM folds GROUP BY model)
SELECT model, best_score FROM scores ORDER BY best_score DESC, model LIMIT 1""")
def leaderboard_sort(spark, sf_dir):
    scores = metrics.fold_summary(metrics.fold_metrics(fx.evaluations(spark, sf_dir), None))
    return metrics.best_model(scores.select("model", F.round("accuracy", 9).alias("best_score")), order="model")


@query("top5_prediction_slice", f"WITH {fx.SQL_EVAL} SELECT seq, y_true, y_pred FROM evals ORDER BY seq LIMIT 100")
def prediction_slice(spark, sf_dir):
    return metrics.prediction_slice(fx.evaluations(spark, sf_dir), ["seq"])


# Splits.

@query("spl1_group_kfold", """WITH RECURSIVE sizes AS (SELECT user_id AS file, count(*) AS n FROM events GROUP BY user_id),
ordered AS (SELECT file, n, row_number() OVER (ORDER BY n DESC, file) AS r FROM sizes),
deal AS (
  SELECT 0::BIGINT AS r, [0, 0, 0, 0, 0]::BIGINT[] AS loads, [0, 0, 0, 0, 0]::BIGINT[] AS files
  UNION ALL
  SELECT o.r, list_transform(range(1, 6), lambda k: d.loads[k] + CASE WHEN k = list_position(d.loads, list_min(d.loads)) THEN o.n ELSE 0 END),
         list_transform(range(1, 6), lambda k: d.files[k] + CASE WHEN k = list_position(d.loads, list_min(d.loads)) THEN 1 ELSE 0 END)
  FROM deal d JOIN ordered o ON o.r = d.r + 1),
final AS (SELECT loads, files FROM deal ORDER BY r DESC LIMIT 1)
SELECT k::INT AS fold, loads[k + 1] AS windows, files[k + 1] AS files FROM final, range(5) q(k)""")
def group_kfold(spark, sf_dir):
    df = fx.events(spark, sf_dir).select(F.col("device_id").alias("file"), "seq")
    folded = splits.group_kfold(df, 5)
    return folded.groupBy("file", "fold").agg(F.count(F.lit(1)).alias("n")).groupBy("fold").agg(
        F.sum("n").alias("windows"), F.count(F.lit(1)).alias("files"))


@query("spl2_group_holdout", """WITH n AS (SELECT count(DISTINCT user_id) AS files FROM events)
SELECT CAST(ceil(0.2 * files) AS BIGINT) AS held, files - CAST(ceil(0.2 * files) AS BIGINT) AS kept, 0::BIGINT AS torn FROM n""")
def group_holdout(spark, sf_dir):
    df = fx.events(spark, sf_dir).select(F.col("device_id").alias("file"), "seq")
    sides = splits.group_holdout(df, 0.2).groupBy("file").agg(
        F.max(F.col("holdout").cast("int")).alias("hi"), F.min(F.col("holdout").cast("int")).alias("lo"))
    return sides.agg(F.count_if(F.col("lo") == 1).alias("held"), F.count_if(F.col("hi") == 0).alias("kept"),
                     F.count_if(F.col("hi") != F.col("lo")).alias("torn"))


@query("spl3_stratified_kfold", """WITH n AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY ALL)
SELECT label, k::INT AS fold, n // 5 + CASE WHEN k < n % 5 THEN 1 ELSE 0 END AS n FROM n, range(5) q(k)""")
def stratified_kfold(spark, sf_dir):
    df = fx.events(spark, sf_dir).select(F.col("event_type").alias("label"), "seq")
    return splits.stratified_kfold(df, 5, "label", ["seq"]).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("spl4_random_split", f"""SELECT substr(md5('42|' || event_id), 1, 8) < '{int(0.8 * (1 << 32)):08x}' AS train,
  count(*) AS n, sum(event_id)::BIGINT AS seq_sum FROM events GROUP BY ALL""")
def random_split(spark, sf_dir):
    df = splits.random_split(fx.events(spark, sf_dir), 0.8, ["seq"])
    return df.groupBy("train").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))


# Models on the embeddings as windows.

SAMPLE_NAMES = [f"f{n}" for n in range(64)]
USED = SAMPLE_NAMES


def feature_table(spark, sf_dir, label: str = "y3"):
    v = fx.vectors(spark, sf_dir)
    return v.select("file", "window_index", F.col(label).alias("label_id"),
                    *[F.col("samples")[n].alias(f"f{n}") for n in range(64)])


def folded_table(spark, sf_dir, label: str = "y3", folds: int = FOLDS):
    def build():
        return cut(splits.group_kfold(feature_table(spark, sf_dir, label), folds))
    return fx.stored(spark, sf_dir, f"folded_{label}_{folds}", build)


SQL_WIDE_VECTORS = fx.SQL_VECTORS + ", wide AS (SELECT window_index, " + ", ".join(
    f"samples[{n + 1}] AS f{n}" for n in range(64)) + " FROM vectors)"


@query("ml1_standard_scale", f"WITH {SQL_WIDE_VECTORS} SELECT window_index, " + ", ".join(
    f"round((f{n} - avg(f{n}) OVER ()) / stddev_pop(f{n}) OVER (), 8) + 0.0 AS f{n}" for n in range(64)) + " FROM wide")
def standard_scale(spark, sf_dir):
    scaled = models.standard_scale(feature_table(spark, sf_dir).select("window_index", *USED), USED)
    return scaled.withColumns({c: F.round(c, 8) + F.lit(0.0) for c in USED})


@query("ml2_pca_embed")
def pca_embed(spark, sf_dir):
    out = models.pca_embed(feature_table(spark, sf_dir), SAMPLE_NAMES)
    return out.select("window_index", F.round(F.abs("pc1"), 6).alias("pc1"), F.round(F.abs("pc2"), 6).alias("pc2"))


@query("ml3_kmeans_cluster", f"WITH {fx.SQL_VECTORS} SELECT window_index, TRUE AS nearest FROM vectors")
def kmeans_cluster(spark, sf_dir):
    """Every window, and whether the mean of its cluster is the nearest of the clusters' means."""
    table = models.standard_scale(feature_table(spark, sf_dir), SAMPLE_NAMES)
    found = cut(models.kmeans_cluster(table, SAMPLE_NAMES).select("window_index", "cluster", *SAMPLE_NAMES))
    means = found.groupBy("cluster").agg(*[F.avg(c).alias(f"m_{c}") for c in SAMPLE_NAMES]).withColumnRenamed(
        "cluster", "other")
    away = sum(((F.col(c) - F.col(f"m_{c}")) ** 2 for c in SAMPLE_NAMES), F.lit(0.0))
    one = F.lit(1).alias("_k")  # three means meet every row
    met = found.select("*", one).join(F.broadcast(means.select("*", one)), "_k").withColumn("_d", away)
    return met.groupBy("window_index").agg(
        (F.min_by("other", "_d") == F.first("cluster")).alias("nearest"))


@query("ml4_explore_unsupervised")
def explore_unsupervised(spark, sf_dir):
    return models.explore_unsupervised(feature_table(spark, sf_dir), SAMPLE_NAMES, "label_id")


@query("agg9_silhouette", f"""WITH {SQL_WIDE_VECTORS}, long AS (
  SELECT window_index, y3 AS c, n, (x - avg(x) OVER f) / stddev_pop(x) OVER f AS x
  FROM (SELECT window_index, y3, unnest(range(64)) AS n, unnest(samples) AS x FROM vectors) WINDOW f AS (PARTITION BY n)),
size AS (SELECT c, count(DISTINCT window_index)::DOUBLE AS m, sum(x * x) AS q FROM long GROUP BY c),
sums AS (SELECT c, n, sum(x) AS s FROM long GROUP BY c, n),
squares AS (SELECT window_index, c, sum(x * x) AS x2 FROM long GROUP BY ALL),
dots AS (SELECT l.window_index, s.c AS other, sum(l.x * s.s) AS d FROM long l JOIN sums s USING (n) GROUP BY ALL),
away AS (SELECT window_index, p.c, other, (m * x2 - 2 * d + q) / CASE WHEN other = p.c THEN m - 1 ELSE m END AS mean_distance
         FROM squares p JOIN dots USING (window_index) JOIN size z ON z.c = other),
ab AS (SELECT window_index, min(mean_distance) FILTER (other = c) AS a, min(mean_distance) FILTER (other <> c) AS b FROM away GROUP BY ALL)
SELECT round(avg((b - a) / greatest(a, b)), 9) AS silhouette_squared_euclidean FROM ab""")
def silhouette(spark, sf_dir):
    """The classes as clusters."""
    ready = models.assemble(models.standard_scale(feature_table(spark, sf_dir), SAMPLE_NAMES), SAMPLE_NAMES)
    score = metrics.silhouette(ready, "features", "label_id")
    return spark.range(1).select(F.round(F.lit(score), 9).alias("silhouette_squared_euclidean"))


@query("ml5_boosted_baseline", f"WITH {fx.SQL_VECTORS} SELECT window_index, y3 AS y_true, TRUE AS known_class FROM vectors")
def boosted_baseline(spark, sf_dir):
    return boosted_predictions(spark, sf_dir).select("window_index", "y_true", F.col("y_pred").between(0, CLASSES - 1).alias("known_class"))


@query("ml5_boosted_predictions")
def boosted_predictions(spark, sf_dir):
    """The trained predictions themselves: window, fold, true and predicted class."""
    def build():
        table = splits.stratified_kfold(feature_table(spark, sf_dir), FOLDS, "label_id", ["window_index"])
        out = models.boosted_baseline(table, USED, CLASSES, keep=["window_index"])
        return cut(out.select("window_index", "fold", "y_true", "y_pred"))
    return fx.stored(spark, sf_dir, "boosted_predictions", build)


@query("ml6_random_search_cv")
def random_search_cv(spark, sf_dir):
    """Trials of both families; ``winner`` marks the one best of all."""
    builders = {
        "gbc": lambda **p: models.gradient_boosting(CLASSES, **p),
        "rf": lambda **p: RandomForestClassifier(featuresCol="scaled", labelCol="label_id", seed=42, **p),
    }
    trials = None
    for family, build in builders.items():
        draws = models.sample_params(models.SEARCH_SPACES[family], DRAWS, seed=42)
        _, _, part = models.random_search_cv(folded_table(spark, sf_dir), USED, build, draws, FOLDS)
        part = part.withColumn("family", F.lit(family))
        trials = part if trials is None else trials.unionByName(part)
    best = trials.orderBy(F.desc("best_score"), "family", "model_order").first()  # one row per draw
    won = (F.col("family") == best["family"]) & (F.col("model_order") == best["model_order"])
    return trials.withColumn("winner", won)


@query("ml7_cross_val_predict", f"WITH {fx.SQL_VECTORS} SELECT window_index, y3 AS y_true FROM vectors")
def cross_val_predict(spark, sf_dir):
    out = models.cross_val_predict(
        folded_table(spark, sf_dir), models.scaled_pipeline(USED, models.top20_forest()), FOLDS, ["window_index"])
    return out.select("window_index", "y_true")


def top20_table(spark, sf_dir):
    """The serving features of the wide recordings' windows, with a binary class by recording."""
    def build():
        windows = fx.wide_windows(spark, sf_dir, channels=["ay", "az", "wy"]).drop("window_offset")
        # Written before the folds, which read the rows twice: windows are made once.
        table = cut(features.top20_features(windows, fx.RATE, "ay", "az", "wy").drop("ay", "az", "wy"))
        return cut(splits.group_kfold(table.withColumn("label_id", (F.col("file") % 2).cast("int")), FOLDS))
    return fx.stored(spark, sf_dir, "top20_table", build)


def top20_model(spark, sf_dir):
    def build():
        pipeline = models.scaled_pipeline(list(features.TOP20), models.top20_forest())
        return models.fit_forest(top20_table(spark, sf_dir), pipeline)
    return fx.stored(spark, sf_dir, "top20_model", build)


@query("ml8_train_top20_forest")
def train_top20_forest(spark, sf_dir):
    _, predictions = models.train_top20_forest(top20_table(spark, sf_dir))
    return metrics.classification_report(metrics.confusion_matrix(predictions))


@query("top3_top_features")
def top_features(spark, sf_dir):
    return models.top_features(top20_model(spark, sf_dir), features.TOP20, spark, 20)


@query("ml9_compare_classifiers")
def compare_classifiers(spark, sf_dir):
    table = models.power_transform(folded_table(spark, sf_dir), USED)
    return models.compare_classifiers(table, USED, CLASSES, FOLDS)


GRID = [-1.0, 0.0, 0.5, 1.0, 2.0]


def _power_sql() -> str:
    def transform(lam: float) -> str:
        up = "ln(1 + x)" if lam == 0 else f"(pow(x + 1, {lam}) - 1) / {lam}"
        down = "-ln(1 - x)" if lam == 2 else f"-(pow(1 - x, {2 - lam}) - 1) / {2 - lam}"
        return f"CASE WHEN x >= 0 THEN {up} ELSE {down} END"
    fits = " UNION ALL ".join(
        f"SELECT feature, {n} AS k, -count(*) / 2 * ln(var_pop({transform(lam)})) + ({lam} - 1) * sum(sign(x) * ln(1 + abs(x))) AS l FROM long GROUP BY feature"
        for n, lam in enumerate(GRID))
    shaped = "CASE k " + " ".join(f"WHEN {n} THEN {transform(lam)}" for n, lam in enumerate(GRID)) + " END"
    stacked = " UNION ALL ".join(f"SELECT window_index, 'f{n}' AS feature, f{n} AS x FROM wide" for n in range(64))
    return f"""WITH {SQL_WIDE_VECTORS}, long AS ({stacked}), fits AS ({fits}),
best AS (SELECT feature, arg_max(k, l) AS k FROM fits GROUP BY feature),
shaped AS (SELECT window_index, feature, {shaped} AS z FROM long JOIN best USING (feature))
SELECT window_index, feature, round((z - avg(z) OVER f) / stddev_pop(z) OVER f, 7) + 0.0 AS z FROM shaped WINDOW f AS (PARTITION BY feature)"""


@query("ml10_yeo_johnson", _power_sql())
def yeo_johnson(spark, sf_dir):
    out = models.power_transform(feature_table(spark, sf_dir).select("window_index", *USED), USED, GRID)
    return out.unpivot(["window_index"], USED, "feature", "z").withColumn("z", F.round("z", 7) + F.lit(0.0))


@query("ml11_impute", f"WITH {SQL_WIDE_VECTORS}, holes AS (SELECT window_index, " + ", ".join(
    f"CASE WHEN (window_index + {n}) % {4 + n % 3} = 0 THEN NULL ELSE f{n} END AS f{n}" for n in range(64)) +
    " FROM wide) SELECT window_index, " + ", ".join(
    f"round(coalesce(f{n}, avg(f{n}) OVER ()), 9) + 0.0 AS f{n}" for n in range(64)) + " FROM holes")
def impute(spark, sf_dir):
    at = F.col("window_index")
    holes = feature_table(spark, sf_dir).select(at, *[
        F.when((at + n) % (4 + n % 3) == 0, None).otherwise(F.col(c)).alias(c) for n, c in enumerate(SAMPLE_NAMES)])
    return models.impute_mean(holes, SAMPLE_NAMES).withColumns({c: F.round(c, 9) + F.lit(0.0) for c in SAMPLE_NAMES})


def network_table(spark, sf_dir):
    """Windows with samples, spectrogram, class, folds and holdout."""
    def build():
        v = fx.vectors(spark, sf_dir).select("file", "window_index", "samples", F.col("y3").alias("label_id"))
        spectra = signals.stft_spectrogram(v, ["samples"], 16, 0.5)
        return cut(splits.group_holdout(splits.group_kfold(spectra, FOLDS), 0.2))
    return fx.stored(spark, sf_dir, "network_table", build)


@query("ml12_neural")
def neural(spark, sf_dir):
    parts = [models.neural_cv(network_table(spark, sf_dir), kind, CLASSES, FOLDS, hidden, ["samples"])
             for kind, hidden in HIDDEN.items()]
    return metrics.fold_summary(metrics.fold_metrics(parts[0].unionByName(parts[1]).unionByName(parts[2])))


@query("ml13_tune_neural")
def tune_neural(spark, sf_dir):
    table = network_table(spark, sf_dir)
    model, _, _ = models.tune_neural(table, "time", CLASSES, FOLDS, TRIALS, ["samples"])
    held = models.flatten_windows(table.where("holdout"), "time", ["samples"])
    scored = model.transform(held).select(F.col("label_id").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))
    return metrics.classification_report(metrics.confusion_matrix(scored))


@query("ml14_score_windows", f"""WITH {catalog_signals.SQL_WIN6}
SELECT DISTINCT file, window_index, TRUE AS sums_to_one, TRUE AS largest FROM win""")
def score_windows(spark, sf_dir):
    """Every window once, with probabilities that sum to one and the class of the largest."""
    out = models.score_windows(top20_table(spark, sf_dir), top20_model(spark, sf_dir))
    total = F.aggregate("probs", F.lit(0.0), lambda a, p: a + p)
    largest = (F.col("confidence") == F.array_max("probs")) & (F.get("probs", F.col("class")) == F.col("confidence"))
    return out.select("file", "window_index", (F.abs(total - 1) < 1e-9).alias("sums_to_one"), largest.alias("largest"))
