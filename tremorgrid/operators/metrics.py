"""Evaluation metrics from prediction tables, and counters of streams and datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorgrid.operators.ordered import dense_index, running_sum
from tremorgrid.session import cut


def confusion_matrix(
    df: DataFrame, true: str = "y_true", pred: str = "y_pred", classes: int | None = None, normalize: bool = False
) -> DataFrame:
    """Counts by (true, pred). With ``classes`` codes 0..classes-1 are all listed, with zeros."""
    counts = df.groupBy(F.col(true).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    if classes is not None:
        codes = F.array(*[F.lit(c) for c in range(classes)])
        cells = df.sparkSession.range(1).select(F.explode(codes).alias("y_true")).select(
            "y_true", F.explode(codes).alias("y_pred"))
        counts = cells.join(counts, ["y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if normalize:
        total = F.sum("n").over(Window.partitionBy("y_true"))
        counts = counts.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))
    return counts


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def class_scores(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class that occurs, from confusion counts."""
    hit = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    by_true = confusion.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), hit.alias("hits"))
    by_pred = confusion.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    joined = by_true.join(by_pred, "label", "full").na.fill(0, ["support", "hits", "predicted"])
    scored = joined.where("support + predicted > 0").select(
        "label", "support", "hits",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", _ratio(2 * p * r, p + r))


def classification_report(confusion: DataFrame) -> DataFrame:
    """Rows per class plus ``accuracy``, ``macro avg`` and ``weighted avg``."""
    scores = cut(class_scores(confusion))
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    accuracy = F.sum("hits") / total
    overall = {
        "accuracy": [accuracy.alias(n) for n in names],
        "macro avg": [F.avg(n).alias(n) for n in names],
        "weighted avg": [(F.sum(F.col(n) * F.col("support")) / total).alias(n) for n in names],
    }
    report = scores.select(F.col("label").cast("string"), *names, "support")
    for label, columns in overall.items():
        report = report.unionByName(scores.agg(*columns, total.alias("support")).withColumn("label", F.lit(label)))
    return report


def contingency(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.groupBy(F.col(left).alias("u"), F.col(right).alias("v")).agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand_index(df: DataFrame, left: str, right: str) -> DataFrame:
    table = cut(contingency(df, left, right))

    def pairs(frame: DataFrame, name: str) -> DataFrame:
        n = F.col("n").cast("double")
        return frame.agg(F.sum(n * (n - 1) / 2).alias(name), F.sum(n).alias(f"total_{name}"))

    both = pairs(table, "both")
    rows = pairs(table.groupBy("u").agg(F.sum("n").alias("n")), "rows").select(F.col("rows"))
    columns = pairs(table.groupBy("v").agg(F.sum("n").alias("n")), "columns").select(F.col("columns"))
    one = both.select(F.lit(1).alias("_k"), "both", F.col("total_both").alias("total"))
    one = one.join(rows.withColumn("_k", F.lit(1)), "_k").join(columns.withColumn("_k", F.lit(1)), "_k")
    expected = F.col("rows") * F.col("columns") / (F.col("total") * (F.col("total") - 1) / 2)
    highest = (F.col("rows") + F.col("columns")) / 2
    return one.select(
        F.when(highest == expected, 1.0).otherwise((F.col("both") - expected) / (highest - expected))
        .alias("adjusted_rand_index")
    )


def normalized_mutual_info(df: DataFrame, left: str, right: str) -> DataFrame:
    """Mutual information over the mean of the two entropies."""
    table = cut(contingency(df, left, right))
    total = table.agg(F.sum("n").cast("double").alias("total")).withColumn("_k", F.lit(1))
    rows = table.groupBy("u").agg(F.sum("n").cast("double").alias("nu"))
    columns = table.groupBy("v").agg(F.sum("n").cast("double").alias("nv"))

    def entropy(frame: DataFrame, n: str, name: str) -> DataFrame:
        p = F.col(n) / F.col("total")
        return frame.withColumn("_k", F.lit(1)).join(total, "_k").agg((-F.sum(p * F.log(p))).alias(name)).withColumn(
            "_k", F.lit(1))

    n, whole = F.col("n").cast("double"), F.col("total")
    information = (
        table.join(rows, "u").join(columns, "v").withColumn("_k", F.lit(1)).join(total, "_k")
        .agg(F.sum(n / whole * F.log(n * whole / (F.col("nu") * F.col("nv")))).alias("mi")).withColumn("_k", F.lit(1))
    )
    one = information.join(entropy(rows, "nu", "hu"), "_k").join(entropy(columns, "nv", "hv"), "_k")
    mean = (F.col("hu") + F.col("hv")) / 2
    return one.select(F.when(mean <= 0, 1.0).when(F.col("mi") <= 2.220446049250313e-16, 0.0)
                      .otherwise(F.col("mi") / mean).alias("normalized_mutual_info"))


def silhouette(df: DataFrame, features: str = "features", cluster: str = "prediction") -> float:
    """Mean silhouette with squared Euclidean distance (linear cost); NaN for fewer than two clusters."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    if df.select(cluster).distinct().limit(2).count() < 2:
        return float("nan")
    return ClusteringEvaluator(
        featuresCol=features, predictionCol=cluster, distanceMeasure="squaredEuclidean"
    ).evaluate(df)


def fold_metrics(df: DataFrame, probabilities: str | None = "probs") -> DataFrame:
    """Accuracy and log loss of each (model, fold) from out-of-fold predictions."""
    columns = [F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy")]
    if probabilities:
        p = F.element_at(F.col(probabilities), F.col("y_true") + 1)
        columns.append(F.avg(-F.log(F.greatest(F.least(p, F.lit(1 - 1e-7)), F.lit(1e-7)))).alias("loss"))
    return df.groupBy("model", "fold").agg(*columns)


def fold_summary(per_fold: DataFrame) -> DataFrame:
    return per_fold.groupBy("model").agg(
        F.count(F.lit(1)).alias("folds"), *[F.avg(c).alias(c) for c in ("accuracy", "loss") if c in per_fold.columns]
    )


def true_class_prob_histogram(df: DataFrame, probabilities: str = "probs", true: str = "y_true", bins: int = 20) -> DataFrame:
    """Counts of the probability given to the true class, in equal bins between its extremes."""
    p = df.select(F.element_at(F.col(probabilities), F.col(true).cast("int") + 1).alias("p")).where("p is not null")
    low, high = p.agg(F.min("p"), F.max("p")).first()
    if low is None:
        return p.sparkSession.createDataFrame([], "bin int, lower double, n bigint")
    if low == high:
        low, high = low - 0.5, high + 0.5
    bin_no = F.least(F.width_bucket(F.col("p"), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int")
    counts = p.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin", (F.lit(low) + (F.col("bin") - 1) * F.lit((high - low) / bins)).alias("lower"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def roc_auc(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Exact area under the ROC curve of each key, ties counted half.

    Equal scores are combined before any sort, and ranks come from the distributed index.
    """
    by_score = df.groupBy(*keys, score).agg(
        F.count_if(positive).alias("_pos"), F.count_if(~F.col(positive)).alias("_neg")
    )
    ranked = running_sum(cut(dense_index(by_score, keys, [score], "_r")), keys, "_r", {"_upto": F.col("_neg")})
    wins = F.col("_pos") * (F.col("_upto") - F.col("_neg") / 2)
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return ranked.groupBy(*keys).agg(F.when(pairs > 0, F.sum(wins) / pairs).alias("auc"))


def multiclass_auc(df: DataFrame, classes: int, keys: list[str] | None = None, probabilities: str = "probs") -> DataFrame:
    """One-vs-rest AUC averaged with the class shares as weights."""
    keys = keys or ["model"]
    spread = df.select(*keys, "y_true", F.posexplode(probabilities).alias("_class", "_score")).where(
        F.col("_class") < classes
    ).withColumn("_is", F.col("y_true") == F.col("_class"))
    areas = roc_auc(spread, [*keys, "_class"], "_score", "_is")
    weights = df.groupBy(*keys, F.col("y_true").cast("int").alias("_class")).agg(F.count(F.lit(1)).alias("_w"))
    return areas.join(weights, [*keys, "_class"]).groupBy(*keys).agg(
        (F.sum(F.col("auc") * F.col("_w")) / F.sum("_w")).alias("auc")
    )


def cv_leaderboard(df: DataFrame, classes: int | None = None, probabilities: str | None = None) -> DataFrame:
    """Accuracy, weighted recall/precision/F1, Cohen's kappa and MCC of each model, best first."""
    cells = cut(df.groupBy("model", "y_true", "y_pred").agg(F.count(F.lit(1)).cast("double").alias("n")))
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0.0)
    by_true = cells.groupBy("model", F.col("y_true").alias("label")).agg(F.sum("n").alias("t"), F.sum(hit).alias("h"))
    by_pred = cells.groupBy("model", F.col("y_pred").alias("label")).agg(F.sum("n").alias("p"))
    joined = by_true.join(by_pred, ["model", "label"], "full").na.fill(0.0, ["t", "h", "p"])
    t, p, h = F.col("t"), F.col("p"), F.col("h")
    precision, recall = _ratio(h, p), _ratio(h, t)
    scored = joined.withColumn("_prec", precision).withColumn("_rec", recall).withColumn(
        "_f1", _ratio(2 * F.col("_prec") * F.col("_rec"), F.col("_prec") + F.col("_rec")))
    s, c = F.sum("t"), F.sum("h")
    agg = scored.groupBy("model").agg(
        s.alias("_s"), c.alias("_c"), F.sum(t * p).alias("_tp"), F.sum(p * p).alias("_pp"), F.sum(t * t).alias("_tt"),
        (F.sum(t * F.col("_rec")) / s).alias("recall"), (F.sum(t * F.col("_prec")) / s).alias("precision"),
        (F.sum(t * F.col("_f1")) / s).alias("f1"),
    )
    n = F.col("_s")
    chance = F.col("_tp") / (n * n)
    accuracy = F.col("_c") / n
    spread = (n * n - F.col("_pp")) * (n * n - F.col("_tt"))
    board = agg.select(
        "model", accuracy.alias("accuracy"), "recall", "precision", "f1",
        F.when(chance < 1, (accuracy - chance) / (1 - chance)).otherwise(0.0).alias("kappa"),
        F.when(spread > 0, (F.col("_c") * n - F.col("_tp")) / F.sqrt(spread)).otherwise(0.0).alias("mcc"),
    )
    if probabilities:
        board = board.join(multiclass_auc(df.where(F.col(probabilities).isNotNull()), classes,
                                          probabilities=probabilities), "model", "left")
    return board.orderBy(F.desc("accuracy"), "model")


def best_model(scores: DataFrame, score: str = "best_score", order: str = "model_order") -> DataFrame:
    """The highest score; the first model wins ties."""
    return scores.orderBy(F.desc(score), order).limit(1)


def prediction_slice(df: DataFrame, order: list[str], window: int = 100) -> DataFrame:
    return df.orderBy(*order).limit(window).select(*order, "y_true", "y_pred")


def stream_counts(packets: DataFrame, device: str = "device_id") -> DataFrame:
    """Packet counters per device; works on a stream (update or complete mode) as on a table."""
    return packets.groupBy(device).agg(
        F.count(F.lit(1)).alias("raw_packets"),
        F.count_if(F.col("type") == "accel").alias("accel_packets"),
        F.count_if(F.col("type") == "gyro").alias("gyro_packets"),
        F.count_if(F.col("type") == "prediction").alias("predictions"),
    )


def dataset_summary(windows: DataFrame, spectrogram: str | None = None) -> DataFrame:
    """Facts about a window dataset as (fact, item, value) rows: samples, labels, files, bins."""
    rows = windows.groupBy("file", "label").agg(F.count(F.lit(1)).alias("n"))
    base = cut(rows)
    out = base.agg(F.sum("n").alias("value")).select(F.lit("samples").alias("fact"), F.lit("").alias("item"), "value")
    out = out.unionByName(base.groupBy(F.col("label").cast("string").alias("item")).agg(F.sum("n").alias("value"))
                          .withColumn("fact", F.lit("label_distribution")))
    out = out.unionByName(base.groupBy(F.col("file").cast("string").alias("item")).agg(F.sum("n").alias("value"))
                          .withColumn("fact", F.lit("group_counts")))
    if spectrogram:
        shape = windows.agg(F.max(F.size(spectrogram)).alias("f"), F.max(F.size(F.col(spectrogram)[0])).alias("t"))
        out = out.unionByName(shape.select(F.explode(F.array(
            F.struct(F.lit("spectrogram_freq_bins").alias("fact"), F.lit("").alias("item"), F.col("f").cast("bigint").alias("value")),
            F.struct(F.lit("spectrogram_time_bins").alias("fact"), F.lit("").alias("item"), F.col("t").cast("bigint").alias("value")),
        )).alias("_r")).select("_r.*"))
    return out
