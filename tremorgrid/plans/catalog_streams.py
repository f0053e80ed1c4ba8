"""Registered queries: sources, sinks and streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorgrid.functions import expressions as ex
from tremorgrid.operators import features, metrics, models, quality, signals
from tremorgrid.plans import catalog_models, catalog_predictions, catalog_quality, catalog_signals
from tremorgrid.plans import fixtures as fx
from tremorgrid.plans.registry import query
from tremorgrid.session import cut
from tremorgrid.settings import CHANNELS, TIMESTAMP_COLUMN
from tremorgrid.sources import logs, recordings
from tremorgrid.streaming import frames
from tremorgrid.streaming import predictions as sp
from tremorgrid.streaming import windows as sw
from tremorgrid.streaming.state import begin

VALUES = catalog_predictions.VALUES
MESSAGE_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


BATCHES, FILES = 4, 2
#: Rows of a table for each file of a micro-batch beyond ``FILES``.
FILE_ROWS = 1_000_000


def time_cuts(df, batches: int = BATCHES) -> list[int]:
    """Times in microseconds that cut the rows into ``batches`` parts of about equal size."""
    shares = [n / batches for n in range(1, batches)]
    return [int(t) for t in df.select(F.unix_micros("ts").cast("double").alias("t")).approxQuantile("t", shares, 0.01)]


def as_stream(spark, df, cuts=None):
    """The rows of a table as a stream of micro-batches in time order, each of several files.

    Every part is written as ``FILES`` files by device, more where the table is large, after the part before it; the
    source takes as many of the oldest files at a time.
    """
    files = max(FILES, df.count() // FILE_ROWS)
    path = fx.scratch(spark)
    cuts = time_cuts(df) if cuts is None else cuts
    at = F.unix_micros("ts")
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = df.where(F.lit(True) if low is None else at >= low).where(F.lit(True) if high is None else at < high)
        part.repartition(files, F.hash("device_id", "seq")).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def finish(spark, stream):
    """Run an append stream over everything available and return what it wrote."""
    path, checkpoint = fx.scratch(spark), fx.scratch(spark)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    begin(writer, spark, path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def totals(spark, stream):
    """Run an aggregating stream over everything available, writing changes only, and return its final table."""
    path = fx.scratch(spark)
    sp.write_changes(stream, path, fx.scratch(spark)).awaitTermination()
    changes = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("version", T.LongType())])).parquet(path)
    return sp.latest_totals(changes, ["device_id"])


# Sources and sinks.

@query("src1_read_recordings", f"""WITH {fx.SQL_WIDE}
SELECT count(*) AS samples, round(sum(ax), 4) AS ax, round(sum(ay), 4) AS ay, round(sum(az), 4) AS az, round(sum(wx), 4) AS wx,
       round(sum(wy), 4) AS wy, round(sum(wz), 4) AS wz, sum(800000 - 100000 * (i % 8))::BIGINT AS us, 'unknown' AS label FROM rec_wide""")
def read_recordings(spark, sf_dir):
    """The wide recordings as CSV files with an extra column, read back."""
    time = F.date_format(F.timestamp_micros((F.col("i") % 8 * -100_000 + 800_000).cast("bigint")), "yyyy-MM-dd HH:mm:ss.SSS")
    table = fx.rec_wide(spark, sf_dir).select(
        F.concat(F.lit(" "), time).alias(TIMESTAMP_COLUMN), F.lit("x").alias("Device"),
        *[F.col(c).alias(name) for c, name in zip(fx.WIDE_CHANNELS, CHANNELS)])
    path = fx.scratch(spark)
    table.write.option("header", True).csv(path)
    back = recordings.read_recordings(spark, path)
    return back.agg(
        F.count(F.lit(1)).alias("samples"),
        *[F.round(F.sum(name), 4).alias(c) for c, name in zip(fx.WIDE_CHANNELS, CHANNELS)],
        F.sum(F.unix_micros("ts")).alias("us"), F.max("label").alias("label"))


@query("src2_require_channels", f"WITH {fx.SQL_WIDE} SELECT file, i, round(ax, 6) AS ax FROM rec_wide")
def require_channels(spark, sf_dir):
    kept = recordings.require_columns(fx.rec_wide(spark, sf_dir), ["file", "i", "ax"])
    return kept.withColumn("ax", F.round("ax", 6))


@query("src4_config", catalog_quality.SQL_CONFIG)
def config_round_trip(spark, sf_dir):
    path = fx.scratch(spark)
    config = quality.config_from_row(catalog_quality.config_frame(spark, sf_dir).first())
    recordings.write_config(spark, config, path)
    recordings.read_config(spark, path)
    return catalog_quality.config_columns(
        spark.read.schema(recordings.CONFIG_SCHEMA).option("multiLine", True).json(path))


@query("src5_feature_matrix", f"WITH {fx.SQL_LONG}, {fx.sql_windows('rec_long', ['x'], 20, 10)} "
       "SELECT file, window_index, CASE WHEN contains(file, 'Good') THEN 0 WHEN contains(file, 'Moderate') THEN 1 ELSE 2 END::INT AS label_id, "
       "round(avg(x), 6) AS mean FROM win GROUP BY ALL")
def feature_matrix(spark, sf_dir):
    windows = signals.window_signal(fx.rec_single(spark, sf_dir), ["x"], 20, 0.5)
    table = features.time_features(windows.select("file", "window_index", "x"), "x").drop("x")
    path = fx.scratch(spark)
    recordings.write_feature_matrix(table.withColumn("label", ex.label_from_name(F.col("file"))), path)
    return recordings.read_feature_matrix(spark, path).select(
        "file", "window_index", "label_id", F.round("mean", 6).alias("mean"))


@query("src6_window_dataset", f"""WITH {catalog_signals.SQL_WIN6}
SELECT CASE file % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'moderate' ELSE 'bad' END AS label, count(DISTINCT (file, window_index)) AS windows,
       count(*) * 6 AS samples FROM win GROUP BY ALL""")
def window_dataset(spark, sf_dir):
    kind = F.when(F.col("file") % 3 == 0, "good").when(F.col("file") % 3 == 1, "moderate").otherwise("bad")
    path = fx.scratch(spark)
    recordings.write_window_dataset(fx.wide_windows(spark, sf_dir).withColumn("label", kind), path)
    size = sum((F.size(c) for c in fx.WIDE_CHANNELS), F.lit(0))
    return recordings.read_window_dataset(spark, path).groupBy("label").agg(
        F.count(F.lit(1)).alias("windows"), F.sum(size).alias("samples"))


@query("src7_json_report", "SELECT user_id AS device_id, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def json_report(spark, sf_dir):
    report = fx.events(spark, sf_dir).groupBy("device_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    path = fx.scratch(spark)
    recordings.write_json_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query("src8_overwrite_outputs", "SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def overwrite_outputs(spark, sf_dir):
    """A second run replaces what the first one left."""
    path = fx.scratch(spark)
    df = fx.events(spark, sf_dir)
    recordings.overwrite_outputs({"counts": df.groupBy("device_id").count()}, path)
    counts = df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    recordings.overwrite_outputs({"counts": counts}, path)
    return spark.read.parquet(f"{path}/counts")


def _packet_messages(spark, sf_dir):
    time = F.date_format("ts", MESSAGE_TIME)
    accel, gyro = F.col("type") == "accel", F.col("type") == "gyro"
    table = fx.packets(spark, sf_dir).select(
        "type", *[F.when(accel, F.col(v)).alias(f"a{x}") for v, x in zip(VALUES, "xyz")],
        *[F.when(gyro, F.col(v)).alias(f"w{x}") for v, x in zip(VALUES, "xyz")],
        F.lit(25.0).alias("temp"), time.alias("timestamp"))
    return logs.to_message(table, table.columns)


@query("src9_read_packet_stream", f"""WITH {fx.SQL_PACKETS}
SELECT type, us, CASE type WHEN 'accel' THEN v0 END AS ax, CASE type WHEN 'gyro' THEN v1 END AS wy FROM packets""")
def readpacket_stream(spark, sf_dir):
    path = fx.scratch(spark)
    _packet_messages(spark, sf_dir).write.text(path)
    return finish(spark, logs.read_packet_stream(spark, path)).select("type", F.unix_micros("ts").alias("us"), "ax", "wy")


GARBAGE = ("garbage{", "[1, 2]", "", '{"type": "accel", "timestamp": "soon"}', '{"type": "gyro"}')


def _with_garbage(spark, messages):
    """The messages with all of ``GARBAGE`` before and behind them."""
    bad = spark.createDataFrame([(m,) for m in GARBAGE], "value string")
    return bad.unionByName(messages).unionByName(bad)


@query("src9_packets_among_garbage", f"""WITH {fx.SQL_PACKETS}
SELECT type, us, CASE type WHEN 'accel' THEN v0 END AS ax, CASE type WHEN 'gyro' THEN v1 END AS wy FROM packets""")
def packets_among_garbage(spark, sf_dir):
    path = fx.scratch(spark)
    _with_garbage(spark, _packet_messages(spark, sf_dir)).write.text(path)
    return finish(spark, logs.read_packet_stream(spark, path)).select("type", F.unix_micros("ts").alias("us"), "ax", "wy")


@query("src9_rejected_messages", """SELECT reason, count(*)::BIGINT AS n, (SELECT count(*) FROM events) AS good FROM (VALUES
  ('unreadable'), ('unreadable'), ('unreadable'), ('no time'), ('no time'),
  ('unreadable'), ('unreadable'), ('unreadable'), ('no time'), ('no time')) t(reason) GROUP BY reason""")
def rejected_messages(spark, sf_dir):
    mixed = _with_garbage(spark, _packet_messages(spark, sf_dir))
    good = logs.parse_messages(mixed, logs.PACKET_SCHEMA).agg(F.count(F.lit(1)).alias("good"))
    rejects = logs.rejected_messages(mixed, logs.PACKET_SCHEMA).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return rejects.join(F.broadcast(good)).select("reason", "n", "good")  # one row of counts


@query("src10_write_prediction_stream", f"WITH {fx.SQL_ML} SELECT us, label, round(confidence, 6) AS confidence FROM ml")
def write_prediction_stream(spark, sf_dir):
    columns, path = ["timestamp", "label", "confidence"], fx.scratch(spark)
    stream = as_stream(spark, fx.ml(spark, sf_dir)).withColumn("timestamp", F.date_format("ts", MESSAGE_TIME))
    logs.write_prediction_stream(stream, columns, path, fx.scratch(spark)).awaitTermination()
    back = logs.parse_messages(spark.read.text(path), logs.ML_SCHEMA)
    return back.select(F.unix_micros("ts").alias("us"), "label", F.round("confidence", 6).alias("confidence"))


SQL_LOGGED = f"""WITH {fx.SQL_DL} SELECT device_id, seq, us, cnn1d_label, round(cnn1d_confidence, 6) AS cnn1d_confidence, lstm_label,
  cnn2d_label, (faults > 1.5)::INT AS is_fault FROM votes"""


def _logged(df):
    return df.select("device_id", "seq", F.unix_micros("ts").alias("us"), "cnn1d_label",
                     F.round("cnn1d_confidence", 6).alias("cnn1d_confidence"), "lstm_label", "cnn2d_label", "is_fault")


@query("src11_log_predictions", SQL_LOGGED)
def log_predictions(spark, sf_dir):
    path = fx.scratch(spark)
    logs.append_log(logs.dl_log_rows(fx.dl_map(spark, sf_dir)), path)
    return _logged(spark.read.parquet(path))


def _ml_nested(spark, sf_dir):
    good = F.when(F.col("label") == "Good", F.col("confidence")).otherwise(1 - F.col("confidence"))
    return fx.ml(spark, sf_dir).withColumn("probabilities", F.struct(good.alias("Good"), (1 - good).alias("Faulty"))).withColumn(
        "timing", F.struct(F.lit(1.0).alias("feature_extraction_ms"), (F.col("total_time_ms") - 1).alias("inference_ms"),
                           F.col("total_time_ms").alias("total_ms"))).drop("total_time_ms")


@query("src11_log_again", SQL_LOGGED)
def log_again(spark, sf_dir):
    """The same named batch twice, read from messages among garbage: each prediction is logged once."""
    messages = logs.to_message(fx.dl_map(spark, sf_dir).select(
        "device_id", "seq", F.date_format("ts", MESSAGE_TIME).alias("timestamp"), "predictions"),
        ["device_id", "seq", "timestamp", "predictions"])
    schema = T.StructType([T.StructField("device_id", T.LongType()), T.StructField("seq", T.LongType()), *logs.DL_SCHEMA])
    path = fx.scratch(spark)
    for _ in range(2):
        rows = logs.dl_log_rows(logs.parse_messages(_with_garbage(spark, messages), schema))
        logs.append_log(rows, path, batch_id="one")
    return _logged(spark.read.parquet(path))


@query("src12_log_ml_predictions", f"""WITH {fx.SQL_ML} SELECT seq, us, label, round(confidence, 6) AS confidence,
  round(CASE label WHEN 'Good' THEN confidence ELSE 1 - confidence END, 6) AS prob_good, total_time_ms - 1 AS inference_time_ms, total_time_ms FROM ml""")
def log_ml_predictions(spark, sf_dir):
    path = fx.scratch(spark)
    logs.append_log(logs.ml_log_rows(_ml_nested(spark, sf_dir)), path)
    return spark.read.parquet(path).select(
        "seq", F.unix_micros("ts").alias("us"), "label", F.round("confidence", 6).alias("confidence"),
        F.round("prob_good", 6).alias("prob_good"), "inference_time_ms", "total_time_ms")


@query("src13_scan_log_range", SQL_LOGGED + " WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-20 18:30:00'")
def scan_log_range(spark, sf_dir):
    path = fx.scratch(spark)
    logs.append_log(logs.dl_log_rows(fx.dl_map(spark, sf_dir)), path)
    return _logged(logs.scan_log_range(spark.read.parquet(path), "2024-01-10 06:00:00", "2024-01-20 18:30:00"))


@query("src14_model_round_trip", f"""WITH {catalog_signals.SQL_WIN6}
SELECT DISTINCT file, window_index, TRUE AS same FROM win""")
def model_round_trip(spark, sf_dir):
    """The stored model gives every window what the model that was stored gives it."""
    path = fx.scratch(spark)
    kept, table = catalog_models.top20_model(spark, sf_dir), catalog_models.top20_table(spark, sf_dir)
    models.save_model(kept, path, features.TOP20, spark, model_type="RandomForest")
    model, _ = models.load_model(path, spark)
    columns = ["file", "window_index", "class", "label", "confidence", "probs"]
    one, two = (models.score_windows(table, m, stated=True).select(*columns) for m in (kept, model))
    given = F.struct(*columns[2:])
    joined = one.select("file", "window_index", given.alias("a")).join(
        two.select("file", "window_index", given.alias("b")), ["file", "window_index"], "full")
    return joined.select("file", "window_index", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


@query("src15_eval_outputs", f"WITH {fx.SQL_EVAL} SELECT seq, model, y_true, y_pred, round(probs[1], 9) AS p0 FROM evals")
def eval_outputs(spark, sf_dir):
    df, path = fx.evaluations(spark, sf_dir), fx.scratch(spark)
    recordings.write_eval_outputs(df, metrics.fold_metrics(df), path)
    return spark.read.parquet(f"{path}/predictions").select(
        "seq", "model", "y_true", "y_pred", F.round(F.col("probs")[0], 9).alias("p0"))


# Streaming jobs: each gives what the batch operators give on the same rows.

def packet_stream(spark, sf_dir):
    return as_stream(spark, fx.packets(spark, sf_dir).select("device_id", "ts", "seq", "type", *VALUES))


SQL_STREAM_WINDOWS = f"""{fx.SQL_PACKETS}, {catalog_predictions.SQL_PAIRS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY i) - 1 AS j FROM pairs),
rolled AS (SELECT device_id, us, j, sum(a_v0) OVER w AS a, sum(w_v2) OVER w AS w FROM numbered
           WINDOW w AS (PARTITION BY device_id ORDER BY j ROWS 19 PRECEDING))"""


def _window_sums(df):
    def total(c):
        return F.round(F.aggregate(c, F.lit(0.0), lambda s, v: s + v), 6)

    return df.select("device_id", F.unix_micros("ts").alias("us"), total("a_v0").alias("a"), total("w_v2").alias("w"))


@query("str1_stream_windows", f"WITH {SQL_STREAM_WINDOWS} SELECT device_id, us, round(a, 6) AS a, round(w, 6) AS w FROM rolled WHERE j >= 19")
def stream_windows(spark, sf_dir):
    return _window_sums(finish(spark, sw.stream_windows(packet_stream(spark, sf_dir), VALUES)))


@query("str1_stream_windows_throttled", f"""WITH RECURSIVE {SQL_STREAM_WINDOWS}, candidates AS (SELECT device_id, us FROM rolled WHERE j >= 19),
{catalog_predictions._greedy_sql(catalog_predictions.THROTTLE_SECONDS * 1_000_000 + 1)}
SELECT device_id, us, round(a, 6) AS a, round(w, 6) AS w FROM taken JOIN rolled USING (device_id, us)""")
def stream_windows_throttled(spark, sf_dir):
    stream = sw.stream_windows(packet_stream(spark, sf_dir), VALUES, every_seconds=catalog_predictions.THROTTLE_SECONDS)
    return _window_sums(finish(spark, stream))


@query("str1_stream_windows_fresh", f"""WITH RECURSIVE {fx.SQL_PACKETS}, {catalog_predictions.SQL_FRESH},
numbered AS (SELECT device_id, us, a, w, row_number() OVER (PARTITION BY device_id ORDER BY j) AS r FROM walk WHERE done),
rolled AS (SELECT device_id, us, r, sum(a) OVER o AS a, sum(w) OVER o / 4 AS w FROM numbered
           WINDOW o AS (PARTITION BY device_id ORDER BY r ROWS 9 PRECEDING))
SELECT device_id, us, round(a, 6) AS a, round(w, 6) AS w FROM rolled WHERE r >= 10""")
def stream_windows_fresh(spark, sf_dir):
    return _window_sums(finish(spark, sw.stream_windows(packet_stream(spark, sf_dir), VALUES, "fresh", size=10)))


@query("str2_stream_inference", f"""WITH {SQL_STREAM_WINDOWS}
SELECT device_id, us, TRUE AS same FROM rolled WHERE j >= 19""")
def stream_inference(spark, sf_dir):
    """Every window's published prediction is what the model gives the same window in a table."""
    windows, model = sw.stream_windows(packet_stream(spark, sf_dir), VALUES), catalog_models.top20_model(spark, sf_dir)
    columns = ["device_id", "timestamp", "label", "confidence", "probabilities"]
    scored = sw.stream_inference(windows, model, fx.RATE, "a_v1", "a_v2", "w_v1")
    path = fx.scratch(spark)
    logs.write_prediction_stream(scored, columns, path, fx.scratch(spark)).awaitTermination()
    schema = T.StructType([T.StructField("device_id", T.LongType()), *logs.ML_SCHEMA])
    published = logs.parse_messages(spark.read.text(path), schema)
    table = finish(spark, sw.stream_windows(packet_stream(spark, sf_dir), VALUES))
    batch = sw.stream_inference(table, model, fx.RATE, "a_v1", "a_v2", "w_v1")
    near = F.abs(F.col("b.confidence") - F.col("a.confidence")) < 1e-9
    joined = published.alias("a").join(batch.alias("b"), ["device_id", "timestamp"], "full")
    return joined.select("device_id", F.coalesce(F.unix_micros("a.ts"), F.unix_micros("b.ts")).alias("us"), F.coalesce(
        (F.col("a.label") == F.col("b.label")) & near, F.lit(False)).alias("same"))


def _dl_stream(spark, sf_dir):
    return as_stream(spark, fx.dl_wide(spark, sf_dir).drop("i"))


@query("str3_stream_vote", f"WITH {catalog_predictions.SQL_VOTED} SELECT * FROM voted")
def stream_vote(spark, sf_dir):
    dl = fx.dl_wide(spark, sf_dir).drop("i")
    cuts = time_cuts(dl)
    votes = sp.stream_vote(as_stream(spark, dl, cuts), as_stream(spark, fx.ml(spark, sf_dir), cuts))
    return finish(spark, votes).select("device_id", "seq", "is_fault")


@query("str4_stream_alerts", f"""WITH RECURSIVE {fx.SQL_DL}, {catalog_predictions.SQL_STREAK}, candidates AS (SELECT device_id, us FROM streaks WHERE streak),
{catalog_predictions._greedy_sql(catalog_predictions.COOLDOWN_SECONDS * 1_000_000)}
SELECT device_id, us, {catalog_predictions.SQL_ALERT_TEXT.format(at='ts', ml='')} AS message FROM taken JOIN streaks USING (device_id, us)""")
def stream_alerts(spark, sf_dir):
    alerts = finish(spark, sp.stream_alerts(_dl_stream(spark, sf_dir), 3, catalog_predictions.COOLDOWN_SECONDS))
    return alerts.select("device_id", F.unix_micros("ts").alias("us"), "message")


@query("str4_stream_alerts_recent_ml", f"""WITH RECURSIVE {fx.SQL_DL}, {fx.SQL_ML}, {catalog_predictions._asof_sql(2_500_000)}, {catalog_predictions.SQL_STREAK},
candidates AS (SELECT device_id, us FROM streaks WHERE streak), {catalog_predictions._greedy_sql(catalog_predictions.COOLDOWN_SECONDS * 1_000_000)}
SELECT device_id, us, {catalog_predictions.SQL_ALERT_TEXT.format(at='ts', ml="CASE WHEN ml_label IS NULL THEN '' ELSE concat(chr(10), printf('  • ML (RF-20): %s (%.1f%%) - %.1fms', ml_label, ml_confidence * 100, ml_total_time_ms)) END, ")} AS message
FROM taken JOIN latest USING (device_id, us)""")
def stream_alerts_recent_ml(spark, sf_dir):
    dl = fx.dl_wide(spark, sf_dir).drop("i")
    cuts = time_cuts(dl)
    alerts = finish(spark, sp.stream_alerts(
        as_stream(spark, dl, cuts), 3, catalog_predictions.COOLDOWN_SECONDS, as_stream(spark, fx.ml(spark, sf_dir), cuts), 2.5))
    return alerts.select("device_id", F.unix_micros("ts").alias("us"), "message")


@query("str5_stream_log", SQL_LOGGED)
def stream_log(spark, sf_dir):
    dl = as_stream(spark, fx.dl_map(spark, sf_dir).drop("i"))
    ml = as_stream(spark, _ml_nested(spark, sf_dir))
    path = fx.scratch(spark)
    for run in sp.stream_log(dl, ml, path, fx.scratch(spark)):
        run.awaitTermination()
    return _logged(spark.read.parquet(f"{path}/predictions"))


@query("str6_stream_monitor", f"""WITH {fx.SQL_PACKETS}
SELECT device_id, count(*) AS raw_packets, count(*) FILTER (type = 'accel') AS accel_packets, count(*) FILTER (type = 'gyro') AS gyro_packets,
       0::BIGINT AS predictions FROM packets GROUP BY device_id""")
def stream_monitor(spark, sf_dir):
    return totals(spark, sp.stream_packet_counts(packet_stream(spark, sf_dir)))


@query("str6_stream_fault_totals", f"""WITH {fx.SQL_DL}
SELECT device_id, count(*) AS predictions, count(*) FILTER (faults > 1.5) AS faults,
       round(count(*) FILTER (faults > 1.5) / count(*) * 100, 6) AS fault_rate FROM votes GROUP BY device_id""")
def stream_fault_totals(spark, sf_dir):
    stream = as_stream(spark, fx.dl_log(spark, sf_dir).withColumn("is_fault", F.col("is_fault") == 1))
    return totals(spark, sp.stream_fault_totals(stream)).withColumn("fault_rate", F.round("fault_rate", 6))


@query("str6_stream_recent", f"""WITH {fx.SQL_PACKETS}, ranked AS (
  SELECT device_id, seq, v0, row_number() OVER (PARTITION BY device_id ORDER BY i DESC) AS recency FROM packets WHERE type = 'accel')
SELECT * FROM ranked WHERE recency <= 10""")
def stream_recent(spark, sf_dir):
    stream = ex.filter_packets(packet_stream(spark, sf_dir), ("accel",))
    recent = finish(spark, sp.stream_recent(stream, ["v0"], 10))
    return sp.latest_version(recent).select("device_id", "seq", "v0", "recency")


# Several models on one stream, and frames of byte streams.

def batch_windows(spark, sf_dir):
    """Every window by the batch operators: pairs, then rolling buffers turned into one array per channel."""
    names = [f"{side}_{v}" for side in "aw" for v in VALUES]
    rolled = catalog_predictions.rolling_pairs(spark, sf_dir)
    return rolled.select("device_id", "ts", "seq", *[
        F.col(f"buffer.{n}").alias(n) for n in names])


def networks(spark, sf_dir, size: int = 16):
    """Three networks by the names of the stream's models, fitted on the windows of the first devices' days."""
    def build():
        names = [f"{side}_{v}" for side in "aw" for v in VALUES]
        windows = finish(spark, sw.stream_windows(packet_stream(spark, sf_dir), VALUES, every_seconds=86_400))
        labelled = cut(signals.stft_spectrogram(
            windows.withColumn("label_id", (F.col("device_id") % 2).cast("int")), names, size, 0.5))
        out = {}
        for name, kind in (("cnn1d", "time"), ("lstm", "hybrid"), ("cnn2d", "spec")):
            ready = models.flatten_windows(labelled, kind, names)
            fitted = models.neural_network(models.vector_size(ready), [8], 2, maxIter=20).fit(ready)
            out[name] = kind, models.network_of(fitted)
        return out
    return fx.stored(spark, sf_dir, "stream_networks", build)


@query("str2_stream_models", f"""WITH RECURSIVE {SQL_STREAM_WINDOWS}, candidates AS (SELECT device_id, us FROM rolled WHERE j >= 19),
{catalog_predictions._greedy_sql(catalog_predictions.THROTTLE_SECONDS * 1_000_000 + 1)}
SELECT device_id, us, model, TRUE AS same, round(a, 6) AS a, round(w, 6) AS w
FROM taken JOIN rolled USING (device_id, us), (VALUES ('cnn1d'), ('lstm'), ('cnn2d')) m(model)""")
def stream_models(spark, sf_dir):
    """Every throttled window's prediction by each of three networks is what the same network gives its window in a
    table; a fourth one, fitted for longer windows, fails for every window and is in no map."""
    fitted = networks(spark, sf_dir)
    broken = {"long": ("time", fitted["cnn2d"][1])}
    names = [f"{side}_{v}" for side in "aw" for v in VALUES]
    windows = sw.stream_windows(packet_stream(spark, sf_dir), VALUES, every_seconds=catalog_predictions.THROTTLE_SECONDS)
    live = finish(spark, sw.multi_model_inference(windows, {**fitted, **broken}, names, 16))
    batch = sw.multi_model_inference(batch_windows(spark, sf_dir), fitted, names, 16)
    near = F.aggregate(F.zip_with("a.value.probs", "b.value.probs", lambda p, q: F.abs(p - q)), F.lit(0.0),
                       lambda s, d: F.greatest(s, d)) < 1e-9
    long = lambda df, alias: df.select("device_id", "ts", "a_v0", "w_v2", F.explode("predictions").alias(
        "model", "value")).alias(alias)
    joined = long(live, "a").join(long(batch, "b"), ["device_id", "ts", "model"], "left")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, v: s + v), 6)
    return joined.select("device_id", F.unix_micros("ts").alias("us"), "model", F.coalesce(
        (F.col("a.value.label") == F.col("b.value.label")) & near, F.lit(False)).alias("same"),
        total("b.a_v0").alias("a"), total("b.w_v2").alias("w"))


@query("exp6_stream_frames", catalog_predictions.SQL_STREAM_FRAMES)
def stream_frames(spark, sf_dir):
    """Chunks that end four bytes into a frame, so that every frame is finished by the chunk of the next event and, at
    the borders of the four micro-batches, by another batch; the last frame of a device stays unfinished."""
    chunks = catalog_predictions.shifted_chunks(spark, sf_dir)
    framed = finish(spark, frames.stream_frames(as_stream(spark, chunks)))
    return catalog_predictions.decoded_frames(framed)
