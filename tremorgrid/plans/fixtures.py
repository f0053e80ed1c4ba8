"""Views of the given tables in the shapes the operators expect, and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorgrid.functions.expressions import predictions_map
from tremorgrid.operators.ordered import dense_index, indexed_table
from tremorgrid.operators.signals import window_signal
from tremorgrid.operators.votes import majority_three
from tremorgrid.session import cut, own_dir, ship_package

RATE = 10.0
WIDE_CHANNELS = ["ax", "ay", "az", "wx", "wy", "wz"]

_STORED: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A fixture written once per session: indexed recordings are loaded once and then queried."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = build()
    return _STORED[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables' times have no zone
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("device_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"), "event_type", "value")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their dense position ``i`` within the device."""
    return stored(spark, sf_dir, "series", lambda: indexed_table(events(spark, sf_dir), ["device_id"], ["ts", "seq"]))


def file_name(device):
    kind = F.when(device % 3 == 0, "Good").when(device % 3 == 1, "Moderate").otherwise("Bad")
    return F.concat(kind, F.lit(" data__"), device.cast("string"), F.lit(".csv"))


def rec_long(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """Irregular single-channel recordings; with ``gaps`` every 13th value is missing."""
    x = F.when(F.col("seq") % 13 == 0, None).otherwise(F.col("value")) if gaps else F.col("value")
    return series(spark, sf_dir).select(
        file_name(F.col("device_id")).alias("file"), F.lit("value").alias("channel"), "i", "ts", x.alias("x"))


def rec_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec_long(spark, sf_dir).select("file", "i", "ts", "x")


def rec_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular 6-channel recordings of 10 samples per second."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]

    def build() -> DataFrame:
        lines = table(spark, sf_dir, "lineitem").select(
            F.col("l_suppkey").alias("file"), *order, "l_quantity", "l_discount", "l_tax")
        indexed = cut(dense_index(lines, ["file"], order).select(  # the order is in the index and is not written again
            "file", "i", "l_extendedprice", "l_quantity", "l_discount", "l_tax"))
        q, p, d, t = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
        return indexed.select(
            "file", "i", (q / 50).alias("ax"), (p / 100000).alias("ay"), (d * 10).alias("az"),
            (t * 100).alias("wx"), (q * d).alias("wy"), (p * t / 1000).alias("wz"))

    indexed = stored(spark, sf_dir, "rec_wide", build)
    at = F.timestamp_micros((F.lit(1_704_067_200_000_000) + F.col("i") * 100_000).cast("bigint"))
    return indexed.withColumn("ts", at)


def wide_windows(
    spark: SparkSession, sf_dir: str, size: int = 20, overlap: float = 0.5, channels: list[str] = WIDE_CHANNELS,
) -> DataFrame:
    """Windows of the named channels; only these travel, since arrays of structs are not pruned later."""
    return window_signal(rec_wide(spark, sf_dir), channels, size, overlap)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "view"), "accel").when(
        F.col("event_type").isin("purchase", "signup"), "gyro").otherwise("angle")
    return series(spark, sf_dir).select(
        "device_id", "ts", "seq", "i", kind.alias("type"), F.col("value").alias("v0"),
        (F.col("value") / 2).alias("v1"), (F.col("value") / 4).alias("v2"))


def _confidence(factor: int):
    return F.lit(0.5) + (F.col("seq") * factor % 50) / 100.0


def dl_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    absent = F.col("seq") % 11 == 0

    def fault(condition):
        return F.when(condition, "Faulty").otherwise("Good")

    v = F.col("value")
    return series(spark, sf_dir).select(
        "device_id", "ts", "seq", "i",
        fault(v > 30).alias("cnn1d_label"), _confidence(7).alias("cnn1d_confidence"),
        F.when(~absent, fault(v > 45)).alias("lstm_label"), F.when(~absent, _confidence(13)).alias("lstm_confidence"),
        fault((v > 20) & (F.col("event_type") != "view")).alias("cnn2d_label"),
        _confidence(17).alias("cnn2d_confidence"))


def dl_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions_map(dl_wide(spark, sf_dir))


def dl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = [F.col(f"{m}_label") for m in ("cnn1d", "lstm", "cnn2d")]
    return dl_wide(spark, sf_dir).withColumn("is_fault", majority_three(labels).cast("int"))


def ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-model predictions, up to 2.8 s before the multi-model ones."""
    micros = F.unix_micros("ts") - F.col("seq") % 5 * 700_000
    return events(spark, sf_dir).where("seq % 2 = 0").select(
        "device_id", F.timestamp_micros(micros).alias("ts"), "seq",
        F.when(F.col("value") > 35, "Faulty").otherwise("Good").alias("label"),
        _confidence(3).alias("confidence"), (F.col("seq") % 9 + 1.5).alias("total_time_ms"))


def ml_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ml`` with every tenth row once more at the same time and the other label."""
    base = ml(spark, sf_dir)
    flipped = F.when(F.col("label") == "Good", "Faulty").otherwise("Good")
    again = base.where("seq % 20 = 0").withColumn("label", flipped).withColumn("seq", F.col("seq") + 1_000_000)
    return base.unionByName(again)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as ready-made 64-sample windows of 21 recordings with classes."""
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 21).alias("file"), F.col("vec_id").alias("window_index"),
        F.col("embedding").cast("array<double>").alias("samples"),
        (F.col("label") % 3).alias("y3"), (F.col("label") % 2).alias("y2"))


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of five models over five folds with class probabilities."""
    w = [F.lit(1) + F.col("seq") % n for n in (7, 5, 3)]
    total = w[0] + w[1] + w[2]
    return events(spark, sf_dir).select(
        "seq", F.col("event_type").alias("model"), (F.col("device_id") % 5).cast("int").alias("fold"),
        (F.col("device_id") % 3).cast("int").alias("y_true"),
        F.when(F.col("seq") % 4 == 0, F.col("seq") % 3).otherwise(F.col("device_id") % 3).cast("int").alias("y_pred"),
        F.array(*[(part / total) for part in w]).alias("probs"))


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder, for queries that write and read back."""
    return f"{own_dir(spark)}/out-{uuid.uuid4().hex}"



# SQL twins, as common table expressions.
SQL_SERIES = """series AS (
  SELECT user_id AS device_id, ts, event_id AS seq, event_type, value, epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
         concat(CASE user_id % 3 WHEN 0 THEN 'Good' WHEN 1 THEN 'Moderate' ELSE 'Bad' END,
                ' data__', CAST(user_id AS VARCHAR), '.csv') AS file
  FROM events)"""
SQL_LONG = SQL_SERIES + """, rec_long AS (
  SELECT file, 'value' AS channel, i, ts, us, value AS x FROM series)"""
SQL_GAPS = SQL_SERIES + """, rec_long AS (
  SELECT file, 'value' AS channel, i, ts, us, CASE WHEN seq % 13 = 0 THEN NULL ELSE value END AS x FROM series)"""
SQL_WIDE = """rec_wide AS (
  SELECT l_suppkey AS file,
         row_number() OVER (PARTITION BY l_suppkey
           ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i,
         l_quantity/50 AS ax, l_extendedprice/100000 AS ay, l_discount*10 AS az,
         l_tax*100 AS wx, l_quantity*l_discount AS wy, l_extendedprice*l_tax/1000 AS wz
  FROM lineitem)"""
SQL_PACKETS = SQL_SERIES + """, packets AS (
  SELECT device_id, ts, us, seq, i,
         CASE WHEN event_type IN ('click','view') THEN 'accel'
              WHEN event_type IN ('purchase','signup') THEN 'gyro' ELSE 'angle' END AS type,
         value AS v0, value/2 AS v1, value/4 AS v2 FROM series)"""
SQL_DL = SQL_SERIES + """, dl AS (
  SELECT device_id, ts, us, seq, i,
       CASE WHEN value > 30 THEN 'Faulty' ELSE 'Good' END AS cnn1d_label,
       CAST(0.5 AS DOUBLE) + (seq*7 % 50)/CAST(100 AS DOUBLE) AS cnn1d_confidence,
       CASE WHEN seq % 11 = 0 THEN NULL WHEN value > 45 THEN 'Faulty' ELSE 'Good' END AS lstm_label,
       CASE WHEN seq % 11 = 0 THEN NULL ELSE CAST(0.5 AS DOUBLE) + (seq*13 % 50)/CAST(100 AS DOUBLE) END AS lstm_confidence,
       CASE WHEN value > 20 AND event_type <> 'view' THEN 'Faulty' ELSE 'Good' END AS cnn2d_label,
       CAST(0.5 AS DOUBLE) + (seq*17 % 50)/CAST(100 AS DOUBLE) AS cnn2d_confidence FROM series),
votes AS (
  SELECT *, (cnn1d_label = 'Faulty')::INT + coalesce((lstm_label = 'Faulty')::INT, 0) + (cnn2d_label = 'Faulty')::INT AS faults,
         2 + (lstm_label IS NOT NULL)::INT AS present FROM dl)"""
SQL_ML = """ml AS (
  SELECT user_id AS device_id, epoch_us(ts) - (event_id % 5) * 700000 AS us, event_id AS seq,
         CASE WHEN value > 35 THEN 'Faulty' ELSE 'Good' END AS label,
         CAST(0.5 AS DOUBLE) + (event_id*3 % 50)/CAST(100 AS DOUBLE) AS confidence,
         CAST(event_id % 9 AS DOUBLE) + CAST(1.5 AS DOUBLE) AS total_time_ms
  FROM events WHERE event_id % 2 = 0)"""
SQL_EVAL = """evals AS (
  SELECT event_id AS seq, event_type AS model, CAST(user_id % 5 AS INT) AS fold, CAST(user_id % 3 AS INT) AS y_true,
         CAST(CASE WHEN event_id % 4 = 0 THEN event_id % 3 ELSE user_id % 3 END AS INT) AS y_pred,
         [(1 + event_id % 7)::DOUBLE / (3 + event_id % 7 + event_id % 5 + event_id % 3),
          (1 + event_id % 5)::DOUBLE / (3 + event_id % 7 + event_id % 5 + event_id % 3),
          (1 + event_id % 3)::DOUBLE / (3 + event_id % 7 + event_id % 5 + event_id % 3)] AS probs
  FROM events)"""
SQL_VECTORS = """vectors AS (
  SELECT vec_id % 21 AS file, vec_id AS window_index, label % 3 AS y3, label % 2 AS y2,
         CAST(embedding AS DOUBLE[]) AS samples FROM embeddings)"""


def sql_windows(source: str, columns: list[str], size: int, step: int, key: str = "file", name: str = "win") -> str:
    """CTE with the samples of every full window: key, window_index, n (place in the window), columns."""
    listed = ", ".join(columns)
    return f"""{name}_all AS (
  SELECT {key}, unnest(range(greatest(i - {size} + {step}, 0) // {step}, i // {step} + 1)) AS window_index, i, {listed}
  FROM {source}),
{name} AS (
  SELECT {key}, window_index, i - window_index * {step} AS n, {listed} FROM {name}_all
  QUALIFY count(*) OVER (PARTITION BY {key}, window_index) = {size})"""
