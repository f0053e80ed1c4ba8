"""Prediction messages, packet streams and the date-partitioned prediction logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorgrid.functions.expressions import MODELS, PREDICTION, flatten_predictions
from tremorgrid.operators.votes import majority_three
from tremorgrid.streaming.state import begin

PACKET_SCHEMA = T.StructType(
    [T.StructField("type", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("ax", "ay", "az", "wx", "wy", "wz", "temp")]
    + [T.StructField("timestamp", T.StringType())]
)
DL_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("predictions", T.MapType(T.StringType(), PREDICTION)),
])
ML_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("probabilities", T.StructType([
        T.StructField("Good", T.DoubleType()), T.StructField("Faulty", T.DoubleType())])),
    T.StructField("timing", T.StructType([
        T.StructField(n, T.DoubleType()) for n in ("feature_extraction_ms", "inference_ms", "total_ms")])),
])


def read_message_stream(spark: SparkSession, path: str, fmt: str = "text", **options) -> DataFrame:
    """A stream of raw messages in column ``value``: text files, or any streaming source by format."""
    if fmt == "kafka":
        loaded = spark.readStream.format("kafka").options(**options).load()
        return loaded.select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")
    return spark.readStream.format(fmt).options(**options).load(path)


_CORRUPT = "_corrupt"


def _read_messages(df: DataFrame, schema: T.StructType, value: str) -> DataFrame:
    """Messages with their columns, the parsed time and ``reason``: null if the message can be used."""
    whole = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = df.withColumn("_m", F.from_json(value, whole, {"columnNameOfCorruptRecord": _CORRUPT}))
    time = F.try_to_timestamp("_m.timestamp")
    reason = F.when(F.col("_m").isNull() | F.col(f"_m.{_CORRUPT}").isNotNull(), "unreadable").when(
        time.isNull(), "no time")
    return parsed.select("*", time.alias("_ts"), reason.alias("_reason"))


def parse_messages(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """JSON messages to columns; ``ts`` is the parsed timestamp.

    Messages that are no JSON of this form, or have no readable time, are not here but in
    ``rejected_messages``.
    """
    read = _read_messages(df, schema, value).where("_reason is null")
    return read.select(*[c for c in df.columns if c != value], *[f"_m.{f.name}" for f in schema.fields],
                       F.col("_ts").alias("ts"))


def rejected_messages(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """The messages that ``parse_messages`` leaves out, as they came, with ``reason``."""
    read = _read_messages(df, schema, value).where("_reason is not null")
    return read.select(*df.columns, F.col("_reason").alias("reason"))


def read_packet_stream(spark: SparkSession, path: str, fmt: str = "text", **options) -> DataFrame:
    return parse_messages(read_message_stream(spark, path, fmt, **options), PACKET_SCHEMA)


def to_message(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def write_prediction_stream(df: DataFrame, columns: list[str], path: str, checkpoint: str, fmt: str = "text", **options):
    """Start a checkpointed query that publishes the columns as one JSON message per row."""
    writer = to_message(df, columns).writeStream.format(fmt).options(**options).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True)
    return begin(writer, df.sparkSession, None if fmt == "kafka" else path)


def dl_log_rows(df: DataFrame, predictions: str = "predictions", created_at: Column | None = None) -> DataFrame:
    """Log rows of multi-model messages: label and confidence per model, the vote, and times."""
    wide = flatten_predictions(df, MODELS, predictions)
    fault = majority_three([F.col(f"{m}_label") for m in MODELS]).cast("int")
    created = F.current_timestamp() if created_at is None else created_at
    return wide.withColumn("is_fault", fault).withColumn("created_at", created).withColumn(
        "log_date", F.to_date("ts"))


def ml_log_rows(df: DataFrame, created_at: Column | None = None) -> DataFrame:
    created = F.current_timestamp() if created_at is None else created_at
    nested = ("label", "confidence", "probabilities", "timing")
    return df.select(
        *[c for c in df.columns if c not in nested], "label", "confidence",
        F.col("probabilities.Good").alias("prob_good"), F.col("probabilities.Faulty").alias("prob_faulty"),
        F.col("timing.feature_extraction_ms").alias("feature_time_ms"),
        F.col("timing.inference_ms").alias("inference_time_ms"), F.col("timing.total_ms").alias("total_time_ms"),
        created.alias("created_at"), F.to_date("ts").alias("log_date"),
    )


#: Files that one date of one batch is spread over at most.
LOG_FILES = 8


def append_log(rows: DataFrame, path: str, checkpoint: str | None = None, batch_id: str | None = None):
    """Append log rows by date; the rows of a date meet in a few tasks, so a date has few files.

    A stream needs a checkpoint, which makes replayed batches count once. A batch that names itself with
    ``batch_id`` replaces what an earlier run of the same batch wrote, and nothing else.
    """
    salt = F.pmod(F.xxhash64("ts"), F.lit(LOG_FILES))
    gathered = rows.repartition("log_date", salt)
    if rows.isStreaming:
        return (
            gathered.writeStream.format("parquet").partitionBy("log_date").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(path)
        )
    if batch_id is None:
        gathered.write.mode("append").partitionBy("log_date").parquet(path)
        return None
    named = gathered.withColumn("batch_id", F.lit(batch_id))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "batch_id", "log_date").parquet(path)
    return None


def scan_log_range(log: DataFrame, start, end, newest_first: bool = True) -> DataFrame:
    """Rows with ``start <= ts <= end``. The bounds also prune the date folders."""
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    rows = log.where(F.col("ts").between(low, high))
    if "log_date" in log.columns:
        rows = rows.where(F.col("log_date").between(F.to_date(low), F.to_date(high)))
    return rows.orderBy(F.desc("ts"), F.desc("seq")) if newest_first else rows
