"""Column expressions: labels, times, binary frames, predictions and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorgrid.settings import BINARY_CODES, CLASS_CODES, SLUG_REPLACEMENTS

FAULT = "Faulty"

# Frame layout and scales of the binary sensor protocol.
FRAME_BYTES = 11
HEADER = 0x55
ACCEL_TYPE, GYRO_TYPE = 0x51, 0x52
ACCEL_SCALE = 16.0 * 9.8 / 32768.0
GYRO_SCALE = 2000.0 / 32768.0
TEMPERATURE_SCALE = 100.0
STANDARD_GRAVITY = 9.8


def label_from_name(name: Column) -> Column:
    lower = F.lower(name)
    return (
        F.when(lower.contains("good"), "good").when(lower.contains("moderate"), "moderate")
        .when(lower.contains("bad"), "bad").otherwise("unknown")
    )


def encode_label(label: Column, binary: bool = False, lenient: bool = False) -> Column:
    """Class code of a label. An unknown label is an error, or -1 (0 if binary) when lenient."""
    codes = BINARY_CODES if binary else CLASS_CODES
    lower = F.lower(label)
    out = None
    for name, code in codes.items():
        out = F.when(lower == name, code) if out is None else out.when(lower == name, code)
    if lenient:
        return out.otherwise(0 if binary else -1)
    unknown = F.raise_error(F.concat(F.lit("label outside good, moderate, bad: "), F.coalesce(label, F.lit("null"))))
    return out.otherwise(unknown.cast("int"))


def channel_slug(channel: Column) -> Column:
    out = F.lower(channel)
    for old, new in SLUG_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def coerce_number(cell: Column) -> Column:
    return F.trim(cell).try_cast("double")


def parse_time(cell: Column) -> Column:
    return F.try_to_timestamp(F.trim(cell))


def require_some_time(df: DataFrame, column: str = "ts", key: str = "file") -> DataFrame:
    """One row per recording, failing for a recording in which no time could be read."""
    message = F.concat(F.lit("no readable time in "), F.col(key).cast("string"))
    return df.groupBy(key).agg(F.count(column).alias("readable")).withColumn(
        "readable", F.when(F.col("readable") > 0, F.col("readable")).otherwise(F.raise_error(message).cast("bigint"))
    )


def _frame_byte(place: int) -> Column:
    """Byte ``place`` (from 1) of the frame that ``_lead`` (six bytes) and ``_rest`` (five) hold as numbers."""
    return F.shiftright("_lead", 8 * (6 - place)) if place <= 6 else F.shiftright("_rest", 8 * (FRAME_BYTES - place))


def _int16(at: int) -> Column:
    """Little-endian signed value of bytes ``at`` and ``at + 1``."""
    low, high = (_frame_byte(p).bitwiseAND(255).cast("int") for p in (at, at + 1))
    return low + (high - F.when(high > 127, 256).otherwise(0)) * 256


def decode_frames(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Decode 11-byte frames; frames of other lengths or types, or with a bad checksum, are dropped.

    ``x, y, z`` are in m/s² for acceleration (``*_g`` in g) and in °/s for rotation. The bytes become two numbers once
    per row; a generator makes them, since filters and projections behind it do not repeat what it has computed.
    """
    others = [c for c in df.columns if c != frame]
    accel = _frame_byte(2).bitwiseAND(255) == ACCEL_TYPE
    scale = F.when(accel, ACCEL_SCALE).otherwise(GYRO_SCALE)
    number = "cast(conv(hex(substring({}, {}, {})), 16, 10) as bigint)"
    taken = df.where(
        f"length({frame}) = {FRAME_BYTES} and substring({frame}, 2, 1) in (X'{ACCEL_TYPE:02X}', X'{GYRO_TYPE:02X}')"
    ).select(*others, F.inline(F.expr(
        f"array(named_struct('_lead', {number.format(frame, 1, 6)}, '_rest', {number.format(frame, 7, 5)}))")))
    total = sum((_frame_byte(p).bitwiseAND(255) for p in range(1, FRAME_BYTES)), F.lit(0).cast("bigint"))
    sound = taken.where(total.bitwiseAND(255) == _frame_byte(FRAME_BYTES).bitwiseAND(255))
    decoded = sound.select(
        *others, F.when(accel, "accel").otherwise("gyro").alias("type"),
        *[(_int16(3 + 2 * n) * scale).alias(axis) for n, axis in enumerate("xyz")],
        (_int16(9) / TEMPERATURE_SCALE).alias("temp"),
    )
    return decoded.select("*", *[
        F.when(F.col("type") == "accel", F.col(axis) / STANDARD_GRAVITY).alias(f"{axis}_g") for axis in "xyz"
    ])


def filter_packets(df: DataFrame, kinds=("accel", "gyro")) -> DataFrame:
    return df.where(F.col("type").isin(*kinds))


def top_class(probabilities: Column) -> Column:
    """Struct of class index (first of the largest), confidence and display label."""
    best = F.array_max(probabilities)
    index = (F.array_position(probabilities, best) - 1).cast("int")
    label = F.when(index == 0, "Good").when(index == 1, FAULT).otherwise("Unknown")
    return F.struct(index.alias("class"), best.alias("confidence"), label.alias("label"))


def predicted_class(prediction: Column, probabilities: Column) -> Column:
    """As ``top_class`` for a model that states its own prediction."""
    index = prediction.cast("int")
    label = F.when(index == 0, "Good").otherwise(FAULT)
    return F.struct(
        index.alias("class"), F.element_at(probabilities, index + 1).alias("confidence"), label.alias("label")
    )


PREDICTION = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("probs", T.ArrayType(T.DoubleType())),
])

MODELS = ("cnn1d", "lstm", "cnn2d")


def predictions_map(df: DataFrame, models=MODELS, name: str = "predictions") -> DataFrame:
    """``{model}_label``/``{model}_confidence`` columns as a map; a missing model has no entry."""
    entries = F.array(*[
        F.struct(F.lit(m).alias("model"), F.struct(
            F.col(f"{m}_label").alias("label"), F.col(f"{m}_confidence").alias("confidence")
        ).alias("result")) for m in models
    ])
    present = F.filter(entries, lambda e: e["result"]["label"].isNotNull())
    dropped = [f"{m}_{part}" for m in models for part in ("label", "confidence")]
    return df.withColumn(name, F.map_from_entries(present)).drop(*dropped)


def flatten_predictions(df: DataFrame, models=MODELS, name: str = "predictions") -> DataFrame:
    """The inverse: one label and one confidence column per model, null when absent."""
    return df.select(
        *[c for c in df.columns if c != name],
        *[F.col(name)[m][part].alias(f"{m}_{part}") for m in models for part in ("label", "confidence")],
    )


def explode_predictions(df: DataFrame, name: str = "predictions") -> DataFrame:
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(name).alias("model", "_r")).select(
        *others, "model", F.col("_r.label").alias("label"), F.col("_r.confidence").alias("confidence")
    )


def prediction_text(label: Column, confidence: Column) -> Column:
    return F.format_string("%s (%.2f)", label, confidence)


def _percent(value: Column) -> Column:
    return F.format_string("%.1f%%", value * 100)


def alert_message(predictions: Column, at: Column, threshold: int, ml: Column | None = None) -> Column:
    """The alert text. ``ml`` is a struct of label, confidence and total_ms, or null."""
    lines = F.transform(F.map_entries(predictions), lambda e: F.concat(
        F.lit("  • "), F.upper(e["key"]), F.lit(": "), e["value"]["label"],
        F.lit(" ("), _percent(e["value"]["confidence"]), F.lit(")"),
    ))
    if ml is not None:
        extra = F.concat(
            F.lit("  • ML (RF-20): "), F.coalesce(ml["label"], F.lit("Unknown")), F.lit(" ("),
            _percent(F.coalesce(ml["confidence"], F.lit(0.0))), F.lit(") - "),
            F.format_string("%.1fms", F.coalesce(ml["total_ms"], F.lit(0.0))),
        )
        lines = F.when(ml.isNotNull(), F.array_append(lines, extra)).otherwise(lines)
    # Fixed text: the wording of the alert.
    return F.concat(
        F.lit(f"⚠️ **FAULT DETECTED** ⚠️\n\n**{threshold} consecutive fault predictions detected!**\n\n**Time**: "),
        F.date_format(at, "yyyy-MM-dd HH:mm:ss"),
        F.lit("\n\n**Model Results**:\n"), F.array_join(lines, "\n"),
        F.lit("\n\n**Recommendation**: Inspect equipment immediately.\n"),
    )
