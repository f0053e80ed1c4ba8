"""Reading recording CSVs and the signal configuration; writing datasets and reports."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorgrid.functions.expressions import (
    coerce_number, encode_label, label_from_name, parse_time, require_some_time,
)
from tremorgrid.operators import quality
from tremorgrid.session import cut
from tremorgrid.settings import CHANNELS, CONFIG_SCHEMA, TIMESTAMP_COLUMN, SignalConfig


def require_columns(df: DataFrame, columns) -> DataFrame:
    """The named columns of ``df``, or an error that names the missing ones."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def require_channels(df: DataFrame, channels=CHANNELS) -> DataFrame:
    extra = [c for c in ("file", "_block", "_line") if c in df.columns]
    return require_columns(df, [*extra, TIMESTAMP_COLUMN, *channels])


def coerce_channels(df: DataFrame, channels=CHANNELS) -> DataFrame:
    """Text cells to numbers (null where they are not numbers); times trimmed and parsed to ``ts``."""
    others = [c for c in df.columns if c != TIMESTAMP_COLUMN and c not in channels]
    return df.select(
        *others, parse_time(F.col(f"`{TIMESTAMP_COLUMN}`")).alias("ts"),
        *[coerce_number(F.col(f"`{c}`")).alias(c) for c in channels],
    )


def _cells(line: Column, count: int, separator: str) -> Column:
    """The first ``count`` cells of a CSV line as an array; nulls where the line is shorter."""
    schema = ", ".join(f"c{n} string" for n in range(count))
    parsed = F.from_csv(line, F.lit(schema), {"sep": separator, "ignoreLeadingWhiteSpace": "true"})
    return F.array(*[parsed[f"c{n}"] for n in range(count)])


def _positions(headers: DataFrame, names: list[str], separator: str) -> DataFrame:
    """One thin row per file: its number of columns and where in its lines each named column stands.

    A file without one of the columns is an error that names the file and what it lacks.
    """
    widest = headers.agg(F.max(F.size(F.split("value", F.lit(re.escape(separator)))))).first()[0] or 1  # one number
    clean = F.regexp_replace("value", F.lit("^\\uFEFF"), F.lit(""))
    cells = headers.select("file", F.transform(_cells(clean, widest, separator), lambda c: F.rtrim(c)).alias("_names"))
    place = {name: F.array_position("_names", F.lit(name)) for name in names}
    absent = F.array_compact(F.array(*[F.when(place[n] == 0, F.lit(n)) for n in names]))
    found = cut(cells.select("file", F.lit(widest).alias("_width"), F.array(*place.values()).alias("_at"), absent.alias("_absent")))
    lacking = found.where(F.size("_absent") > 0).orderBy("file").limit(1).collect()  # at most one row
    if lacking:
        raise ValueError(f"{lacking[0]['file']} is missing required columns: {lacking[0]['_absent']}")
    return found.select("file", "_width", "_at")


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with their position ``i`` in their file.

    A split of a file (``_path``, ``_block``) is read by one task in its order, so lines are counted where they are read
    and written once, without a shuffle; the splits, one thin row each, are put in order and tell where each one begins.
    """
    placed = cut(lines.withColumn("_at", F.monotonically_increasing_id()))
    spans = placed.groupBy("file", "_path", "_block").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("file").orderBy("_block", "_low").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(spans.select("file", "_path", "_block", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_low")).alias("_shift")))
    return placed.join(starts, ["file", "_path", "_block"]).select("file", (F.col("_at") + F.col("_shift")).alias("i"), "value")


def read_recordings(
    spark: SparkSession, directory: str, pattern: str = "*.csv", channels=CHANNELS, encoding: str = "UTF-8",
    separator: str = ",", require_times: bool = True,
) -> DataFrame:
    """All recordings of a folder as one table: ``file, label, i, ts`` and the channels.

    ``i`` is the position of the sample in its file. Every file has its own header: columns are picked by their names
    in that file, whatever their order and whatever else it holds, also where a large file is read in several splits.
    Lines are read once, as text, and numbered; the first of each file is its header, and the headers become a thin
    table of positions that is joined to the lines. Cells are cast one by one, so a bad cell is a null and not a lost
    row. Blank lines are skipped; a quoted cell may hold the separator but no line break. A file without a required
    column is an error that names it, and with ``require_times`` so is one in which no time can be read.
    """
    try:
        raw = spark.read.option("pathGlobFilter", pattern).text(directory)
        if not raw.inputFiles():
            raise FileNotFoundError(f"no files match '{pattern}' in {directory}")
    except AnalysisException as error:
        raise FileNotFoundError(f"no files match '{pattern}' in {directory}") from error
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    text = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), encoding)
    numbered = _numbered(raw.select(
        name.alias("file"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
        text.alias("value")).where("trim(value) <> ''"))
    names = [TIMESTAMP_COLUMN, *channels]
    positions = _positions(numbered.where("i = 0").select("file", "value"), names, separator)
    width = positions.agg(F.max("_width")).first()[0]
    placed = numbered.where("i > 0").join(positions, "file").select("file", (F.col("i") - 1).alias("i"), _cells(
        F.col("value"), width or 1, separator).alias("_cells"), "_at")
    picked = placed.select("file", "i", *[
        F.get("_cells", (F.get("_at", F.lit(n)) - 1).cast("int")).alias(c) for n, c in enumerate(names)])
    typed = coerce_channels(picked, channels)
    if require_times:
        readable = cut(require_some_time(typed))  # one row per file, written: the rows are not shuffled to meet them
        typed = typed.join(readable, "file").where("readable > 0").drop("readable")
    return typed.select("file", label_from_name(F.col("file")).alias("label"), "i", "ts", *channels)


def read_config(spark: SparkSession, path: str) -> SignalConfig:
    row = spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(path).first()
    return quality.config_from_row(row)


def write_config(spark: SparkSession, config: SignalConfig, path: str) -> None:
    values = config.as_dict()
    row = tuple(values[field.name] for field in CONFIG_SCHEMA.fields)
    spark.createDataFrame([row], CONFIG_SCHEMA).coalesce(1).write.mode("overwrite").option(
        "ignoreNullFields", False).json(path)


def read_or_derive_config(spark: SparkSession, path: str, recordings: DataFrame) -> SignalConfig:
    """The stored configuration, or one derived from the recordings when none is stored."""
    try:
        return read_config(spark, path)
    except AnalysisException:
        rate = quality.target_sampling_rate(quality.sampling_metrics(recordings))
        return quality.config_from_row(
            quality.build_config(rate, low_cutoff_hz=1.0, upper_cutoff="floored").first())


def write_feature_matrix(features: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = features.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def read_feature_matrix(spark: SparkSession, path: str, fmt: str = "parquet", binary: bool = False) -> DataFrame:
    """A stored feature table with ``label_id``; ``file`` and ``label`` must be there."""
    df = spark.read.parquet(path) if fmt == "parquet" else spark.read.option("header", True).csv(path)
    missing = [c for c in ("file", "label") if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    if fmt == "csv":
        text = ("file", "label")
        df = df.select(*[F.col(c) if c in text else F.col(c).try_cast(
            "bigint" if c == "window_index" else "double").alias(c) for c in df.columns])
    return df.withColumn("label_id", encode_label(F.col("label"), binary))


def write_window_dataset(windows: DataFrame, path: str) -> None:
    """Windows, spectrograms, labels, groups and offsets as Parquet, one folder per label.

    Partitions are overwritten as they are rewritten, so a rerun leaves no stale label behind.
    """
    windows.write.mode("overwrite").partitionBy("label").parquet(path)


def read_window_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def overwrite_outputs(tables: dict[str, DataFrame], directory: str) -> None:
    """Replace each named output of a run; nothing of an earlier run remains in them."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{directory.rstrip('/')}/{name}")


def write_json_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_text_report(text: DataFrame, path: str) -> None:
    """Write a one-column table of rendered text."""
    text.coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_eval_outputs(predictions: DataFrame, metrics: DataFrame, directory: str) -> None:
    """Out-of-fold predictions (true, predicted, probabilities) and the metrics derived from them."""
    base = directory.rstrip("/")
    predictions.write.mode("overwrite").parquet(f"{base}/predictions")
    metrics.write.mode("overwrite").json(f"{base}/metrics")
