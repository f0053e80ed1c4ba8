"""Sampling and data-quality operators.

Wide recordings have one row per sample: ``file, i, ts`` and one double column per channel, with
``i`` the dense position in the recording. Long recordings hold ``file, channel, i, ts, x``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorgrid.operators.ordered import (
    CHUNK_ROWS, carry_last, exact_median, null_safe_join, previous, running_sum,
)
from tremorgrid.session import cut
from tremorgrid.settings import QualityThresholds, SignalConfig


def unpivot_channels(df: DataFrame, channels: list[str], ids: list[str] | None = None) -> DataFrame:
    """Wide recordings to long ones."""
    return df.unpivot(ids or ["file", "i", "ts"], list(channels), "channel", "x")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def sample_deltas(df: DataFrame) -> DataFrame:
    """Positive time steps between neighbouring rows of a recording, in row order."""
    stepped = previous(df.select("file", "i", "ts"), ["file"], "i", {"_before": F.col("ts")})
    return stepped.select("file", seconds_between(F.col("ts"), F.col("_before")).alias("dt")).where("dt > 0")


def sampling_metrics(df: DataFrame, strict: bool = True) -> DataFrame:
    """Rate statistics of each recording. One without a readable time or a positive step is an error if strict."""
    steps = cut(sample_deltas(df).withColumn("fs", 1.0 / F.col("dt")))
    spread = steps.groupBy("file").agg(
        F.avg("dt").alias("dt_mean"), F.stddev_pop("dt").alias("dt_std"),
        F.avg("fs").alias("fs_mean"), F.stddev_pop("fs").alias("fs_std"),
    )
    extent = df.groupBy("file").agg(
        F.count(F.lit(1)).alias("samples"), F.count("ts").alias("_times"),
        seconds_between(F.max_by("ts", "i"), F.min_by("ts", "i")).alias("duration_seconds"),
    )
    joined = null_safe_join(null_safe_join(extent, spread, ["file"], "left"),
                            exact_median(steps, ["file"], "fs", "fs_median"), ["file"], "left")
    if strict:
        problem = F.when(F.col("_times") == 0, "no readable time in ").otherwise("no positive sampling step in ")
        failure = F.raise_error(F.concat(problem, F.coalesce(F.col("file").cast("string"), F.lit("null"))))
        joined = joined.withColumn(
            "dt_mean", F.when(F.col("dt_mean").isNull(), failure.cast("double")).otherwise(F.col("dt_mean"))
        )
    return joined.select(
        "file", "samples", "duration_seconds", "dt_mean", "dt_std", "fs_mean", "fs_std", "fs_median"
    )


def aggregate_sampling(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.count(F.lit(1)).alias("dataset_count"),
        F.avg("fs_mean").alias("avg_sampling_frequency_hz"),
        F.avg("fs_std").alias("std_sampling_frequency_hz"),
        F.avg("dt_mean").alias("avg_dt_seconds"),
    )


def target_sampling_rate(metrics: DataFrame) -> DataFrame:
    """Median over recordings of their median rate, to 3 decimals (half to even, as in Python)."""
    return exact_median(metrics, [], "fs_median", "_rate").select(
        F.bround("_rate", 3).alias("target_sampling_rate_hz")
    )


def build_config(
    rate: DataFrame,
    window_seconds: float = 1.0,
    overlap: float = 0.5,
    low_cutoff_hz: float | None = None,
    upper_cutoff: str = "capped",
) -> DataFrame:
    """The signal configuration as one row, from the one-row result of ``target_sampling_rate``.

    ``upper_cutoff`` picks the upper band edge: "capped" is min(fs/2-1, 500), "floored" is
    max(1, fs/2-1). Without ``low_cutoff_hz`` there is no filter.
    """
    fs = F.col("target_sampling_rate_hz")
    size = (fs * F.lit(window_seconds)).cast("int")
    edges = {
        "capped": F.bround(F.least(fs / 2 - 1, F.lit(500.0)), 3),
        "floored": F.greatest(F.lit(1.0), F.bround(fs / 2 - 1, 3)),
    }
    filtered = low_cutoff_hz is not None
    cutoff = F.array(F.lit(float(low_cutoff_hz)), edges[upper_cutoff]) if filtered else F.lit(None)
    return rate.select(
        fs,
        size.alias("window_size_samples"),
        F.lit(float(overlap)).alias("window_overlap"),
        F.lit("bandpass" if filtered else "none").alias("filtering_method"),
        F.lit(4).alias("filter_order"),
        cutoff.cast("array<double>").alias("filter_cutoff_hz"),
        F.lit("per_window_standardization").alias("normalization"),
        F.lit("mean_subtraction").alias("detrending"),
        F.lit("hann").alias("stft_window"),
        F.least(size, F.lit(256)).alias("stft_window_size"),
        F.lit(0.75).alias("stft_overlap"),
    )


def config_from_row(row) -> SignalConfig:
    return SignalConfig.from_dict(row.asDict())


def _missing(column: str = "x") -> Column:
    return F.col(column).isNull() | F.isnan(column)


def _missing_columns() -> list[Column]:
    missing = F.count_if(_missing())
    return [missing.alias("missing_count"), (missing / F.count(F.lit(1))).alias("missing_ratio")]


def missing_stats(long: DataFrame) -> DataFrame:
    return long.groupBy("file", "channel").agg(*_missing_columns())


def mad_outliers(long: DataFrame, threshold: float = 3.5, **median) -> DataFrame:
    """Values whose modified z-score exceeds the threshold; the ratio is over all rows.

    A score that is not a number (an infinite value at an infinite median) exceeds nothing, and a channel
    whose deviations have no positive median has no outliers.
    """
    keys = ["file", "channel"]
    values = long.select(*keys, F.when(~_missing(), F.col("x")).alias("x"))
    centre = cut(exact_median(values, keys, "x", "_med", **median))
    away = null_safe_join(values, centre, keys, "left").withColumn("_away", F.abs(F.col("x") - F.col("_med")))
    scale = cut(exact_median(away, keys, "_away", "_mad", **median))
    z = F.when(F.col("_mad") > 0, F.lit(0.6745) * F.col("_away") / F.col("_mad"))
    counted = null_safe_join(away, scale, keys, "left").groupBy(*keys).agg(
        F.count_if(~F.isnan(z) & (z > threshold)).alias("outlier_count"),
        F.count(F.lit(1)).alias("_rows"))
    return counted.select(*keys, "outlier_count", (F.col("outlier_count") / F.col("_rows")).alias("outlier_ratio"))


def flatline_runs(
    long: DataFrame, tolerance: float = 1e-4, min_diffs: int = 60, rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Runs of nearly equal neighbours after filling gaps forwards, then backwards.

    A missing sample repeats the value before it (or, at the start, the first value present), so its
    step is flat; a step between two values is flat when it is below the tolerance. Runs are found
    by numbering the steps that are not flat.
    """
    keys = ["file", "channel"]
    values = long.select(*keys, "i", F.when(~_missing(), F.col("x")).alias("x"))
    filled = carry_last(values, keys, "i", {"_before": F.col("x")}, inclusive=False, rows=rows)
    step = F.abs(F.col("x") - F.col("_before"))
    flat = F.col("x").isNull() | F.col("_before").isNull() | (step < tolerance)
    steps = filled.withColumn("_flat", F.when(F.col("i") > 0, flat).otherwise(False))
    numbered = running_sum(
        steps, keys, "i", {"_run": F.when(F.col("_flat"), 0).otherwise(1)}, rows=rows
    )
    runs = numbered.groupBy(*keys, "_run").agg(
        F.count_if("_flat").alias("_length"), F.count("x").alias("_present")
    )
    long_enough = F.col("_length") >= min_diffs
    found = runs.groupBy(*keys).agg(
        F.count_if(long_enough).alias("_segments"),
        F.max(F.when(long_enough, F.col("_length") + 1)).alias("_longest"),
        F.sum("_present").alias("_present"),
    )
    any_value = F.col("_present") > 0  # a channel without values has no flat run
    return found.select(
        *keys,
        F.when(any_value, F.col("_segments")).otherwise(0).alias("flatline_segments"),
        F.when(any_value, F.coalesce("_longest", F.lit(0))).otherwise(0).cast("bigint")
        .alias("flatline_longest_samples"),
    )


def _slope() -> Column:
    finite = ~_missing() & (F.abs("x") < float("inf")) & F.col("ts").isNotNull()
    seconds = seconds_between(F.col("ts"), F.col("_start"))
    return F.coalesce(F.regr_slope(F.when(finite, F.col("x")), F.when(finite, seconds)), F.lit(0.0))


def _with_start(long: DataFrame) -> DataFrame:
    return null_safe_join(long, cut(long.groupBy("file").agg(F.min("ts").alias("_start"))), ["file"])


def drift_slope(long: DataFrame, threshold: float = 5e-4) -> DataFrame:
    """Least-squares slope per second over finite values, with time measured from the recording's start."""
    return _with_start(long).groupBy("file", "channel").agg(
        _slope().alias("drift_slope_per_sec"), (F.abs(_slope()) > threshold).alias("drift_flag"))


def quality_report(long: DataFrame, limits: QualityThresholds = QualityThresholds()) -> DataFrame:
    """The eight statistics of every (recording, channel).

    Missing values and drift share one aggregation without a shuffle of rows; the medians of the outliers
    shuffle only counts; flat runs shuffle rows once, by pieces.
    """
    keys = ["file", "channel"]
    plain = _with_start(long).groupBy(*keys).agg(
        *_missing_columns(), _slope().alias("drift_slope_per_sec"),
        (F.abs(_slope()) > limits.drift_slope).alias("drift_flag"))
    outliers = null_safe_join(plain, mad_outliers(long, limits.mad_z), keys)
    return (
        null_safe_join(outliers, flatline_runs(long, limits.flat_tolerance, limits.flat_min_diffs), keys)
        .select(*keys, "missing_count", "missing_ratio", "outlier_count", "outlier_ratio", "flatline_segments",
                "flatline_longest_samples", "drift_slope_per_sec", "drift_flag")
    )


def quality_flags(report: DataFrame) -> DataFrame:
    """One row per raised flag: the kind, and ``file::channel``.

    Rows, not one list per kind: the list would grow with the number of recordings.
    """
    kinds = F.array_compact(F.array(
        F.when(F.col("missing_count") > 0, F.lit("missing_data")),
        F.when(F.col("outlier_count") > 0, F.lit("outliers")),
        F.when(F.col("flatline_segments") > 0, F.lit("flatlines")),
        F.when(F.col("drift_flag"), F.lit("drift")),
    ))
    return report.select(
        F.explode(kinds).alias("flag"),
        F.concat_ws("::", F.col("file").cast("string"), "channel").alias("item"),
    )
