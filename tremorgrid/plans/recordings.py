"""The batch jobs: verify recordings, extract features, build window datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorgrid.functions.expressions import encode_label
from tremorgrid.operators import quality
from tremorgrid.operators.features import clean_features, describe_windows
from tremorgrid.operators.joins import group_ids
from tremorgrid.operators.ordered import null_safe_join
from tremorgrid.operators.signals import (
    bandpass_filter, resample_wide, stft_spectrogram, window_signal,
)
from tremorgrid.session import cut
from tremorgrid.settings import CHANNELS, QualityThresholds, SignalConfig


def verify_recordings(
    recordings: DataFrame, channels=CHANNELS, limits: QualityThresholds = QualityThresholds()
) -> dict[str, DataFrame]:
    """Sampling metrics, quality report and flags, and the signal configuration they suggest."""
    metrics = cut(quality.sampling_metrics(recordings))
    report = cut(quality.quality_report(quality.unpivot_channels(recordings, channels), limits))
    rate = cut(quality.target_sampling_rate(metrics))
    return {
        "sampling": metrics, "aggregate": quality.aggregate_sampling(metrics), "quality": report,
        "flags": quality.quality_flags(report),
        "config": quality.build_config(rate, low_cutoff_hz=1.0, upper_cutoff="capped"),
    }


def resampled(recordings: DataFrame, config: SignalConfig, channels=CHANNELS) -> DataFrame:
    """Recordings on the even grid; a sample some channel cannot give is left out with all channels."""
    return resample_wide(recordings, config.target_sampling_rate_hz, list(channels))


def window_features(recordings: DataFrame, config: SignalConfig, channels=CHANNELS) -> DataFrame:
    """Resample, cut windows (unfiltered) and describe them: 21 features per channel."""
    labels = cut(recordings.select("file", "label").distinct())
    windows = window_signal(
        resampled(recordings, config, channels), list(channels), config.window_size_samples, config.window_overlap)
    features = describe_windows(
        windows.drop("window_offset"), config.target_sampling_rate_hz, channels, config.stft_window_size,
        keep=["file", "window_index"])
    return clean_features(null_safe_join(features, labels, ["file"]))


def window_dataset(
    recordings: DataFrame,
    config: SignalConfig,
    channels=CHANNELS,
    binary: bool = False,
    lenient: bool = False,
    n_fft: int | None = None,
    overlap: float | None = None,
) -> DataFrame:
    """Resample, filter, cut windows and add spectrogram, class code and group id."""
    labels = cut(recordings.select("file", "label").distinct())
    even = resampled(recordings, config, channels)
    filtered = bandpass_filter(
        even, config.target_sampling_rate_hz, list(channels), config.filtering_method, config.filter_cutoff_hz,
        config.filter_order)
    # Written once: the group ids and the result both read the windows.
    windows = cut(window_signal(filtered, list(channels), config.window_size_samples, config.window_overlap))
    with_spectrum = stft_spectrogram(
        windows, list(channels), n_fft or config.stft_window_size,
        config.stft_overlap if overlap is None else overlap)
    coded = null_safe_join(with_spectrum, labels, ["file"]).withColumn("y", encode_label(F.col("label"), binary, lenient))
    return group_ids(coded)
