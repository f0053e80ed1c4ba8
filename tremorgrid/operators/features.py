"""Features of signal windows (one ``ARRAY<DOUBLE>`` column per channel)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorgrid.functions import kernels
from tremorgrid.functions.vectorized import (
    describe_udf, dwt_udf, freq_udf, packet_udf, periodogram_udf, serving_udf,
)
from tremorgrid.operators.ordered import median_of_sorted
from tremorgrid.session import cut
from tremorgrid.settings import CHANNELS, slug

META_COLUMNS = ("file", "label", "window_index", "label_id")

# The features the streaming model is trained and served on, in vector order.
TOP20 = (
    "acceleration_yg_wpd_wpd_energy_lvl3_node0",
    "acceleration_yg_freq_spectral_energy",
    "acceleration_yg_freq_band_power_low",
    "acceleration_yg_time_rms",
    "acceleration_zg_freq_spectral_energy",
    "acceleration_zg_time_rms",
    "acceleration_yg_time_mean",
    "acceleration_zg_freq_band_power_low",
    "acceleration_zg_wpd_wpd_energy_lvl3_node0",
    "acceleration_zg_time_crest_factor",
    "acceleration_zg_time_mean",
    "angular_velocity_ydps_time_mad",
    "acceleration_zg_time_skewness",
    "acceleration_zg_time_std",
    "angular_velocity_zdps_wpd_wpd_energy_lvl3_node4",
    "angular_velocity_ydps_time_rms",
    "angular_velocity_ydps_time_std",
    "acceleration_zg_time_mad",
    "acceleration_zg_wpd_wpd_energy_lvl3_node1",
    "angular_velocity_ydps_wpd_wpd_energy_lvl3_node4",
)


def _fold(window: Column, term) -> Column:
    return F.aggregate(window, F.lit(0.0), lambda total, v: total + term(v))


def time_features(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Seven shape statistics; skewness and kurtosis are bias-corrected, mad is the mean deviation.

    Windows too short for a corrected moment give null; windows without variance give 0.
    """
    x = F.col(f"`{column}`")
    n = F.size(x).cast("double")
    staged = df.withColumn("_mean", _fold(x, lambda v: v) / n)
    mean = F.col("_mean")
    staged = staged.select(
        "*",
        (_fold(x, lambda v: v * v) / n).alias("_sq"),
        (_fold(x, lambda v: F.abs(v - mean)) / n).alias("_mad"),
        (_fold(x, lambda v: F.pow(v - mean, F.lit(2))) / n).alias("_m2"),
        (_fold(x, lambda v: F.pow(v - mean, F.lit(3))) / n).alias("_m3"),
        (_fold(x, lambda v: F.pow(v - mean, F.lit(4))) / n).alias("_m4"),
        F.array_max(F.transform(x, F.abs)).alias("_peak"),
    )
    rms, m2 = F.sqrt("_sq"), F.col("_m2")
    flat = m2 < 1e-14
    g1, g2 = F.col("_m3") / F.pow(m2, F.lit(1.5)), F.col("_m4") / (m2 * m2) - 3
    skew = F.when(n < 3, None).when(flat, 0.0).otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n < 4, None).when(flat, 0.0).otherwise(
        (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    )
    features = (mean, F.sqrt(m2), rms, F.col("_mad"), skew, kurt, F.col("_peak") / (rms + 1e-12))
    return staged.select(
        *df.columns, *[value.alias(f"{prefix}{name}") for value, name in zip(features, kernels.TIME_NAMES)]
    )


def freq_features(df: DataFrame, column: str, fs: float, fft_size: int | None = 1024, prefix: str = "") -> DataFrame:
    staged = df.withColumn("_f", freq_udf(fs, fft_size)(F.col(f"`{column}`")))
    return staged.select(*df.columns, *[F.col(f"_f.{n}").alias(f"{prefix}{n}") for n in kernels.FREQ_NAMES])


def wpd_energy(df: DataFrame, column: str, name: str = "wpd_energy") -> DataFrame:
    """Energies of the 8 level-3 wavelet-packet nodes."""
    return df.withColumn(name, packet_udf()(F.col(f"`{column}`")))


def describe_windows(
    df: DataFrame, fs: float, channels=CHANNELS, fft_size: int | None = 1024, keep: list[str] | None = None
) -> DataFrame:
    """21 features for every channel, named ``{channel slug}_{time|freq|wpd}_{feature}``.

    Each channel is one Arrow UDF giving a struct; Spark evaluates all of them in one Python pass.
    """
    describe = describe_udf(fs, fft_size)
    keep = keep or [c for c in df.columns if c not in channels]
    staged = df.select(*keep, *[describe(F.col(f"`{c}`")).alias(f"_f{n}") for n, c in enumerate(channels)])
    names = (
        *[f"time_{name}" for name in kernels.TIME_NAMES],
        *[f"freq_{name}" for name in kernels.FREQ_NAMES],
        *[f"wpd_{name}" for name in kernels.WPD_NAMES],
    )
    return staged.select(*keep, *[
        F.col(f"_f{n}.{name}").alias(f"{slug(channel)}_{name}")
        for n, channel in enumerate(channels) for name in names
    ])


def top20_time(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """The serving-side statistics: population skewness, median absolute deviation, plain crest factor."""
    x = F.col(f"`{column}`")
    n = F.size(x).cast("double")
    staged = df.withColumn("_mean", _fold(x, lambda v: v) / n).withColumn("_mid", median_of_sorted(F.sort_array(x)))
    mean, mid = F.col("_mean"), F.col("_mid")
    staged = staged.select(
        "*",
        (_fold(x, lambda v: v * v) / n).alias("_sq"),
        (_fold(x, lambda v: F.pow(v - mean, F.lit(2))) / n).alias("_m2"),
        (_fold(x, lambda v: F.pow(v - mean, F.lit(3))) / n).alias("_m3"),
        F.sort_array(F.transform(x, lambda v: F.abs(v - mid))).alias("_away"),
        F.array_max(F.transform(x, F.abs)).alias("_peak"),
    )
    rms, m2 = F.sqrt("_sq"), F.col("_m2")
    features = {
        "rms": rms, "mean": mean, "std": F.sqrt(m2), "mad": median_of_sorted("_away"),
        "skewness": F.when(m2 < 1e-14, 0.0).otherwise(F.col("_m3") / F.pow(m2, F.lit(1.5))),
        "crest_factor": F.when(rms > 0, F.col("_peak") / rms).otherwise(0.0),
    }
    return staged.select(*df.columns, *[value.alias(f"{prefix}{name}") for name, value in features.items()])


def top20_periodogram(df: DataFrame, column: str, fs: float, low_hz: float = 2.5, prefix: str = "") -> DataFrame:
    staged = df.withColumn("_p", periodogram_udf(fs, low_hz)(F.col(f"`{column}`")))
    return staged.select(
        *df.columns, F.col("_p.energy").alias(f"{prefix}spectral_energy"),
        F.col("_p.low").alias(f"{prefix}band_power_low"),
    )


def top20_dwt(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Energies of the plain 3-level decomposition. Node 4 does not exist there and is always 0."""
    staged = df.withColumn("_d", dwt_udf()(F.col(f"`{column}`")))
    return staged.select(
        *df.columns, F.col("_d.node0").alias(f"{prefix}node0"), F.col("_d.node1").alias(f"{prefix}node1"),
        F.lit(0.0).alias(f"{prefix}node4"),
    )


def top20_features(df: DataFrame, fs: float, ay: str, az: str, wy: str) -> DataFrame:
    """The 20 serving features as columns, from the three channels they use, in one Python pass."""
    serve = serving_udf(fs)
    used = {"acceleration_yg": ay, "acceleration_zg": az, "angular_velocity_ydps": wy}
    staged = df.select("*", *[serve(F.col(f"`{c}`")).alias(f"_{name}") for name, c in used.items()])
    columns = []
    for feature in TOP20:
        if feature.endswith("node4"):  # does not exist in a 3-level decomposition
            columns.append(F.lit(0.0).alias(feature))
            continue
        channel = next(name for name in used if feature.startswith(name))
        columns.append(F.col(f"_{channel}.{feature.removeprefix(channel + '_')}").alias(feature))
    return staged.select(*df.columns, *columns)


def top20_vector(df: DataFrame, name: str = "features") -> DataFrame:
    """The serving features as one array in fixed order; the feature columns are dropped."""
    return df.withColumn(name, F.array(*TOP20)).drop(*TOP20)


def clean_features(df: DataFrame, meta=META_COLUMNS) -> DataFrame:
    """Infinities and NaN count as missing; features missing everywhere go, then rows with a missing value.

    ``v * 0`` is 0 exactly for finite values, so one sum tests a whole row. Where any row is
    complete no feature is missing everywhere, and the pass over single features is not needed.
    """
    features = [c for c in df.columns if c not in meta]
    known = [c for c in df.columns if c in meta]
    # Stored first: the features are computed once, and the optimiser does not restate the long
    # condition for every combination of the column aliases beneath it.
    stored = cut(df)

    def complete(columns: list[str]) -> DataFrame:
        zeros = sum((F.col(c) * 0.0 for c in columns), F.lit(0.0))
        rows = stored.select(*known, *columns).where(zeros == 0.0)
        return rows.na.drop("any", subset=known) if known else rows

    rows = complete(features)
    if not rows.isEmpty():
        return rows
    present = stored.agg(*[F.max(F.col(c) * 0.0 == 0.0).alias(c) for c in features]).first()
    return complete([c for c in features if present[c]])


def split_meta_features(df: DataFrame, subset=None, meta=META_COLUMNS) -> tuple[DataFrame, list[str]]:
    """The table with the metadata first and only the wanted features, and the feature names."""
    features = list(subset) if subset else [c for c in df.columns if c not in meta]
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return df.select(*[c for c in meta if c in df.columns], *features), features
