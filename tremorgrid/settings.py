"""Channel names, thresholds and the signal configuration."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import types as T

# The sensor's column names, in recording order.
CHANNELS = (
    "Acceleration X(g)",
    "Acceleration Y(g)",
    "Acceleration Z(g)",
    "Angular velocity X(°/s)",
    "Angular velocity Y(°/s)",
    "Angular velocity Z(°/s)",
)
TIMESTAMP_COLUMN = "Chip Time()"

# Class codes.
CLASS_CODES = {"good": 0, "moderate": 1, "bad": 2}
BINARY_CODES = {"good": 0, "moderate": 1, "bad": 1}


def slug(channel: str) -> str:
    """Column-name form of a channel name; the plan-time twin of ``channel_slug``."""
    text = channel.lower()
    for old, new in SLUG_REPLACEMENTS:
        text = text.replace(old, new)
    return text


# Replacements, in order, that turn a channel name into a column name.
SLUG_REPLACEMENTS = (
    ("(°/s)", "dps"),
    ("(g)", "g"),
    (" ", "_"),
    ("(", ""),
    (")", ""),
    ("/", "_"),
)


@dataclass(frozen=True)
class QualityThresholds:
    mad_z: float = 3.5
    flat_min_diffs: int = 60
    flat_tolerance: float = 1e-4
    drift_slope: float = 5e-4


@dataclass(frozen=True)
class SignalConfig:
    target_sampling_rate_hz: float
    window_size_samples: int
    window_overlap: float = 0.5
    filtering_method: str = "none"
    filter_order: int = 4
    filter_cutoff_hz: tuple[float, ...] | None = None
    normalization: str = "per_window_standardization"
    detrending: str = "mean_subtraction"
    stft_window: str = "hann"
    stft_window_size: int = 256
    stft_overlap: float = 0.75

    def as_dict(self) -> dict:
        values = asdict(self)
        if self.filter_cutoff_hz is not None:
            values["filter_cutoff_hz"] = list(self.filter_cutoff_hz)
        return values

    @classmethod
    def from_dict(cls, values: dict) -> "SignalConfig":
        known = {name: values[name] for name in cls.__dataclass_fields__ if name in values}
        if known.get("filter_cutoff_hz") is not None:
            known["filter_cutoff_hz"] = tuple(known["filter_cutoff_hz"])
        return cls(**known)

    def to_json(self) -> str:
        return json.dumps(self.as_dict(), indent=2)


CONFIG_SCHEMA = T.StructType([
    T.StructField("target_sampling_rate_hz", T.DoubleType()),
    T.StructField("window_size_samples", T.IntegerType()),
    T.StructField("window_overlap", T.DoubleType()),
    T.StructField("filtering_method", T.StringType()),
    T.StructField("filter_order", T.IntegerType()),
    T.StructField("filter_cutoff_hz", T.ArrayType(T.DoubleType())),
    T.StructField("normalization", T.StringType()),
    T.StructField("detrending", T.StringType()),
    T.StructField("stft_window", T.StringType()),
    T.StructField("stft_window_size", T.IntegerType()),
    T.StructField("stft_overlap", T.DoubleType()),
])
