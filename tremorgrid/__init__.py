"""Condition-monitoring analytics on sensor time series, expressed as Spark jobs."""

from tremorgrid.session import build_session
from tremorgrid.settings import (
    CHANNELS,
    TIMESTAMP_COLUMN,
    QualityThresholds,
    SignalConfig,
)

__all__ = ["CHANNELS", "TIMESTAMP_COLUMN", "QualityThresholds", "SignalConfig", "build_session"]
