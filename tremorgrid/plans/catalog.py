"""All registered queries."""

from __future__ import annotations

from tremorgrid.plans import (  # noqa: F401
    catalog_models,
    catalog_predictions,
    catalog_quality,
    catalog_signals,
    catalog_streams,
)
from tremorgrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
