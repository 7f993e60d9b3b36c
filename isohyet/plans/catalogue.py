"""All named queries of the analytic operators, with their SQL."""

from __future__ import annotations

from . import atmosphere, climate, dynamics, fields, files, inference, panel, patterns, quality, regions, regressors, seasons, series, storms, strategies, streams, tables, trading  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
