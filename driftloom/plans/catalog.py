"""All queries of the library and their DuckDB twins, by name."""

from __future__ import annotations

from . import blocks, concepts, drifts, models, streams, summaries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
