"""All queries of the library's own operators, with their DuckDB counterparts."""

from __future__ import annotations

from . import learned, mixed, models, relational, statistics, validation, words  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
