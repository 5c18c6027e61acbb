"""All queries and their SQL."""

from __future__ import annotations

from . import events, fields, grids, models, outlooks, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
