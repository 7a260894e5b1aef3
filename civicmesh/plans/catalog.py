"""Registered queries of the signal engine and their DuckDB texts."""

from __future__ import annotations

from . import aggregates, changes, lookups, retrieval, scalars, vectors, writes  # noqa: F401  each registers its own
from .registry import ORACLES, QUERIES  # noqa: F401
