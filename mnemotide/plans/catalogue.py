"""Every query by name, and its DuckDB SQL."""

from __future__ import annotations

from . import composed, filters, intake, memory, places, sequences, views, writes  # noqa: F401  modules register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
