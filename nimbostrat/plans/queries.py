"""All queries of the library."""

from __future__ import annotations

from nimbostrat.plans import column_queries, frame_queries, grid_queries, inventory_queries, profile_queries, render_queries, selection_queries, series_queries  # noqa: F401  (they register)
from nimbostrat.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
