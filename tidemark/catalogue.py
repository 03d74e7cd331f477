"""All queries of the interval and text library, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from .plans import queries_catalog, queries_curves, queries_fit, queries_intervals, queries_joins, queries_more, queries_sources, queries_text

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (queries_intervals, queries_curves, queries_text, queries_catalog, queries_more, queries_joins, queries_fit, queries_sources):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
