"""All queries of the core library and their SQL."""

from __future__ import annotations

from lithoframe.plans import display_queries, line_queries, panel_queries, prestack_queries, problem_queries, sample_queries, segy_queries

FLAGSHIP = "fold_bins"
_MODULES = (prestack_queries, line_queries, sample_queries, panel_queries, display_queries, problem_queries, segy_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
