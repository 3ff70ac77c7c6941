"""All queries of the evaluation and analysis operators, with their DuckDB equivalents."""

from __future__ import annotations

from . import analysis_queries, evaluation_queries, prompt_queries, scoring_queries, source_queries

_PARTS = (analysis_queries, evaluation_queries, prompt_queries, scoring_queries, source_queries)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
