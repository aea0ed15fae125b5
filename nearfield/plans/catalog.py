"""All queries of the core library, by name."""

from __future__ import annotations

from nearfield.plans import core_problems, curve_queries, join_queries, kernel_queries, pipeline_queries, split_queries, workflow_queries

_PARTS = (core_problems, kernel_queries, join_queries, curve_queries, split_queries, pipeline_queries, workflow_queries)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
