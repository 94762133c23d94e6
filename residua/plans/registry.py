"""All core queries and their SQL counterparts."""

from __future__ import annotations

from residua.plans import detector_queries, feature_queries, pipeline_queries, problems, report_queries

_MODULES = (problems, detector_queries, feature_queries, report_queries, pipeline_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
