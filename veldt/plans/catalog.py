"""The engine's queries over the test tables, by name, and their SQL."""

from __future__ import annotations

from . import feature_queries, index_queries, metric_queries, model_queries, sequence_queries, source_queries

FLAGSHIP = "grouped_auc"
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for part in (feature_queries, metric_queries, index_queries, model_queries, sequence_queries, source_queries):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL
