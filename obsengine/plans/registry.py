"""The queries of the library's own operators, by name, and the SQL that must agree with them."""

from __future__ import annotations

from obsengine.plans import join_queries, measure_queries, plane_queries, profile_queries, review_queries, rule_queries, sequence_queries, text_queries

MODULES = (sequence_queries, join_queries, text_queries, measure_queries, review_queries, rule_queries, plane_queries, profile_queries)
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for module in MODULES:
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
