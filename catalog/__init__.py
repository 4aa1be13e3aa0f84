"""Queries over the driver tables, each with the SQL that must give the same rows where SQL can.

``QUERIES`` maps a name to (function of session and table folder, SQL text or None).
"""

from catalog import (
    aggregate_queries,
    check_queries,
    column_queries,
    join_queries,
    lineage_queries,
    profile_queries,
    reshape_queries,
    rule_queries,
    source_queries,
    table_queries,
    window_queries,
)

QUERIES = {}
for _module in (
    source_queries, column_queries, join_queries, aggregate_queries, profile_queries,
    window_queries, reshape_queries, rule_queries, table_queries, check_queries, lineage_queries,
):
    QUERIES.update(_module.QUERIES)
