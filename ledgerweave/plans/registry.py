"""All queries of the library, without those of subpackages that may be left out."""

from __future__ import annotations

from ledgerweave.plans import delivery_queries, file_queries, match_queries, projection_queries, report_queries, source_queries, text_queries, tree_queries

MODULES = (tree_queries, projection_queries, match_queries, text_queries, delivery_queries, source_queries, file_queries, report_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
