"""Registered queries and the plain SQL that checks them."""

from .registry import QUERIES, SQL

from . import (  # noqa: F401  (importing registers the queries)
    audit_queries, evidence_queries, extract_queries, findings_queries, function_queries, graph_queries,
    merge_queries, policy_queries, source_queries, stream_queries, text_queries, tree_queries, wireless_queries,
)

__all__ = ["QUERIES", "SQL"]
