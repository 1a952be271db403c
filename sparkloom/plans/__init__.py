"""Named queries; importing this package registers them."""

from . import content_queries, contract_queries, event_queries, graph_queries, impact_queries, measure_queries, parse_queries, relation_queries, resolution_queries, retrieval_queries, rule_queries, scan_queries, search_queries, source_queries, stream_queries, table_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "content_queries", "contract_queries", "event_queries", "graph_queries", "impact_queries", "measure_queries", "parse_queries", "relation_queries", "resolution_queries", "retrieval_queries", "rule_queries", "scan_queries", "search_queries", "source_queries", "stream_queries", "table_queries"]
