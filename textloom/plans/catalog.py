"""All queries of the analytics engine and their DuckDB equivalents."""

from . import annotation_queries, capture_queries, graph_queries, holdings_queries, index_queries, integrity_queries, manifest_queries, position_queries, record_queries, request_queries, retrieval_queries, route_queries, search_queries, section_queries, text_queries, version_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "bm25_topk_documents"
