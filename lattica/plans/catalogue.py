"""The query catalogue on the shared tables: name -> query, name -> DuckDB SQL."""

from . import event_queries, graph_queries, index_queries, log_queries, memory_queries, node_queries, retrieval_queries, source_queries, surface_queries

_PARTS = [retrieval_queries, memory_queries, graph_queries, event_queries, surface_queries, node_queries, source_queries, log_queries, index_queries]
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
