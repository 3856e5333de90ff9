"""All queries of the report-estate operators and the SQL of those that SQL can express."""

from __future__ import annotations

from reportweave.plans import catalog_queries, graph_queries, match_queries, more_queries, pair_queries, review_queries, text_queries

_ALL = {**pair_queries.QUERIES, **text_queries.QUERIES, **match_queries.QUERIES, **review_queries.QUERIES, **more_queries.QUERIES, **catalog_queries.QUERIES, **graph_queries.QUERIES}
QUERIES = {name: run for name, (run, _) in _ALL.items()}
ORACLE = {name: sql for name, (_, sql) in _ALL.items() if sql}
