"""All registered queries and their SQL twins."""

from __future__ import annotations

from catalogmatch.plans import catalog_queries, log_queries, matching_queries, vision_queries

_PARTS = (catalog_queries, vision_queries, matching_queries, log_queries)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
