"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import geometry_queries, page_queries

QUERIES = geometry_queries.R.queries | page_queries.R.queries
ORACLES = geometry_queries.R.oracles | page_queries.R.oracles
