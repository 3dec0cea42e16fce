"""Registry of the core queries and their DuckDB counterparts."""
from __future__ import annotations

from ..operators import timestamps
from . import analysis_queries, corpus_queries, inventory_queries, source_queries

QUERIES = {**corpus_queries.Q, **analysis_queries.Q, **inventory_queries.Q, **source_queries.Q, **timestamps.QUERIES}
ORACLES: dict[str, str] = {**corpus_queries.O, **analysis_queries.O, **inventory_queries.O, **source_queries.O}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


def flagship(spark, sf):
    """Documents to sentences to filters to labels to scores to means per context, in one plan."""
    return QUERIES["context_means"](spark, sf)
