"""Registered queries: Spark plans plus their DuckDB oracle SQL."""

from roadflow.plans.catalog import ORACLE, QUERIES, register  # noqa: F401
from roadflow.plans import (  # noqa: F401,E402  (import registers the queries)
    q_checks, q_evaluate, q_features, q_models, q_ordering, q_profiles, q_quality, q_scenario, q_trees,
)
