"""Registered queries over the given tables, each with its SQL where there is one."""

from tunestrata.plans import (  # noqa: F401
    metric_queries,
    model_queries,
    profile_queries,
    source_queries,
    training_queries,
)
from tunestrata.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
