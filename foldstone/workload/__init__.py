"""Registered queries over the driver tables, each with its SQL twin where SQL can say it."""

from foldstone.workload import (  # noqa: F401
    feature_queries,
    model_queries,
    profile_queries,
    score_queries,
)
from foldstone.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
