"""Registered queries by name."""

from galeframe.plans import (  # noqa: F401
    document_queries,
    grid_queries,
    run_queries,
    stream_queries,
    track_queries,
)
from galeframe.plans.registry import QUERIES

__all__ = ["QUERIES"]
