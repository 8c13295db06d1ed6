"""Registered queries (one per SURVEY §2 operator or operator family)."""

from . import feature_queries, fleet_queries, model_queries, quality_queries, source_queries, stream_queries  # noqa: F401,E501
from . import robust_queries  # noqa: F401
from .registry import REGISTRY, Query, conform, register, wrap_sql

__all__ = ["REGISTRY", "Query", "conform", "register", "wrap_sql"]
