"""Whole analyses, and the queries over the star-schema tables."""

from . import catalog_queries, field_queries, kernel_queries, map_queries, spike_queries, track_queries  # noqa: F401
from .proxies import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
