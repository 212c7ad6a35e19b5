"""Registered queries over the given tables."""

from loadspark.catalog import model_queries, series_queries, source_queries, table_queries  # noqa: F401
from loadspark.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
