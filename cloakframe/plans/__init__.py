"""Registered queries and the SQL they are compared with."""

from . import data_queries, detect_queries, round_trip_queries, scalar_queries, store_queries, vault_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
