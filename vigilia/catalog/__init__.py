"""Queries over the given tables: each registers a Spark callable and, where SQL can say it, the same in SQL."""

from .registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
