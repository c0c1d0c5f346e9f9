"""Queries over the given tables, one module per area."""

from feedmill.registry import checks, chunking, exports, files, functions, lines, state  # noqa: F401
from feedmill.registry.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
