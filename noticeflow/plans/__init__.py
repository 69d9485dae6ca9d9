"""Queries of the library's operators over given tables."""

from . import landed, more, rest  # noqa: F401  register their queries
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
