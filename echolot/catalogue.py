"""Name of each registered query: the Spark callable, and the SQL that must give the same rows."""

from __future__ import annotations

from .plans import duplicate, evaluation, frequency, lookup, report  # noqa: F401  (they register their queries)
from .plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
