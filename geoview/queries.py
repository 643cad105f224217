"""Registry of queries over the supplied tables and of the SQL that they equal."""

from __future__ import annotations

from .plans import scenes  # noqa: F401  registers its queries
from .plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
