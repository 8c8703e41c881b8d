"""All queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from . import coerce, layout, lists, merge, names, progress, stores, streams  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
