"""All registered queries of the panel engine and their oracles."""

from __future__ import annotations

from . import source_queries  # noqa: F401  registers its queries
from .oracles import SQL as PANEL_SQL
from .queries import QUERIES
from .source_oracles import SQL as SOURCE_SQL

SQL = {**PANEL_SQL, **SOURCE_SQL}
__all__ = ["QUERIES", "SQL"]
