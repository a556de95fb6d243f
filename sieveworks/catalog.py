"""Every query of the library by name, and the SQL that DuckDB checks it with."""

from __future__ import annotations

from .operators import caching, exact, folders, library, similar
from .plans import review

_MODULES = (exact, folders, similar, library, caching, review)

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
