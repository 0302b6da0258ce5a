"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query, and the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# The modules register their queries as they are imported.
from factloom.plans import jobs, relational, scalars, structures, validation  # noqa: E402, F401
