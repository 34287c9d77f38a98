"""All registered queries of the library, by name: the query on the fixture tables and its equivalent in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL if there is one."""

    def keep(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _all() -> None:
    from heddle.plans import cleaning, corpus, discovery, exports, flows, hierarchy, increments, mining, observation, quality, relational, retrieval, routine, search, series, sources, texts, trained, words  # noqa: F401


def queries() -> dict[str, Callable]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
