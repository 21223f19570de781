"""All registered queries of the engine: name -> callable, and SQL where it can say the same.

"""

from __future__ import annotations

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


def _load() -> None:
    from . import chunk_queries, relational_queries, search_queries, state_queries, table_queries, text_queries  # noqa: F401


def queries() -> dict:
    _load()
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in QUERIES.items() if v[1]}
