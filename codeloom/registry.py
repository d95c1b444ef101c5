"""The registry of queries and of their DuckDB twins."""

from __future__ import annotations

from codeloom.views import Views, duck

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a function of the views under its name, with its DuckDB twin over the named views."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = duck(sql, *views) if views else sql
        return f

    return keep
