"""How queries and their oracle SQL are registered."""

from __future__ import annotations

from ctxloom.sources.tables import Tables, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(Tables) -> DataFrame under a name, with DuckDB SQL over the same tables and views."""

    def add(f):
        def run(spark, sf_dir):
            return f(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return f

    return add
