"""Where queries register themselves, each with the SQL that gives the same rows where SQL can."""
from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, **types: str):
    """Registers a function (spark, sf_dir) -> DataFrame under its name; types: the SQL's columns that need a cast."""
    if sql and types:
        sql = f"select * replace ({', '.join(f'cast({c} as {t}) as {c}' for c, t in types.items())}) from ({sql})"

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
