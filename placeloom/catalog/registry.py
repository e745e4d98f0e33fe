"""Registration of queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from placeloom.sources.derived import Tables, cte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
FLAT_SQL: list[str] = []  # shared CTE text of the visit rows


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register fn(Tables) under a name; `sql` is the check text, `uses` the derived tables it needs."""

    def wrap(fn):
        def run(spark, folder):
            return fn(Tables(spark, folder))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            body = sql.strip().replace("WITH FLAT_MARK", "WITH " + FLAT_SQL[0]) if FLAT_SQL else sql.strip()
            recursive = "RECURSIVE_MARK" in body
            body = body.replace("WITH RECURSIVE_MARK", "WITH")
            if uses:
                head = cte(*uses.split())
                # the check may bring further CTEs of its own
                body = head + ", " + body[4:].lstrip() if body[:4].upper() == "WITH" else head + "\n" + body
            CHECKS[name] = body.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else body
        return fn

    return wrap
