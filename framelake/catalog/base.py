"""Registry of the checked queries: a Spark callable and, where it exists, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.catalog.views import SQL_VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str, views: tuple[str, ...]) -> str:
    body = sql.strip()
    if not views:
        return body
    head = ", ".join(f"{name} AS ({SQL_VIEWS[name]})" for name in views)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] | str = ()) -> Callable[[Query], Query]:
    used = (views,) if isinstance(views, str) else views

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, used)
        return fn

    return register
