"""Registering a query together with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[[str], Callable[[Query], Query]]]:
    """(queries, oracles, decorator): the decorator takes the oracle's SQL, empty where there is none."""
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}

    def query(sql: str = "") -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return keep

    return queries, oracles, query


#: 32 bits of MD5 of 'seed:key' as a number, in DuckDB.
def hash_sql(seed: str, key: str) -> str:
    return f"CAST('0x' || substr(md5({seed} || ':' || {key}), 1, 8) AS BIGINT)"
