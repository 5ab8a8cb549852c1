"""Registered queries: a name, a function of (tables), and the oracle's SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.plans.bindings import Tables, oracle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str, rounded: tuple[str, ...] = ()):
    """Register a function of Tables under a name, with SQL over the same views for DuckDB. Means of
    doubles, whose last digits depend on the order of addition, are rounded in both."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in rounded})
        if sql:
            text = oracle(sql, *views)
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in rounded)}) FROM ({text})" if rounded else text
        return build

    return register
