"""Registers queries: a function of Tables, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, lists: tuple[str, ...] = ()) -> Callable:
    """lists: columns that hold lists, compared as text joined by commas."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(Tables(spark, sf_dir))
            return out.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in lists}) if lists else out

        run.__name__ = run.__qualname__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql:
            joined = ", ".join(f"array_to_string({c}, ',') AS {c}" for c in lists)
            ORACLES[name] = f"SELECT * REPLACE ({joined}) FROM ({oracle(sql)})" if lists else oracle(sql)
        return fn

    return register
