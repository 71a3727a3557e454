"""Registered queries: name, Spark function, comparison SQL and survey id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, ids, fn, sql)
        return fn

    return add


def r(x: str | Column, n: int = 4) -> Column:
    """Round for comparison with plain arithmetic (``round`` goes through decimals and is far slower).

    The nudge keeps averages of cents off exact ties.
    """
    x = F.col(x) if isinstance(x, str) else x
    scale = F.lit(float(10**n))
    return F.floor((x.cast("double") + F.lit(1e-7)) * scale + F.lit(0.5)) / scale


def R(x: str, n: int = 4) -> str:
    return f"(floor((CAST({x} AS DOUBLE) + 1e-7) * 1e{n} + CAST(0.5 AS DOUBLE)) / 1e{n})"


def rs(df: DataFrame, cols, n: int = 4) -> DataFrame:
    return df.withColumns({x: r(x, n) for x in cols})


def load() -> dict[str, Query]:
    from . import (  # noqa: F401
        aggregate_queries,
        encoding_queries,
        entity_queries,
        join_queries,
        metric_queries,
        model_queries,
        quality_queries,
        row_queries,
        store_queries,
        window_queries,
    )

    return QUERIES
