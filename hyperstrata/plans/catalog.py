"""All registered grid queries with their SQL, in the order they were declared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query ``f(spark, sf_dir)`` under its name with its SQL, if it has any."""

    def register(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, for comparison with engines that add in another order."""
    return df.select(*[_round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _round(c: Column, digits: int) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def _load() -> None:
    from hyperstrata.plans import (  # noqa: F401
        queries_bin,
        queries_extra,
        queries_figures,
        queries_flow,
        queries_frame,
        queries_kernel,
        queries_more,
        queries_moveout,
        queries_reduce,
        queries_resample,
        queries_seismic,
        queries_select,
        queries_shape,
        queries_small,
        queries_source,
        queries_wave,
    )


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
