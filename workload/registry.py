"""Registration of the check queries.

A query is a Spark function plus, where SQL can express it, a statement for the
same tables. Both sides are formatted by one column list such as
``"time:d lat value:6"``: ``d`` a date as text, ``t`` a timestamp as text, ``i`` a
64-bit integer, ``s`` text, ``b`` a flag, a number the digits kept of a double.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.scalars import tidy
from workload.oracle_views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def student_p(t: str, freedom: str) -> str:
    """SQL of the two-sided Student probability for whole degrees of freedom: a finite sum over powers of the cosine of atan(t / sqrt(freedom))."""
    angle = f"atan(abs({t}) / sqrt({freedom}))"
    odd = f"list_sum(list_transform(range(CAST(({freedom} - 1) // 2 AS BIGINT)), lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * pow(cos({angle}), 2 * k)))"
    even = f"list_sum(list_transform(range(CAST({freedom} // 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * pow(cos({angle}), 2 * k)))"
    inside = f"CASE WHEN {freedom} % 2 = 1 THEN 2 / pi() * ({angle} + sin({angle}) * cos({angle}) * coalesce({odd}, 0)) ELSE sin({angle}) * {even} END"
    return f"CASE WHEN {freedom} > 0 THEN 1 - ({inside}) END"


def _spark_column(item: str):
    name, _, kind = item.partition(":")
    c = F.col(name)
    if kind == "d":
        c = c.cast("date").cast("string")
    elif kind == "t":
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif kind == "i":
        c = c.cast("long")
    elif kind == "s":
        c = c.cast("string")
    elif kind == "b":
        c = c.cast("boolean")
    elif kind:
        c = tidy(c.cast("double"), int(kind))
    else:
        c = c.cast("double")
    return c.alias(name)


def _sql_column(item: str) -> str:
    name, _, kind = item.partition(":")
    if kind == "d":
        c = f"strftime(CAST({name} AS DATE), '%Y-%m-%d')"
    elif kind == "t":
        c = f"strftime(CAST({name} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f')"
    elif kind == "i":
        c = f"CAST({name} AS BIGINT)"
    elif kind == "s":
        c = f"CAST({name} AS VARCHAR)"
    elif kind == "b":
        c = f"CAST({name} AS BOOLEAN)"
    elif kind:
        rounded = f"round(CAST({name} AS DOUBLE), {kind})"
        c = f"CASE WHEN {rounded} = 0 THEN CAST(0 AS DOUBLE) ELSE {rounded} END"
    else:
        c = f"CAST({name} AS DOUBLE)"
    return f'{c} AS "{name}"'


def _needed(text: str) -> list[str]:
    """Shared views a statement uses, in definition order."""
    found: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"[a-z_0-9]+", todo.pop()))
        for name in VIEWS:
            if name in words and name not in found:
                found.add(name)
                todo.append(VIEWS[name])
    return [name for name in VIEWS if name in found]


def oracle(columns: str, body: str) -> str:
    picks = ", ".join(_sql_column(item) for item in columns.split())
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in _needed(body))
    prefix = f"WITH {ctes}\n" if ctes else ""
    return f"{prefix}SELECT {picks} FROM ({body}) AS answer"


def shown(item: str):
    """The column of one item of a column list, as the results show it."""
    return _spark_column(item)


def query(name: str, columns: str, sql: str | None = None, formatted: bool = False):
    """Register ``name``; the decorated function returns the raw DataFrame, or with ``formatted`` columns that it has made by ``shown`` itself."""

    def register(func):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            raw = func(spark, sf_dir)
            return raw.select(*[item.partition(":")[0] if formatted else _spark_column(item) for item in columns.split()])

        run.__name__, run.__doc__ = name, func.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(columns, sql)
        return func

    return register
