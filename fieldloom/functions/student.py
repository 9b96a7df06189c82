"""Two-sided Student-t probability as a column expression."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _away_from_zero(value: Column) -> Column:
    return F.when(F.abs(value) < TINY, F.lit(TINY)).otherwise(value)


def _beta_fraction(s: Column) -> Column:
    """Continued fraction of the incomplete beta function (modified Lentz) for a struct ``(p, q, y)`` with y below (p + 1) / (p + q + 2); it settles
    within a few times the root of p + q steps."""
    steps = F.sequence(F.lit(1), (F.lit(40) + F.ceil(4 * F.sqrt(s["p"] + s["q"]))).cast("int"))
    d = 1.0 / _away_from_zero(1.0 - (s["p"] + s["q"]) * s["y"] / (s["p"] + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"), s["p"].alias("p"), s["q"].alias("q"), s["y"].alias("y"))

    def half(acc: Column, term: Column) -> Column:
        def finished(x: Column) -> Column:
            return F.struct(x["c"].alias("c"), x["d"].alias("d"), (acc["h"] * x["c"] * x["d"]).alias("h"), *[acc[n].alias(n) for n in ("p", "q", "y")])

        both = F.struct(_away_from_zero(1.0 + term / acc["c"]).alias("c"), (1.0 / _away_from_zero(1.0 + term * acc["d"])).alias("d"))
        return _bound(both, finished)

    def step(acc: Column, m: Column) -> Column:
        even = m * (acc["q"] - m) * acc["y"] / ((acc["p"] + 2 * m - 1) * (acc["p"] + 2 * m))
        odd = -(acc["p"] + m) * (acc["p"] + acc["q"] + m) * acc["y"] / ((acc["p"] + 2 * m) * (acc["p"] + 2 * m + 1))
        return half(half(acc, even), odd)

    return F.aggregate(steps, start, step)["h"]


def _gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a): its asymptotic series at a + 20, and the recurrence back from there."""
    z = 1.0 / (a + 20.0)
    series = 1.0 + z * (-1 / 8 + z * (1 / 128 + z * (5 / 1024 + z * (-21 / 32768 + z * (-399 / 262144 + z * (869 / 4194304))))))
    back = F.lit(1.0)
    for i in range(20):
        back = back * (a + i) / (a + i + 0.5)
    return F.sqrt(a + 20.0) * series * back


def t_two_sided(t: str | Column, df: str | Column) -> Column:
    """``P(|T| > |t|)`` with ``df`` degrees of freedom, whole or not: an incomplete beta function. NULL without freedom or for an undefined t, 0 at infinity."""
    t, df = (F.col(c) if isinstance(c, str) else c for c in (t, df))
    t, df = t.cast("double"), df.cast("double")
    square = t * t
    given = F.struct((df / 2.0).alias("a"), (df / (df + square)).alias("x"), (square / (df + square)).alias("rest"))

    def probability(s: Column) -> Column:
        swap = s["x"] > (s["a"] + 1.0) / (s["a"] + 2.5)
        half = F.lit(0.5)
        sides = F.struct(
            F.when(swap, half).otherwise(s["a"]).alias("p"),
            F.when(swap, s["a"]).otherwise(half).alias("q"),
            F.when(swap, s["rest"]).otherwise(s["x"]).alias("y"),
            swap.alias("swap"),
            (_gamma_ratio(s["a"]) / math.sqrt(math.pi)).alias("scale"),
        )

        def part(v: Column) -> Column:
            front = F.exp(v["p"] * F.log(v["y"]) + v["q"] * F.log1p(-v["y"])) * v["scale"] / v["p"]
            found = F.when(v["y"] <= 0, F.lit(0.0)).otherwise(front * _beta_fraction(v))
            return F.when(v["swap"], 1.0 - found).otherwise(found)

        return _bound(sides, part)

    endless = F.abs(t) == F.lit(float("inf"))
    usable = t.isNotNull() & ~F.isnan(t) & (df > 0) & ~F.isnan(df)
    return F.when(usable & endless, F.lit(0.0)).when(usable, _bound(given, probability))
