"""Recomputing chosen years of a stored result.

Operators that treat each time on its own replace whole years. Climatologies are
kept as a state of mergeable partial sums per year, so that years are replaced
without reading the others. Running means replace the chosen years and as much of
their neighbours as a window reaches, in months.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.scalars import climatology_key
from fieldloom.sources.writers import sink_field


def incremental_years(
    source: DataFrame, years: Iterable[int], operator: Callable[[DataFrame], DataFrame], path: str, time: str = "time"
) -> None:
    """Apply ``operator`` to the given years and replace just those partitions of the result.

    Right for operators that treat each time on its own (zonal anomaly, Fourier
    transforms, winds); for climatologies and running means see below.
    A source stored by ``year`` is pruned to the chosen partitions.
    """
    year = F.col("year") if "year" in source.columns else F.year(time)
    block = source.where(year.isin(*[int(y) for y in years]))
    result = operator(block.drop("year"))
    sink_field(result, path, time)


def _block(source: DataFrame, years: Iterable[int], time: str) -> DataFrame:
    year = F.col("year") if "year" in source.columns else F.year(time)
    return source.where(year.isin(*[int(y) for y in years]))


def update_climatology(
    source: DataFrame,
    years: Iterable[int],
    path: str,
    timescale: str = "monthly",
    by: Sequence[str] = ("lat", "lon"),
    value: str = "value",
    time: str = "time",
) -> None:
    """Replace the chosen years of a climatology's state at ``path``.

    The state has per year, group and calendar key the count, mean and sum of
    squares about that mean; a year without rows leaves the state as it was.
    """
    rows = _block(source, years, time).where(F.col(value).isNotNull())
    sums = rows.groupBy(F.year(time).alias("year"), climatology_key(time, timescale).alias("key"), *by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("squares")
    )
    sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def climatology_of_state(state: DataFrame, by: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """``(key, by..., clim_mean, clim_std)`` merged from the years of a state, all of them or a base period that the caller selects."""
    keys = ["key", *by]
    n, mean = F.col("n"), F.col("mean")
    spread = F.sum("squares") + F.sum(n * mean * mean) - F.sum(n * mean) * F.sum(n * mean) / F.sum(n)
    shifted = state.join(F.broadcast(state.agg(F.avg("mean").alias("_at"))), F.lit(True))  # one row: means near zero lose no digits
    moved = shifted.withColumn("mean", mean - F.col("_at"))
    merged = moved.groupBy(*keys).agg((F.sum(n * mean) / F.sum(n)).alias("_m"), spread.alias("_s"), F.sum("n").alias("_n"), F.first("_at").alias("_at"))
    return merged.select(*keys, (F.col("_m") + F.col("_at")).alias("clim_mean"), F.sqrt(F.greatest(F.col("_s"), F.lit(0.0)) / F.col("_n")).alias("clim_std"))


def update_running_mean(
    source: DataFrame, years: Iterable[int], window_months: int, operator: Callable[[DataFrame], DataFrame], path: str, time: str = "time"
) -> None:
    """Replace the months of a stored running mean that the chosen years reach.

    ``operator`` makes the running mean; ``window_months`` is at least as long as
    half its window. For each run of chosen years the months from so many before
    to so many after it are replaced, read with as many again on either side.
    A running mean over rows needs a record without gaps.
    """
    chosen = sorted({int(y) for y in years})
    runs = [[y] for y in chosen if y - 1 not in chosen]
    for run in runs:
        while run[-1] + 1 in chosen:
            run.append(run[-1] + 1)
    month = F.year(time) * 12 + F.month(time) - 1
    for run in runs:
        first, last = run[0] * 12 - window_months, run[-1] * 12 + 11 + window_months
        near = source
        if "year" in source.columns:  # prunes a source stored by year
            near = near.where(F.col("year").between((first - window_months) // 12, (last + window_months) // 12)).drop("year")
        near = near.where(month.between(first - window_months, last + window_months))
        result = operator(near).where(month.between(first, last))
        by_month = result.withColumn("year", F.year(time)).withColumn("month", F.month(time)).hint("rebalance", "year", "month")
        by_month.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)
