"""Means, climatologies, anomalies, calendar aggregates and series statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.regions import in_box, region_column
from fieldloom.functions.scalars import climatology_key, season_of
from fieldloom.operators.align import climatology_join
from fieldloom.operators.grouping import attach, group_stats
from fieldloom.operators.ordered import scan_in_order


def area_mean(df: DataFrame, by: Sequence[str] = ("time",), value: str = "value", weight: str | None = None) -> DataFrame:
    """Mean over all cells per time. Unweighted unless ``weight='coslat'``."""
    if weight is None:
        return df.groupBy(*by).agg(F.avg(value).alias(value))
    w = F.when(F.col(value).isNotNull(), F.cos(F.radians(F.col("lat"))))
    return df.groupBy(*by).agg((F.sum(F.col(value) * w) / F.sum(w)).alias(value))


def region_means(df: DataFrame, regions: Sequence[str], time: str = "time", value: str = "value", wrap: bool = False) -> DataFrame:
    """Means of several boxes, which may overlap, in one pass: ``(region, time, value)``."""
    anywhere = reduce(or_, [in_box(r, wrap=wrap) for r in regions])
    labelled = df.where(anywhere).withColumn("region", F.explode(region_column(list(regions), wrap=wrap)))
    return labelled.groupBy("region", time).agg(F.avg(value).alias(value))


def mean_over(df: DataFrame, keep: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keep).agg(F.avg(value).alias(value))


def zonal_mean(df: DataFrame, by: Sequence[str] = ("time", "lat"), value: str = "value") -> DataFrame:
    return mean_over(df, by, value)


def meridional_mean(df: DataFrame, by: Sequence[str] = ("time", "lon"), value: str = "value") -> DataFrame:
    return mean_over(df, by, value)


def meridional_max(df: DataFrame, by: Sequence[str] = ("time", "lon"), value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(F.max(value).alias(value))


def zonal_median(df: DataFrame, by: Sequence[str] = ("time",), value: str = "value") -> DataFrame:
    """Exact median over longitude.

    Expects one row per longitude, as ``meridional_max`` leaves them, so a group
    is no larger than the longitude axis.
    """
    return df.groupBy(*by).agg(F.median(value).alias(value))


def argmin_cell(df: DataFrame, by: Sequence[str] = ("time",), value: str = "value") -> DataFrame:
    """Smallest value per time with its place; ties go to the first in latitude-major order."""
    least = F.min(F.when(F.col(value).isNotNull(), F.struct(value, "lat", "lon"))).alias("_least")
    return df.groupBy(*by).agg(least).select(
        *by,
        F.col("_least").getField(value).alias("min_value"),
        F.col("_least.lat").alias("min_lat"),
        F.col("_least.lon").alias("min_lon"),
    )


def climatology(
    df: DataFrame,
    timescale: str = "monthly",
    by: Sequence[str] = ("lat", "lon"),
    base: Column | None = None,
    value: str = "value",
    time: str = "time",
) -> DataFrame:
    """Mean and population deviation per calendar key."""
    rows = df if base is None else df.where(base)
    return rows.groupBy(climatology_key(time, timescale).alias("key"), *by).agg(
        F.avg(value).alias("clim_mean"), F.stddev_pop(value).alias("clim_std")
    )


def yday_anomaly(
    df: DataFrame,
    key: str = "dayofyear",
    by: Sequence[str] = ("lat", "lon"),
    value: str = "value",
    time: str = "time",
    base: Column | None = None,
) -> DataFrame:
    """Departure from the multi-year mean of the calendar day (or month)."""
    return climatology_join(df, climatology_key(time, key), by=by, value=value, base=base)


def zonal_anomaly(df: DataFrame, by: Sequence[str] = ("time", "lat"), value: str = "value") -> DataFrame:
    """Departure from the mean of the latitude circle."""
    stats = group_stats(df, list(by), F.avg(value).alias("_zonal"))
    return (
        attach(df, stats, list(by), reread=True)
        .withColumn(value, F.col(value) - F.col("_zonal"))
        .select(*df.columns)
    )


def daily_mean(df: DataFrame, by: Sequence[str] = ("lat", "lon"), value: str = "value", time: str = "time") -> DataFrame:
    return df.groupBy(F.to_date(F.col(time)).alias("date"), *by).agg(F.avg(value).alias(value))


def daily_sum_shifted(
    df: DataFrame,
    by: Sequence[str] = ("lat", "lon"),
    hours: int = -12,
    scale: float = 1000.0,
    value: str = "value",
    time: str = "time",
) -> DataFrame:
    """Daily totals of accumulations stamped at the end of their interval."""
    day = F.to_date(F.col(time) + F.make_dt_interval(hours=F.lit(hours)))
    return df.groupBy(day.alias("date"), *by).agg((F.sum(value) * F.lit(scale)).alias(value))


def bucket_start(time: Column, timescale: str) -> Column:
    """First day of the calendar month, or of the three-month season starting in December, March, June or September."""
    if timescale == "monthly":
        return F.to_date(F.date_trunc("MONTH", time))
    if timescale == "seasonal":
        return F.add_months(F.to_date(F.date_trunc("QUARTER", F.add_months(F.to_date(time), 1))), -1)
    raise ValueError("timescale is monthly or seasonal")


def calendar_aggregate(
    df: DataFrame, timescale: str = "monthly", method: str = "sum", value: str = "value", time: str = "time"
) -> DataFrame:
    """Monthly or seasonal sums or means; the last bucket, possibly partial, is dropped."""
    func = {"sum": F.sum, "mean": F.avg}[method]
    buckets = df.groupBy(bucket_start(F.col(time), timescale).alias("bucket")).agg(func(value).alias(value))
    last = buckets.agg(F.max("bucket").alias("_last"))
    return buckets.join(F.broadcast(last), F.col("bucket") < F.col("_last"), "inner").drop("_last")  # one row


def normalise_series(df: DataFrame, value: str = "value", sample: bool = True) -> DataFrame:
    """``(x - mean) / deviation`` over the whole series."""
    deviation = F.stddev_samp if sample else F.stddev_pop
    stats = df.agg(F.avg(value).alias("_m"), deviation(value).alias("_s"))
    joined = df.join(F.broadcast(stats), F.lit(True), "inner")  # one row
    return joined.withColumn(value, (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def linear_trend_fit(df: DataFrame, y: str = "y", x: str = "x", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def pearson_correlation(df: DataFrame, x: str = "x", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.corr(x, y).alias("r"))


def quadrant_percent(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Whole percentages of points in each sign quadrant; zero counts as positive."""
    right, top = F.col(x) >= 0, F.col(y) >= 0

    def share(condition):
        return F.round(F.avg(F.when(condition, 100.0).otherwise(0.0))).cast("long")

    return df.agg(
        share(right & top).alias("top_right"),
        share(right & ~top).alias("bottom_right"),
        share(~right & ~top).alias("bottom_left"),
        share(~right & top).alias("top_left"),
    )


def series_extent(*series: DataFrame, value: str = "value") -> DataFrame:
    """Highest and lowest value over several series."""
    parts = [s.agg(F.max(value).alias("highest"), F.min(value).alias("lowest")) for s in series]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.agg(F.max("highest").alias("highest"), F.min("lowest").alias("lowest"))


def find_duplicates(df: DataFrame, item: str, position: str) -> DataFrame:
    """Every position of an item that occurs more than once, one row each.

    Positions stay rows, so an item that fills a third of the table needs no
    group in memory.
    """
    counts = df.groupBy(item).agg(F.count(F.lit(1)).alias("occurrences"))
    repeated = counts.where("occurrences > 1").withColumn("_group_rows", F.col("occurrences"))
    return attach(df.select(item, position), repeated, [item], how="inner", reread=True).select(item, position, "occurrences")


def marginal_distribution(
    labelled: DataFrame, variables: Sequence[str], low: float, high: float, bins: int, label: str = "label"
) -> DataFrame:
    """Histogram of each variable for every labelled subset: ``(label, variable, bin, n)``.

    Bins are numbered 1..``bins``; 0 and ``bins + 1`` hold what lies outside.
    """
    values = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("_v")) for v in variables])
    long = labelled.select(label, F.inline(values)).where(F.col("_v").isNotNull())
    bin_no = F.width_bucket("_v", F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("long")
    return long.groupBy(label, "variable", bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def label_by_dates(df: DataFrame, time: str = "time", all_label: str | None = "all", **date_lists: DataFrame) -> DataFrame:
    """Copies of each row labelled with every date list that holds its day."""
    lists = None
    for name, dates in date_lists.items():
        part = dates.select(F.to_date(F.col("date")).alias("_day")).distinct().withColumn("label", F.lit(name))
        lists = part if lists is None else lists.unionByName(part)
    labels = lists.groupBy("_day").agg(F.collect_list("label").alias("_labels"))  # one entry per list
    joined = df.withColumn("_day", F.to_date(F.col(time))).join(F.broadcast(labels), "_day", "left")  # one row per calendar day
    found = F.coalesce("_labels", F.array().cast("array<string>"))
    if all_label:
        found = F.concat(F.array(F.lit(all_label)), found)
    return joined.withColumn("label", F.explode(found)).drop("_day", "_labels")


def seasonal_index_mean(
    df: DataFrame, low: float = -1.0, high: float = 1.0, value: str = "value", time: str = "time"
) -> DataFrame:
    """Three-month means of an index, flagged above ``high`` and below ``low``."""
    means = calendar_aggregate(df, "seasonal", "mean", value, time)
    return means.withColumn("season", season_of(F.col("bucket"))).withColumn(
        "flag", F.when(F.col(value) > high, 1).when(F.col(value) < low, -1).otherwise(0)
    )


def infer_timescale(df: DataFrame, time: str = "time") -> DataFrame:
    """One row ``(step_hours, timescale)`` from the first two distinct times."""
    firsts = df.agg(F.min(time).alias("_t0"))
    later = df.join(F.broadcast(firsts), F.col(time) > F.col("_t0"), "inner")  # one row
    step = later.agg(F.min("_t0").alias("_t0"), F.min(time).alias("_t1"))
    hours = (F.unix_micros(F.col("_t1").cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp"))) / 3.6e9
    # The least step in hours of each class.
    limits = [("yearly", 365 * 24), ("monthly", 27 * 24), ("daily", 24), ("12hourly", 12), ("6hourly", 6), ("hourly", 1)]
    scale = F.when(F.lit(False), None)
    for name, least in limits:
        scale = scale.when(F.col("step_hours") >= least, name)
    return step.select(hours.alias("step_hours")).withColumn("timescale", scale)


def _lag_products(max_lag: int, size: int):
    """Sums of ``x[i] * x[i + lag]`` for the rows a block owns, by FFT."""

    def products(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_i")
        x = block["_x"].to_numpy()
        owned = np.where(block["_i"].to_numpy() // size == block["_block"].iloc[0], x, 0.0)
        length = 1 << int(np.ceil(np.log2(len(x) + max_lag + 1)))
        spectrum = np.conj(np.fft.rfft(owned, length)) * np.fft.rfft(x, length)
        lags = min(max_lag + 1, len(x))
        out = block.iloc[[0] * lags].drop(columns=["_i", "_x", "_block"])
        out["lag"] = np.arange(lags, dtype="int32")
        out["_c"] = np.fft.irfft(spectrum, length)[:lags]
        return out

    return products


def autocorrelation(
    df: DataFrame, max_lag: int, by: Sequence[str] = (), value: str = "value", time: str = "time"
) -> DataFrame:
    """Biased autocorrelation for lags ``0..max_lag`` per group: ``(by..., lag, r)``.

    Positions are cut into blocks, each with the next ``max_lag`` rows as a halo,
    so one long series is spread over many tasks and a group in Python is never
    larger than a block and its halo. Lag sums of the blocks add up.
    """
    by = list(by)
    numbered = scan_in_order(df, time, by=by, ordinal="_i")
    stats = group_stats(numbered, by, F.avg(value).alias("_m"), F.var_pop(value).alias("_var"), F.count(value).alias("_n"))
    if by:
        centred = attach(numbered, stats, by)
    else:
        centred = numbered.join(F.broadcast(stats.select("_m")), F.lit(True), "inner")  # one row
    centred = centred.select(*by, "_i", (F.col(value) - F.col("_m")).alias("_x"))
    size = max(4096, max_lag)
    block = F.floor(F.col("_i") / size)
    copies = F.when((block > 0) & (F.col("_i") % size < max_lag), F.array(block, block - 1)).otherwise(F.array(block))
    blocked = centred.withColumn("_block", F.explode(copies))
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by] + ["lag int", "_c double"])
    sums = blocked.groupBy(*by, "_block").applyInPandas(_lag_products(max_lag, size), schema)
    sums = sums.groupBy(*by, "lag").agg(F.sum("_c").alias("_c"))
    scale = stats.select(*by, (F.col("_var") * F.col("_n")).alias("_c0"), "_n")
    joined = sums.join(scale, by, "inner") if by else sums.join(F.broadcast(scale), F.lit(True), "inner")  # one row
    return joined.where(F.col("lag") < F.col("_n")).select(*by, "lag", (F.col("_c") / F.col("_c0")).alias("r"))
