"""Projections, filters and predicates over fields and series."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.regions import in_box
from fieldloom.functions.scalars import SEASON_MONTHS, adjust_lon, clamp, magnitude_abs, season_of, unit_convert
from fieldloom.functions.scalars import unpack_scale_offset as unpack
from fieldloom.operators.ordered import scan_in_order
from fieldloom.operators.quantiles import exact_quantile
from fieldloom.session import cut_lineage


def region_box(df: DataFrame, region, lat: str = "lat", lon: str = "lon", wrap: bool = False) -> DataFrame:
    return df.where(in_box(region, lat, lon, wrap))


def selector(dim: str, choice) -> Column:
    """Predicate for one dimension: a scalar or ``(a, a)`` is equality, ``(a, b)`` an inclusive slice."""
    if not isinstance(choice, (tuple, list)):
        return F.col(dim) == F.lit(choice)
    start, end = choice
    return F.col(dim) == F.lit(start) if start == end else F.col(dim).between(start, end)


def point_or_slice(df: DataFrame, **choices) -> DataFrame:
    for dim, choice in choices.items():
        df = df.where(selector(dim, choice))
    return df


def time_range(df: DataFrame, start: str | None = None, end: str | None = None, time: str = "time") -> DataFrame:
    """Inclusive date range; the end date counts as a whole day. Either end may be open.

    A stored field has its partition column ``year``; bounds on it let the scan
    skip other years.
    """
    stored = "year" in df.columns
    if start is not None:
        first = dt.date.fromisoformat(start)
        df = df.where(F.col(time) >= F.lit(str(first)).cast("timestamp_ntz"))
        df = df.where(F.col("year") >= first.year) if stored else df
    if end is not None:
        last = dt.date.fromisoformat(end)
        df = df.where(F.col(time) < F.lit(str(last + dt.timedelta(days=1))).cast("timestamp_ntz"))
        df = df.where(F.col("year") <= last.year) if stored else df
    return df


def year_filter(df: DataFrame, first: int, last: int, time: str = "time") -> DataFrame:
    """Rows whose year is in ``first..last``, written as a range so the scan can prune."""
    return time_range(df, f"{first:04d}-01-01", f"{last:04d}-12-31", time)


def season_filter(df: DataFrame, season: str, time: str = "time") -> DataFrame:
    return df if season.lower() == "annual" else df.where(F.month(time).isin(*SEASON_MONTHS[season]))


def max_latitude(df: DataFrame, limit: float, lat: str = "lat") -> DataFrame:
    return df.where(F.col(lat) <= limit)


def level_select(
    df: DataFrame, level: float | None = None, low: float | None = None, high: float | None = None, dim: str = "level"
) -> DataFrame:
    """One level, or a range with either end open."""
    if level is not None:
        return df.where(F.col(dim) == level)
    if low is not None:
        df = df.where(F.col(dim) >= low)
    return df if high is None else df.where(F.col(dim) <= high)


def nearest_label(df: DataFrame, dim: str, targets: Sequence[float]) -> DataFrame:
    """``(target, dim)``: the axis label nearest to each target; ties keep the lower label; missing labels are passed over.

    One aggregation over the field, one output row per target.
    """
    picks = [
        F.struct(
            F.lit(float(t)).alias("target"),
            F.min(F.struct(F.abs(F.col(dim) - t).alias("gap"), F.col(dim).alias("label")))
            .getField("label")
            .alias(dim),
        )
        for t in targets
    ]
    known = df.where(F.col(dim).isNotNull() & ~F.isnan(F.col(dim).cast("double")))
    return known.agg(F.array(*picks).alias("picks")).select(F.inline("picks"))


def select_nearest(df: DataFrame, dim: str, target: float) -> DataFrame:
    """Rows of ``df`` at the axis label nearest to ``target``."""
    label = nearest_label(df, dim, [target]).select(dim)
    return df.join(F.broadcast(label), dim, "left_semi")  # one row


def zero_outside_lon(
    df: DataFrame, start: float, end: float, value: str = "value", lon: str = "lon", zero_ends: bool = True
) -> DataFrame:
    """Set ``value`` to 0 outside ``start..end``; the two ends are zeroed too unless ``zero_ends`` is off.

    With ``zero_ends`` off the bounds and the axis are first wrapped into 0..360.
    """
    if zero_ends:
        outside = (F.col(lon) <= start) | (F.col(lon) >= end)
    else:
        wrapped = adjust_lon(lon)
        outside = (wrapped < start % 360) | (wrapped > end % 360)
    return df.withColumn(value, F.when(outside, F.lit(0.0)).otherwise(F.col(value)))


def threshold_value(df: DataFrame, threshold: str | float, value: str = "value") -> DataFrame:
    """One row ``(threshold)``: a number, or the percentile that text such as ``90pct`` names."""
    text = str(threshold)
    if text.endswith("pct"):
        return exact_quantile(df, value, float(text[:-3]) / 100.0, out="threshold")
    number = F.lit(float(text)).alias("threshold")
    return df.sparkSession.range(1).select(number)


def threshold_dates(
    df: DataFrame, threshold: str | float, direction: str = "greater", value: str = "value", time: str = "time"
) -> DataFrame:
    """Times whose value is at or beyond the threshold.

    A percentile reads the series several times, so time and value are
    checkpointed first; what made the series then runs once.
    """
    if direction not in ("greater", "less"):
        raise ValueError("direction is 'greater' or 'less'")
    text = str(threshold)
    if not text.endswith("pct"):
        limit = F.lit(float(text))
        keep = F.col(value) >= limit if direction == "greater" else F.col(value) <= limit
        return df.where(keep & ~F.isnan(value)).select(time)
    series = cut_lineage(df.where(~F.isnan(value)).select(time, value))
    limit = threshold_value(series, threshold, value)
    keep = F.col(value) >= F.col("threshold") if direction == "greater" else F.col(value) <= F.col("threshold")
    return series.join(F.broadcast(limit), keep, "inner").select(time)  # one-row limit


def phase_bounds(low: float, high: float, freq: int) -> tuple[float, float]:
    """Bring bounds above one wavelength back by one wavelength, once."""
    period = 360.0 / freq
    low, high = (b - period if b > period else b for b in (low, high))
    if not (low < period and high < period):
        raise ValueError("phase bounds must be below twice the wavelength")
    return low, high


def phase_in(phase: str, low: float, high: float, freq: int) -> Column:
    low, high = phase_bounds(low, high, freq)
    above, below = F.col(phase) > low, F.col(phase) < high
    return above & below if low < high else above | below


def phase_filter(df: DataFrame, low: float, high: float, freq: int = 6, phase: str | None = None) -> DataFrame:
    """Rows strictly between two phases; bounds that wrap select both sides."""
    return df.where(phase_in(phase or f"wave{freq}_phase", low, high, freq))


def duration_filter(df: DataFrame, days: int, strict: bool = True, duration: str = "event_duration") -> DataFrame:
    return df.where(F.col(duration) > days if strict else F.col(duration) >= days)


def sign_change_filter(df: DataFrame, most: int, count: str = "sign_count") -> DataFrame:
    return df.where(F.col(count) <= most)


def clamp_values(df: DataFrame, low: float, high: float, value: str = "value") -> DataFrame:
    return df.withColumn(value, clamp(value, low, high))


def absolute_values(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn(value, magnitude_abs(value))


def convert_units(df: DataFrame, scale: float = 1.0, offset: float = 0.0, value: str = "value") -> DataFrame:
    return df.withColumn(value, unit_convert(value, scale, offset))


def unpack_scale_offset(df: DataFrame, scale_factor: float, add_offset: float, value: str = "value") -> DataFrame:
    return df.withColumn(value, unpack(value, scale_factor, add_offset))


def reorient_axes(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Longitude in 0..360. Latitude order has no meaning in rows, so nothing is sorted."""
    return df.withColumn(lon, adjust_lon(lon))


def rename_variable(df: DataFrame, old: str, new: str, **attributes: str) -> DataFrame:
    """Rename a column and merge attributes into its metadata."""
    metadata = {**df.schema[old].metadata, **attributes}
    return df.withColumnRenamed(old, new).withMetadata(new, metadata)


def thin_stride(df: DataFrame, step: int, time: str = "time", by: Sequence[str] = ()) -> DataFrame:
    """Every ``step``-th row in time order, starting with the first."""
    numbered = scan_in_order(df, time, by=by, ordinal="_ordinal")
    return numbered.where(F.col("_ordinal") % step == 0).drop("_ordinal")


def time_slice_or_mean(
    df: DataFrame, timestep: int | None = None, by: Sequence[str] = ("lat", "lon"), time: str = "time", value: str = "value"
) -> DataFrame:
    """The field at one position of the time axis (negative counts from the end), or its time mean."""
    if timestep is None:
        return df.groupBy(*by).agg(F.avg(value).alias(value))
    axis = df.select(time).distinct()
    numbered = scan_in_order(axis, time, ordinal="_ordinal")
    if timestep >= 0:
        wanted = numbered.where(F.col("_ordinal") == timestep)
    else:
        size = axis.agg(F.count(F.lit(1)).alias("_size"))
        wanted = numbered.join(F.broadcast(size), F.col("_ordinal") == F.col("_size") + timestep)  # one row
    return df.join(F.broadcast(wanted.select(time)), time, "left_semi").select(*by, value)  # at most one row


def significance_mask(df: DataFrame, low: float = 0.0, high: float = 0.05, p: str = "p") -> DataFrame:
    return df.withColumn("significant", F.col(p).between(low, high))


def with_season(df: DataFrame, time: str = "time", out: str = "season") -> DataFrame:
    return df.withColumn(out, season_of(time))


def columns_except(df: DataFrame, names: Iterable[str]) -> list[str]:
    names = set(names)
    return [c for c in df.columns if c not in names]
