"""Data-quality checks of field tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCEPTED_DIMS = ("time", "level", "lat", "lon")


def quality_check(df: DataFrame, var: str = "value", dims: tuple[str, ...] = ("time", "lat", "lon")) -> DataFrame:
    """``(rule, violations)`` for the attribute and axis rules; one pass over the coordinates."""
    attributes = df.schema[var].metadata
    long_name = attributes.get("long_name", "")
    fixed = {
        "units_present": int("units" not in attributes),
        "long_name_present": int("long_name" not in attributes),
        "long_name_without_spaces": int(" " in long_name),
        "dimensions_accepted": sum(d not in ACCEPTED_DIMS for d in dims),
    }
    rules = [F.struct(F.lit(rule).alias("rule"), F.lit(n).cast("long").alias("violations")) for rule, n in fixed.items()]
    counted = {
        "lon_within_0_360": ~F.col("lon").between(0, 360),
        "lat_within_90": ~F.col("lat").between(-90, 90),
        "coordinates_present": F.col("lat").isNull() | F.col("lon").isNull() | F.col("time").isNull(),
    }
    totals = df.agg(*[F.count_if(c).alias(rule) for rule, c in counted.items()])
    rules += [F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("violations")) for rule in counted]
    return totals.select(F.inline(F.array(*rules)))


def axis_check(df: DataFrame, cyclic: bool = True, tolerance: float = 1e-6) -> DataFrame:
    """``(rule, violations)`` for the axes and completeness of a gridded field ``(time, lat, lon, ...)``.

    ``repeated_cells``: rows beyond the first of a time and cell. ``lat_uneven`` and
    ``lon_uneven``: steps of an axis that differ from its smallest (``cyclic``: the
    step across the date line counts too). ``incomplete_circles``: latitudes of a
    time that lack longitudes which the field has elsewhere; ``incomplete_times``:
    times that lack latitudes. Rows without a coordinate are left to
    ``quality_check``. Counts by cell, circle and time are one nested aggregation;
    the axes are collected as lists of labels, as long as an axis.
    """
    known = df.where(F.col("time").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    cells = known.groupBy("time", "lat", "lon").agg(F.count(F.lit(1)).alias("_rows"))
    circles = cells.groupBy("time", "lat").agg(
        F.count(F.lit(1)).alias("_cells"), F.sum(F.col("_rows") - 1).alias("_again"), F.collect_set(F.col("lon").cast("double")).alias("_lons")
    )
    axes = circles.groupBy("lat", F.array_sort("_lons").alias("_lons")).agg(F.count(F.lit(1)).alias("_n"), F.sum("_again").alias("_again"))
    times = circles.groupBy("time").agg(F.count(F.lit(1)).alias("_circles")).groupBy("_circles").agg(F.count(F.lit(1)).alias("_n"))
    lists = axes.agg(
        F.sum("_again").alias("_again"),
        F.array_sort(F.collect_set(F.col("lat").cast("double"))).alias("_lats"),
        F.collect_list(F.struct("_n", F.size("_lons").alias("_size"))).alias("_kinds"),
    )
    # The longitudes of the whole field: each label once.
    lons = cells.select("lon").distinct().agg(F.array_sort(F.collect_list(F.col("lon").cast("double"))).alias("_lons"))
    spans = times.agg(F.collect_list(F.struct("_circles", "_n")).alias("_times"))
    all_of = lists.join(F.broadcast(lons), F.lit(True)).join(F.broadcast(spans), F.lit(True))  # one row each

    def uneven(labels: Column, around: bool) -> Column:
        steps = F.transform(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x, i: x - F.get(labels, i))
        if around:
            last = F.when(F.size(labels) > 1, F.array(360.0 - F.element_at(labels, -1) + F.element_at(labels, 1))).otherwise(F.array().cast("array<double>"))
            steps = F.concat(steps, last)
        least = F.array_min(steps)
        return F.size(F.filter(steps, lambda x: x - least > tolerance))

    def counted(array: str, less: Column) -> Column:
        return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + F.when(less(x), x["_n"]).otherwise(F.lit(0)))

    found = {
        "repeated_cells": F.coalesce("_again", F.lit(0)),
        "lat_uneven": uneven(F.col("_lats"), False),
        "lon_uneven": uneven(F.col("_lons"), cyclic),
        "incomplete_circles": counted("_kinds", lambda x: x["_size"] < F.size("_lons")),
        "incomplete_times": counted("_times", lambda x: x["_circles"] < F.size("_lats")),
    }
    rules = [F.struct(F.lit(rule).alias("rule"), n.cast("long").alias("violations")) for rule, n in found.items()]
    return all_of.select(F.inline(F.array(*rules)))


def range_convert(df: DataFrame, unit: str = "unit", value: str = "value") -> DataFrame:
    """Values in unit ``1`` times 1000, all labelled ``g/kg``."""
    scaled = F.when(F.col(unit) == "1", F.col(value) * 1000).otherwise(F.col(value))
    return df.withColumn(value, scaled).withColumn(unit, F.lit("g/kg"))


def range_report(df: DataFrame, low: float = 0.0, high: float = 100.0, value: str = "value") -> DataFrame:
    """One row ``(lowest, highest, ok)`` for ``low <= x < high``."""
    lowest, highest = F.min(value), F.max(value)
    return df.agg(lowest.alias("lowest"), highest.alias("highest"), ((lowest >= low) & (highest < high)).alias("ok"))


def range_assert_convert(df: DataFrame, unit: str = "unit", low: float = 0.0, high: float = 100.0, value: str = "value") -> DataFrame:
    """Converted values; any value outside ``low <= x < high`` fails the job when it is read."""
    converted = range_convert(df, unit, value)
    inside = (F.col(value) >= low) & (F.col(value) < high)
    message = F.concat(F.lit("value out of range: "), F.col(value).cast("string"))
    checked = F.when(F.col(value).isNull() | inside, F.col(value)).otherwise(F.raise_error(message).cast("double"))
    return converted.withColumn(value, checked)
