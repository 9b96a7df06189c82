"""Exact interpolated quantiles that scale past one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.grouping import GROUP_ROWS, attach, group_stats

BINS = 4096
#: Values of a sketch: ranks are bracketed to a few parts in so many.
ACCURACY = 10_000


def exact_quantile(
    df: DataFrame, value: str, q: float, by: Sequence[str] = (), out: str = "quantile", bins: int = BINS, accuracy: int = ACCURACY
) -> DataFrame:
    """Linear-interpolated quantile of ``value`` per group, exact at any group size.

    Three light passes: a mergeable sketch per group brackets the wanted ranks, so
    that far values do not matter; counts per equal-width bin inside the bracket;
    and the distinct values of just the bins that hold the ranks, a few in
    ``accuracy * bins`` of a group. Each shuffle carries partial counts, never the
    rows themselves. NULL and NaN are skipped.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).alias("_v"))
    single = not by
    if single:
        rows, by = rows.withColumn("_all", F.lit(0)), ["_all"]
    # The sketch is off by a part in ``accuracy`` of the ranks at most; a group of fewer rows is its own bracket.
    slack = 2.0 / accuracy
    sides = F.percentile_approx("_v", [max(q - slack, 0.0), min(q + slack, 1.0)], accuracy)
    extent = group_stats(rows, by, F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.count("_v").alias("_total"), sides.alias("_sides"))
    few = F.col("_total") <= accuracy
    low = F.when(few | F.lit(q <= slack), F.col("_least")).otherwise(F.col("_sides")[0])
    high = F.when(few | F.lit(q >= 1 - slack), F.col("_most")).otherwise(F.col("_sides")[1])
    extent = extent.select(*by, "_total", low.alias("_lo"), high.alias("_hi"), GROUP_ROWS)
    width = F.col("_hi") - F.col("_lo")
    inner_bin = F.least(F.floor((F.col("_v") - F.col("_lo")) / width * bins), F.lit(bins - 1))
    place = F.when(F.col("_v") < F.col("_lo"), F.lit(-1)).when(width > 0, inner_bin).otherwise(F.lit(0))
    near = attach(rows, extent, by, how="inner", few_keys=single).where("_v <= _hi")
    binned = near.withColumn("_bin", place)

    rank = (F.col("_total") - 1) * F.lit(float(q))
    across = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = binned.groupBy(*by, "_bin", "_total").agg(F.count(F.lit(1)).alias("_in_bin"))
    needed = (
        per_bin.withColumn("_before", F.coalesce(F.sum("_in_bin").over(across), F.lit(0)))
        .where((F.col("_before") <= F.ceil(rank)) & (F.col("_before") + F.col("_in_bin") > F.floor(rank)))
        .select(*by, "_bin", "_before")
    )
    values = binned.where("_bin >= 0").groupBy(*by, "_bin", "_total", "_v").agg(F.count(F.lit(1)).alias("_n"))
    counts = values.join(needed, [*by, "_bin"], "inner")
    inside = Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside)).withColumn("_rank", rank)
    low = F.min(F.when(F.col("_upto") > F.floor("_rank"), F.col("_v")))
    high = F.min(F.when(F.col("_upto") > F.ceil("_rank"), F.col("_v")))
    part = F.max("_rank") - F.floor(F.max("_rank"))
    return ranked.groupBy(*by).agg((low + (high - low) * part).alias(out)).drop("_all")


def percentile_by_axis(
    df: DataFrame, pct: float, by: Sequence[str] = ("lat", "lon"), value: str = "value", out: str = "percentile"
) -> DataFrame:
    """Percentile along the remaining axis for every group, such as each grid cell."""
    return exact_quantile(df, value, pct / 100.0, by=by, out=out)
