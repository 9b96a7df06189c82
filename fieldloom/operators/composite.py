"""Composites over selected dates and their significance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.scalars import season_of
from fieldloom.functions.student import t_two_sided
from fieldloom.operators.align import date_semi_join
from fieldloom.operators.grouping import attach, group_stats
from fieldloom.operators.ordered import BUCKET
from fieldloom.operators.select import phase_bounds


def _with_annual(seasonal: DataFrame, keys: Sequence[str], value: str, season: str = "season") -> DataFrame:
    """Season sums and counts plus their ``annual`` total, from season partials only."""
    both = seasonal.withColumn(season, F.explode(F.array(F.lit("annual"), F.col(season))))
    return (
        both.groupBy(season, *keys)
        .agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("n"))
        .select(season, *keys, (F.col("_sum") / F.col("n")).alias(value), "n")
    )


def seasonal_composite(
    df: DataFrame,
    dates: DataFrame | None = None,
    by: Sequence[str] = ("lat", "lon"),
    value: str = "value",
    time: str = "time",
    date: str = "date",
) -> DataFrame:
    """Annual and seasonal means over the selected dates (all rows if none are given).

    ``(season, by..., value, n)``. The field is aggregated once, per season; the
    annual row adds the four partial sums.
    """
    rows = df if dates is None else date_semi_join(df, dates, time, date)
    seasonal = rows.groupBy(season_of(time).alias("season"), *by).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_n")
    )
    return _with_annual(seasonal, by, value)


def labelled_composite(
    df: DataFrame,
    labelled_dates: DataFrame,
    by: Sequence[str] = ("lat", "lon"),
    values: Sequence[str] = ("value",),
    time: str = "time",
    date: str = "date",
    label: str = "label",
) -> DataFrame:
    """Composites of one or more variables for many date groups in one pass.

    ``labelled_dates`` is ``(date, label)``; a day may carry several labels. They
    are gathered per day first, so the field is joined once and expanded locally.
    """
    days = labelled_dates.groupBy(F.to_date(F.col(date)).alias("_day")).agg(F.collect_set(label).alias("_labels"))
    at_day = F.to_date(F.col(time)) == F.col("_day")
    rows = df.join(F.broadcast(days), at_day, "inner").withColumn(label, F.explode("_labels"))  # one row per calendar day
    sums = rows.groupBy(label, season_of(time).alias("season"), *by).agg(
        *[F.sum(v).alias(f"_sum_{v}") for v in values], *[F.count(v).alias(f"_n_{v}") for v in values]
    )
    both = sums.withColumn("season", F.explode(F.array(F.lit("annual"), F.col("season"))))
    totals = both.groupBy(label, "season", *by).agg(
        *[(F.sum(f"_sum_{v}") / F.sum(f"_n_{v}")).alias(v) for v in values], F.sum(f"_n_{values[0]}").alias("n")
    )
    return totals


def phase_groups(days: DataFrame, groups: Mapping[str, tuple[float, float]], freq: int = 6, phase: str | None = None) -> DataFrame:
    """``(date, label)`` for every phase range a day falls in; ranges may overlap or wrap."""
    phase = phase or f"wave{freq}_phase"
    hits = []
    for name, (low, high) in groups.items():
        low, high = phase_bounds(low, high, freq)
        above, below = F.col(phase) > low, F.col(phase) < high
        hits.append(F.when(above & below if low < high else above | below, F.lit(name)))
    labelled = days.select(F.to_date("time").alias("date"), F.explode(F.array_compact(F.array(*hits))).alias("label"))
    return labelled.distinct()


def phase_group_composite(
    df: DataFrame,
    days: DataFrame,
    groups: Mapping[str, tuple[float, float]],
    freq: int = 6,
    by: Sequence[str] = ("lat", "lon"),
    values: Sequence[str] = ("value",),
) -> DataFrame:
    return labelled_composite(df, phase_groups(days, groups, freq), by, values)


def joint_condition_dates(first: DataFrame, second: DataFrame, date: str = "date") -> DataFrame:
    """``(date, label)`` for every pair of conditions that hold on the same day.

    Both inputs are ``(date, label)``; labels become ``first+second``.
    """

    def per_day(lists, name):
        return lists.groupBy(F.to_date(F.col(date)).alias("date")).agg(F.collect_set("label").alias(name))

    both = per_day(first, "_a").join(per_day(second, "_b"), "date", "inner")
    one = both.withColumn("_x", F.explode("_a"))
    return one.withColumn("_y", F.explode("_b")).select("date", F.concat_ws("+", "_x", "_y").alias("label"))


def joint_condition_composite(
    df: DataFrame, first: DataFrame, second: DataFrame, by: Sequence[str] = ("lat", "lon"), values: Sequence[str] = ("value",)
) -> DataFrame:
    return labelled_composite(df, joint_condition_dates(first, second), by, values)


def effective_sample_size(
    df: DataFrame,
    by: Sequence[str] = ("lat", "lon"),
    value: str = "value",
    time: str = "time",
) -> DataFrame:
    """``(by..., n, mean, var, n_eff)`` with ``n_eff = n / (1 + 2 sum((n-k)/n r_k))``, k = 1..n-2.

    One or two times have no such lag, so ``n_eff`` is ``n``; of three and more equal
    values it is NULL, as they have no autocorrelation. The selected times are treated as contiguous. The sum over all lags needs no
    lag pairs: with anomalies x and their running sums P, the weighted lag sum
    equals ``(sum P^2 - n/2 sum x^2 - x_first x_last) / (n sum x^2)``, since the
    sums over all windows of length n are P and -P. Running sums are taken in
    yearly pieces that are combined from their aggregates.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull())
    means = group_stats(rows, by, F.avg(value).alias("mean"))
    if by:
        centred = attach(rows, means, by)
    else:
        centred = rows.join(F.broadcast(means), F.lit(True), "inner")  # one row
    centred = centred.select(*by, time, "mean", (F.col(value) - F.col("mean")).alias("_x")).withColumn(
        BUCKET, F.year(time)
    )
    inside = Window.partitionBy(*by, BUCKET).orderBy(time, "_x").rowsBetween(Window.unboundedPreceding, 0)
    pieces = (
        centred.withColumn("_p", F.sum("_x").over(inside))
        .groupBy(*by, "mean", BUCKET)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("_x").alias("_s"),
            F.sum(F.col("_x") * F.col("_x")).alias("_xx"),
            F.sum("_p").alias("_sp"),
            F.sum(F.col("_p") * F.col("_p")).alias("_spp"),
            F.min(F.struct(time, "_x")).alias("_first"),
            F.max(F.struct(time, "_x")).alias("_last"),
        )
    )
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_s").over(across), F.lit(0.0))
    squares = F.col("_spp") + 2 * F.col("_o") * F.col("_sp") + F.col("_n") * F.col("_o") * F.col("_o")
    whole = (
        pieces.withColumn("_o", offset)
        .groupBy(*by, "mean")
        .agg(
            F.sum("_n").alias("n"),
            F.sum("_xx").alias("_xx"),
            F.sum(squares).alias("_pp"),
            F.min("_first").getField("_x").alias("_x1"),
            F.max("_last").getField("_x").alias("_xn"),
        )
    )
    n, xx = F.col("n"), F.col("_xx")
    lag_sum = (F.col("_pp") - n / 2 * xx - F.col("_x1") * F.col("_xn")) / (n * xx)
    n_eff = F.when(n <= 2, n.cast("double")).when(xx > 0, n / (1 + 2 * lag_sum))
    return whole.select(*by, "n", "mean", (xx / n).alias("var"), n_eff.alias("n_eff"))


def composite_significance(
    df: DataFrame,
    dates: DataFrame,
    by: Sequence[str] = ("lat", "lon"),
    value: str = "value",
    time: str = "time",
    date: str = "date",
    dof: str = "n",
) -> DataFrame:
    """One-sample t-test of the composite against all times, per season and cell.

    ``(season, by..., n, mean, mean_all, n_eff, t, p)``; ``dof='neff'`` uses the
    effective sample size for the degrees of freedom instead of n. A sample without
    spread, such as a single time, has an infinite t with the sign of the difference.
    """
    keys = ["season", *by]
    chosen = date_semi_join(df, dates, time, date).withColumn(
        "season", F.explode(F.array(F.lit("annual"), season_of(time)))
    )
    sample = effective_sample_size(chosen, keys, value, time)
    reference = seasonal_composite(df, None, by, value, time).select(*keys, F.col(value).alias("mean_all"))
    difference, spread = F.col("mean") - F.col("mean_all"), F.col("var") / F.col("n_eff")
    endless = F.when(difference != 0, F.signum(difference) * F.lit(float("inf")))
    t = F.when(spread == 0, endless).otherwise(difference / F.sqrt(spread))
    freedom = (F.col("n") if dof == "n" else F.col("n_eff")) - 1
    tested = sample.join(reference, keys, "inner").withColumn("t", t)
    return tested.select(
        *keys, "n", "mean", "mean_all", "n_eff", "t", t_two_sided("t", freedom.cast("double")).alias("p")
    )


def event_mean_field(
    df: DataFrame, by: Sequence[str] = ("lat", "lon"), event: str = "event_number", value: str = "value"
) -> DataFrame:
    """Mean field of each event; rows outside events are ignored."""
    return df.where(F.col(event).isNotNull()).groupBy(event, *by).agg(F.avg(value).alias(value))
