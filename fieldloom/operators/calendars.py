"""Date-list arithmetic: calendars, counts per month and season, overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.scalars import season_of
from fieldloom.functions.student import t_two_sided


def fill_calendar(
    df: DataFrame,
    start: str | None = None,
    end: str | None = None,
    date: str = "date",
    value: str = "count",
    bounds: DataFrame | None = None,
) -> DataFrame:
    """One row per day of ``start..end``; days without data get 0, repeated days are added up.

    In place of ``start`` and ``end``, ``bounds`` is a table of one row
    ``(first_day, last_day)``; bounds that hold no day give no rows.
    """
    if bounds is None:
        bounds = df.sparkSession.range(1).select(
            F.lit(start).cast("date").alias("first_day"), F.lit(end).cast("date").alias("last_day")
        )
    days = F.sequence(F.col("first_day"), F.col("last_day"))
    calendar = bounds.where("last_day >= first_day").select(F.explode(days).alias(date))
    totals = df.groupBy(F.to_date(F.col(date)).alias(date)).agg(F.sum(value).alias(value))
    return calendar.join(totals, date, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def counts_per_day(dates: DataFrame, date: str = "date") -> DataFrame:
    return dates.groupBy(F.to_date(F.col(date)).alias(date)).agg(F.count(F.lit(1)).alias("count"))


def season_year_bounds(df: DataFrame, date: str = "date") -> DataFrame:
    """One row ``(first_day, last_day)``: the whole December-November years within the data.

    A first date in December already belongs to a begun month, so the next
    December is taken.
    """
    ends = df.agg(F.min(F.to_date(date)).alias("_a"), F.max(F.to_date(date)).alias("_b"))
    first_year = F.year("_a") + F.when(F.month("_a") == 12, 1).otherwise(0)
    last_year = F.year("_b") - F.when(F.month("_b") < 12, 1).otherwise(0)
    return ends.select(
        F.make_date(first_year, F.lit(12), F.lit(1)).alias("first_day"),
        F.make_date(last_year, F.lit(11), F.lit(30)).alias("last_day"),
    )


def calendar_year_bounds(df: DataFrame, date: str = "date") -> DataFrame:
    """One row ``(first_day, last_day)``: the January-December years that the data touch."""
    ends = df.agg(F.min(F.to_date(date)).alias("_a"), F.max(F.to_date(date)).alias("_b"))
    return ends.select(
        F.make_date(F.year("_a"), F.lit(1), F.lit(1)).alias("first_day"),
        F.make_date(F.year("_b"), F.lit(12), F.lit(31)).alias("last_day"),
    )


def complete_season_years(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows inside whole December-November years."""
    bounds = season_year_bounds(df, date)
    inside = F.to_date(F.col(date)).between(F.col("first_day"), F.col("last_day"))
    return df.join(F.broadcast(bounds), inside, "inner").drop("first_day", "last_day")  # one row


def month_frequency_pct(
    dates: DataFrame, start: str | None = None, end: str | None = None, date: str = "date", bounds: DataFrame | None = None
) -> DataFrame:
    """Share of listed days among all days of each calendar month, from ``start`` to ``end`` or within ``bounds`` as in ``fill_calendar``."""
    filled = fill_calendar(counts_per_day(dates, date), start, end, date, bounds=bounds)
    return filled.groupBy(F.month(date).alias("month")).agg(
        (100.0 * F.sum("count") / F.count(F.lit(1))).alias("pct")
    )


def season_year_counts(daily: DataFrame, date: str = "date", value: str = "count") -> DataFrame:
    """``(season_year, DJF, MAM, JJA, SON, annual)``; December counts towards the next year."""
    year = F.year(F.add_months(F.to_date(F.col(date)), 1)).alias("season_year")
    sums = daily.groupBy(year).agg(
        *[F.sum(F.when(season_of(date) == s, F.col(value)).otherwise(0)).alias(s) for s in ("DJF", "MAM", "JJA", "SON")]
    )
    return sums.withColumn("annual", F.col("DJF") + F.col("MAM") + F.col("JJA") + F.col("SON"))


def seasonal_trend(counts: DataFrame) -> DataFrame:
    """Least-squares slope per year and its p-value for each season: ``(season, n, slope, r, p)``."""
    names = ("annual", "DJF", "MAM", "JJA", "SON")
    long = counts.select(
        "season_year",
        F.inline(F.array(*[F.struct(F.lit(s).alias("season"), F.col(s).cast("double").alias("_y")) for s in names])),
    )
    x = F.col("season_year").cast("double")
    fits = long.groupBy("season").agg(
        F.count("_y").alias("n"), F.regr_slope("_y", x).alias("slope"), F.corr("_y", x).alias("r")
    )
    freedom = F.col("n") - 2
    t = F.col("r") * F.sqrt(freedom / (1 - F.col("r") * F.col("r")))
    return fits.withColumn("p", t_two_sided(t, freedom.cast("double")))


def date_intersect(primary: DataFrame, secondary: DataFrame, date: str = "date") -> DataFrame:
    """Distinct dates of both lists, sorted."""
    return primary.select(date).intersect(secondary.select(date)).orderBy(date)


def date_overlap_stats(primary: DataFrame, secondary: DataFrame, date: str = "date") -> DataFrame:
    """Counts of primary, secondary and common dates with the overlap share, per season and for the year.

    List totals count repeated entries, the intersection does not.
    """

    def counted(df, name):
        return df.groupBy(F.to_date(F.col(date)).alias(date)).agg(F.count(F.lit(1)).alias(name))

    days = counted(primary, "_p").join(counted(secondary, "_s"), date, "full_outer")
    both = (F.col("_p").isNotNull() & F.col("_s").isNotNull()).cast("int")
    seasonal = days.groupBy(season_of(date).alias("season")).agg(
        F.sum(F.coalesce("_p", F.lit(0))).alias("_p"), F.sum(F.coalesce("_s", F.lit(0))).alias("_s"), F.sum(both).alias("_c")
    )
    long = seasonal.withColumn("season", F.explode(F.array(F.lit("annual"), F.col("season"))))
    totals = long.groupBy("season").agg(
        F.sum("_p").alias("n_primary"), F.sum("_s").alias("n_secondary"), F.sum("_c").alias("n_common")
    )
    share = F.when(F.col("n_primary") > 0, 100.0 * F.col("n_common") / F.col("n_primary"))
    return totals.withColumn("common_pct", share)


def expand_intervals(intervals: DataFrame, start: str = "start_date", end: str = "end_date", distinct: bool = False) -> DataFrame:
    """Every day of every interval, both ends included. Overlaps repeat unless ``distinct``."""
    a, b = F.to_date(start), F.to_date(end)
    days = intervals.where(b >= a).withColumn("date", F.explode(F.sequence(a, b)))
    return days.select("date").distinct() if distinct else days


def time_union(*parts: DataFrame) -> DataFrame:
    """Several pieces as one continuous record; sort at the sink if needed."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def last_time(df: DataFrame, time: str = "time") -> DataFrame:
    return df.agg(F.max(time).alias("last_time"))
