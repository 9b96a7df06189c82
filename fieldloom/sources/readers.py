"""Scans: fields, date lists, interval tables and monthly text tables.

Text parsers take a DataFrame of lines (column ``value``, as ``spark.read.text``
gives) so they work on files and on derived lines alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = ("time", "level", "lat", "lon")


def scan_field(spark: SparkSession, path: str, var: str, dims: Sequence[str] | None = None) -> DataFrame:
    """One variable of a Parquet dataset with its dimensions; NaN becomes NULL."""
    table = spark.read.parquet(path)
    return as_field(table, var, dims)


def as_field(table: DataFrame, var: str, dims: Sequence[str] | None = None) -> DataFrame:
    dims = [d for d in (dims or DIMS) if d in table.columns]
    value = F.col(var).cast("double")
    return table.select(*dims, F.when(~F.isnan(value), value).alias("value"))


def scan_multi_file(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several files as one record; columns that some files lack are NULL there."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def parse_date_list(lines: DataFrame) -> DataFrame:
    """``(date)`` from one date or timestamp per line; blank lines are skipped."""
    text = F.trim("value")
    return lines.where(text != "").select(F.to_date(F.substring_index(text, "T", 1)).alias("date"))


def scan_date_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_date_list(spark.read.text(path))


# What a line of data begins with, by layout.
DATA_LINES = {"date_list": r"^\s*\d{4}-\d{2}-\d{2}", "event_intervals": r"^\d{4}-\d{2}-\d{2},", "wide_monthly": r"^\s*\d{4}\s", "metric_table": r"^\s*\d{4}\s+\d{1,2}\s"}


def unread_lines(lines: DataFrame, layout: str) -> DataFrame:
    """``(value, lines)``: the different lines that a parser leaves out as headings or notes, with how often each comes; blank lines are not listed."""
    left = lines.where((F.trim("value") != "") & ~F.col("value").rlike(DATA_LINES[layout]))
    return left.groupBy("value").agg(F.count(F.lit(1)).alias("lines"))


INTERVAL_SCHEMA = "start string, start_time string, end string, end_time string, flag string"


def parse_event_intervals(lines: DataFrame, region: Column | None = None) -> DataFrame:
    """``(region, start_ts, end_ts, flag)``; the title and heading lines do not begin with a date."""
    fields = F.from_csv("value", INTERVAL_SCHEMA, {"mode": "PERMISSIVE"})
    rows = lines.where(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2},")).withColumn("_f", fields)

    def stamp(day: str, clock: str) -> Column:
        return F.to_timestamp_ntz(F.concat_ws(" ", F.trim(f"_f.{day}"), F.trim(f"_f.{clock}")), F.lit("yyyy-MM-dd HH:mm"))

    flag = F.nullif(F.trim("_f.flag"), F.lit(""))
    columns = [stamp("start", "start_time").alias("start_ts"), stamp("end", "end_time").alias("end_ts"), flag.alias("flag")]
    return rows.select(*([region.alias("region")] if region is not None else []), *columns)


def scan_event_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Interval CSV files; the region is the file name up to its first underscore."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return parse_event_intervals(spark.read.text(path), F.substring_index(name, "_", 1))


def _mid_month(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(15))


def parse_wide_monthly(lines: DataFrame) -> DataFrame:
    """``(date, value)`` from lines of a year and up to twelve months; missing months are dropped."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.trim("value").rlike(r"^\d{4}\s")).select(
        F.get(cells, F.lit(0)).cast("int").alias("_y"), F.posexplode(F.slice(cells, 2, 12)).alias("_m", "_text")
    )
    value = F.expr("try_cast(_text AS double)")
    out = rows.select(_mid_month(F.col("_y"), F.col("_m") + 1).alias("date"), value.alias("value"))
    return out.where(F.col("value").isNotNull() & ~F.isnan("value"))


def scan_wide_monthly(spark: SparkSession, path: str) -> DataFrame:
    return parse_wide_monthly(spark.read.text(path))


# The columns after year and month.
METRICS = ("nino12", "nino12_anom", "nino3", "nino3_anom", "nino4", "nino4_anom", "nino34", "nino34_anom")


def parse_metric_table(lines: DataFrame, metric: str) -> DataFrame:
    """``(date, value)`` of one metric from lines keyed by year and month; other lines are headings."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.trim("value").rlike(r"^\d{4}\s+\d{1,2}\s")).select(
        F.get(cells, F.lit(0)).cast("int").alias("_y"),
        F.get(cells, F.lit(1)).cast("int").alias("_m"),
        F.get(cells, F.lit(2 + METRICS.index(metric))).alias("_text"),
    )
    value = F.expr("try_cast(_text AS double)")
    out = rows.select(_mid_month(F.col("_y"), F.col("_m")).alias("date"), value.alias("value"))
    return out.where(F.col("value").isNotNull() & ~F.isnan("value"))


def scan_metric_table(spark: SparkSession, path: str, metric: str) -> DataFrame:
    return parse_metric_table(spark.read.text(path), metric)


def filename_metadata(df: DataFrame, name: Column | None = None) -> DataFrame:
    """Parts of ``<var>_<dataset>_<level>_<time>_<spatial>`` file names, with the finer parts of time and space.

    The time part is ``step-aggregation-season`` and the spatial part
    ``grid-region-bounds-np``. A season, bounds and a pole are told from the other
    pieces by their own form, so an aggregation such as ``anom-wrt-all`` stays whole.
    """
    name = F.input_file_name() if name is None else name
    base = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[A-Za-z0-9]+$", "")
    parts = F.split(base, "_")

    def piece(i: int) -> Column:
        return F.get(parts, F.lit(i))

    def found(text: str, pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(F.col(text), pattern, group), F.lit(""))

    named = df.withColumns(
        {"var": piece(0), "dataset": piece(1), "level": piece(2), "time_part": piece(3), "space_part": piece(4)}
    )
    return named.withColumns(
        {
            "tstep": found("time_part", r"^([^-]+)"),
            "season": found("time_part", r"-([JFMASOND]{2,12})$"),
            "aggregation": found("time_part", r"^[^-]+-(.+?)(?:-[JFMASOND]{2,12})?$"),
            "grid": found("space_part", r"^([^-]+)"),
            "north_pole": found("space_part", r"-(np\d+[NS]\d+[EW])"),
            "bounds": found("space_part", r"-((?:lat|lon)\d.*?|mermax|zonal-anom)(?:-np\d.*)?$"),
            "region": found("space_part", r"^[^-]+-((?!lat\d|lon\d|np\d|mermax|zonal-anom).+?)(?:-(?:lat\d|lon\d|np\d|mermax|zonal-anom).*)?$"),
        }
    )


def decode_epoch_time(df: DataFrame, units: str | Column, number: str = "time", out: str = "time") -> DataFrame:
    """Numeric ``<unit>s since <date> [<clock time>]`` to timestamps; a base without a day starts on the first.

    Units are seconds to weeks, and whole calendar months and years. Any other
    unit, a fraction of a month or year, and a zone offset in the text fail.
    """
    unit_text = F.lit(units) if isinstance(units, str) else units
    full = F.lower(F.regexp_replace(unit_text, r"since (\d{4}-\d{1,2})$", "since $1-01"))
    day = F.to_timestamp_ntz(F.regexp_extract(full, r"since (\d{4}-\d{1,2}-\d{1,2})", 1), F.lit("yyyy-M-d"))
    clock = [F.regexp_extract(full, r"since \S+?[t ](\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d+)?))?", k).try_cast("double") for k in (1, 2, 3)]
    start = sum(F.coalesce(part, F.lit(0.0)) * size for part, size in zip(clock, (3600.0, 60.0, 1.0), strict=True))
    seconds = F.lit(None).cast("double")
    for name, size in (("week", 604800.0), ("day", 86400.0), ("hour", 3600.0), ("min", 60.0), ("sec", 1.0)):
        seconds = F.when(full.startswith(name), size).otherwise(seconds)
    months = F.when(full.startswith("month"), 1).when(full.startswith("year"), 12)
    known = F.when(full.isNull() | seconds.isNotNull() | months.isNotNull(), F.lit(0.0)).otherwise(
        F.raise_error(F.concat(F.lit("unknown unit of time: "), full)).cast("double")
    )
    zoned = full.rlike(r"since \S+?[t ]\s*\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?\s*([+-]\d|z\b|utc|gmt)|since \d{4}-\d{1,2}-\d{1,2}\s+[+-]\d")
    broken = months.isNotNull() & (F.floor(F.col(number).cast("double")) != F.col(number).cast("double"))
    known = known + F.when(zoned, F.raise_error(F.concat(F.lit("zone offset in a unit of time: "), full)).cast("double")).otherwise(F.lit(0.0))
    known = known + F.when(broken, F.raise_error(F.concat(F.lit("fraction of a calendar unit: "), F.col(number).cast("string"), F.lit(" "), full)).cast("double")).otherwise(F.lit(0.0))
    micros = F.round((F.coalesce(F.col(number) * seconds, F.lit(0.0)) + start + known) * 1e6).cast("long")
    shift = F.make_dt_interval(days=F.lit(0), hours=F.lit(0), mins=F.lit(0), secs=(micros / F.lit(1e6)).cast("decimal(18,6)"))
    base = F.when(F.col(number).isNotNull(), day) + F.make_ym_interval(F.lit(0), F.coalesce(F.col(number) * months, F.lit(0)).cast("int"))
    return df.withColumn(out, base + shift)
