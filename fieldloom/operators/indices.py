"""Named climate indices as compositions of the basic operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.scalars import climatology_key
from fieldloom.operators.align import climatology_join
from fieldloom.operators.select import nearest_label, region_box
from fieldloom.operators.stats import argmin_cell, area_mean, meridional_max, region_means, zonal_median

DEFAULT_BASE = ("1981-01-01", "2010-12-31")


def _base_rows(base: tuple[str, str] | None, time: str) -> Column | None:
    if base is None:
        return None
    day = F.to_date(F.col(time))
    return day.between(F.lit(base[0]).cast("date"), F.lit(base[1]).cast("date"))


def index_nino(
    df: DataFrame,
    region: str = "nino34",
    base: tuple[str, str] | None = DEFAULT_BASE,
    timescale: str = "monthly",
    value: str = "value",
    time: str = "time",
) -> DataFrame:
    """Box mean minus its base-period climatology, ``(time, <region>)``."""
    series = area_mean(region_box(df, region), [time], value)
    anomaly = climatology_join(series, climatology_key(time, timescale), value=value, base=_base_rows(base, time))
    return anomaly.withColumnRenamed(value, region)


def index_nino_new(
    df: DataFrame,
    kind: str = "CT",
    base: tuple[str, str] | None = DEFAULT_BASE,
    timescale: str = "monthly",
    value: str = "value",
    time: str = "time",
) -> DataFrame:
    """Cold-tongue (``CT``) or warm-pool (``WP``) index from the nino3 and nino4 anomalies.

    Both boxes come from one pass over the field.
    """
    if kind not in ("CT", "WP"):
        raise ValueError("kind is CT or WP")
    series = region_means(df, ["nino3", "nino4"], time, value)
    anomaly = climatology_join(
        series, climatology_key(time, timescale), by=["region"], value=value, base=_base_rows(base, time), few_groups=True
    )
    pair = anomaly.groupBy(time).agg(
        F.max(F.when(F.col("region") == "nino3", F.col(value))).alias("n3"),
        F.max(F.when(F.col("region") == "nino4", F.col(value))).alias("n4"),
    )
    n3, n4 = F.col("n3"), F.col("n4")
    alpha = F.when(n3 * n4 > 0, 0.4).otherwise(0.0)
    index = n3 - alpha * n4 if kind == "CT" else n4 - alpha * n3
    return pair.select(time, index.alias(f"nino{kind}"))


def index_sam(df: DataFrame, timescale: str = "monthly", value: str = "value", time: str = "time") -> DataFrame:
    """Standardised zonal mean nearest 40S minus the one nearest 65S."""
    circles = nearest_label(df, "lat", [-40.0, -65.0])
    rows = df.select(time, "lat", value).join(F.broadcast(circles), "lat", "inner")  # two rows
    means = rows.groupBy(time, "target").agg(F.avg(value).alias(value))
    norm = climatology_join(means, climatology_key(time, timescale), by=["target"], value=value, divide=True, few_groups=True)
    north = F.max(F.when(F.col("target") == -40.0, F.col(value)))
    south = F.max(F.when(F.col("target") == -65.0, F.col(value)))
    return norm.groupBy(time).agg((north - south).alias("sam"))


def index_zw3(df: DataFrame, timescale: str = "monthly", value: str = "value", time: str = "time") -> DataFrame:
    """Mean of the three standardised box means; NULL unless all three exist."""
    series = region_means(df, ["zw31", "zw32", "zw33"], time, value)
    norm = climatology_join(series, climatology_key(time, timescale), by=["region"], value=value, divide=True, few_groups=True)
    mean = F.when(F.count(value) == 3, F.sum(value) / 3.0)
    return norm.groupBy(time).agg(mean.alias("zw3"))


def index_asl(df: DataFrame, value: str = "value", time: str = "time") -> DataFrame:
    """Lowest value in 60-75S, 180-310E and where it lies."""
    lows = argmin_cell(region_box(df, "asl"), [time], value)
    names = {"min_value": "asl_value", "min_lat": "asl_lat", "min_lon": "asl_lon"}
    return lows.withColumnsRenamed(names)


def index_mi(df: DataFrame, value: str = "value", time: str = "time") -> DataFrame:
    """Mean absolute value over 70-40S."""
    band = df.where(F.col("lat").between(-70, -40))
    return band.groupBy(time).agg(F.avg(F.abs(value)).alias("mi"))


def index_pwi(envelope: DataFrame, value: str = "value", time: str = "time") -> DataFrame:
    """Median over longitude of the 70-40S maximum of a wave envelope."""
    band = envelope.where(F.col("lat").between(-70, -40))
    return zonal_median(meridional_max(band, [time, "lon"], value), [time], value).withColumnRenamed(value, "pwi")


# Name to function, for callers that choose an index by name.
INDICES = {
    "NINO12": lambda df, **kw: index_nino(df, "nino12", **kw),
    "NINO3": lambda df, **kw: index_nino(df, "nino3", **kw),
    "NINO4": lambda df, **kw: index_nino(df, "nino4", **kw),
    "NINO34": lambda df, **kw: index_nino(df, "nino34", **kw),
    "NINOCT": lambda df, **kw: index_nino_new(df, "CT", **kw),
    "NINOWP": lambda df, **kw: index_nino_new(df, "WP", **kw),
    "SAM": index_sam,
    "ZW3": index_zw3,
    "ASL": index_asl,
    "MI": index_mi,
    "PWI": index_pwi,
}


def climate_index(name: str, df: DataFrame, **options) -> DataFrame:
    if name not in INDICES:
        raise ValueError(f"unknown index {name!r}; choose one of {sorted(INDICES)}")
    return INDICES[name](df, **options)
