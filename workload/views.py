"""Fields, series, date lists and events derived from the supplied tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _month(c: str) -> Column:
    return F.trunc(F.col(c).cast("date"), "month").cast("timestamp_ntz")


def _axis(start: float, step: float, index: Column | str) -> Column:
    return (F.lit(float(start)) + F.lit(float(step)) * index).cast("double")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("time"),
        _axis(-80, 5, F.col("l_suppkey") % 17).alias("lat"),
        _axis(0, 10, F.col("l_partkey") % 36).alias("lon"),
        F.log("l_extendedprice").alias("value"),
    )


def tropics_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        _month("l_shipdate").alias("time"),
        _axis(-10, 5, F.col("l_suppkey") % 5).alias("lat"),
        _axis(0, 10, F.col("l_partkey") % 36).alias("lon"),
        F.log("l_extendedprice").alias("value"),
    )


def _cell_month(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    keys = [_month("l_shipdate").alias("time"), (F.col("l_suppkey") % 17).alias("li"), (F.col("l_partkey") % 36).alias("lj")]
    return items.groupBy(*keys).agg(F.avg(column).alias("mean"))


def _dense(cells: DataFrame) -> DataFrame:
    """Every month with every cell; cells without line items have a NULL mean."""
    empty = (
        cells.select("time")
        .distinct()
        .withColumn("li", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(16).cast("long"))))
        .withColumn("lj", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(35).cast("long"))))
    )
    return empty.join(cells, ["time", "li", "lj"], "left")


def _month_index() -> Column:
    return (F.year("time") - 1994) * 12 + F.month("time")


def _fill() -> Column:
    """Value of a cell without line items."""
    return 20 + F.sin(7.0 * F.col("li") + 3.0 * F.col("lj") * F.col("lj"))


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _dense(_cell_month(spark, sf_dir, "l_extendedprice"))
    lat, lon = _axis(-80, 5, F.col("li")), _axis(0, 10, F.col("lj"))
    wave = 10 * F.cos(F.radians(lon * 3) - 0.5 * _month_index()) * F.cos(F.radians(lat))
    return grid.select("time", lat.alias("lat"), lon.alias("lon"), (F.coalesce(F.sqrt("mean") / 10, _fill()) + wave).alias("value"))


def field_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _dense(_cell_month(spark, sf_dir, "l_quantity"))
    lat, lon = _axis(-80, 5, F.col("li")), _axis(0, 10, F.col("lj"))
    wave = 5 * F.sin(F.radians(lon * 2) + 0.3 * _month_index())
    return grid.select("time", lat.alias("lat"), lon.alias("lon"), (F.coalesce(F.sqrt("mean"), _fill()) + wave).alias("value"))


WIND_LATS, WIND_LONS = 19, 36


def wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global wind of a known streamfunction, potential and solid rotation, with monthly amplitudes."""
    months = table(spark, sf_dir, "lineitem").groupBy(_month("l_shipdate").alias("time")).agg(
        F.sqrt(F.avg("l_quantity")).alias("a"), F.log(F.avg("l_extendedprice")).alias("b"), F.log(1 + F.count(F.lit(1))).alias("m")
    )
    cells = (
        months.withColumn("li", F.explode(F.sequence(F.lit(0), F.lit(WIND_LATS - 1))))
        .withColumn("lj", F.explode(F.sequence(F.lit(0), F.lit(WIND_LONS - 1))))
        .withColumn("lat", _axis(-90, 10, F.col("li")))
        .withColumn("lon", _axis(0, 10, F.col("lj")))
    )
    s, c, x = F.sin(F.radians("lat")), F.cos(F.radians("lat")), F.radians("lon")
    u = -F.col("a") * F.cos(2 * x) * (c * c * c - 2 * c * s * s) - F.col("b") * s * F.sin(x) + F.col("m") * c
    v = -2 * F.col("a") * c * s * F.sin(2 * x) + F.col("b") * F.cos(x) * (c * c - s * s)
    return cells.select("time", "lat", "lon", u.alias("u"), v.alias("v"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderdate").alias("time")).agg(
        F.sqrt(F.sum("o_totalprice") / 1000).alias("value"), F.count(F.lit(1)).alias("n")
    )


def series_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(F.col("l_shipdate").alias("time")).agg(
        (F.sqrt(F.sum(F.col("l_quantity") * F.col("l_extendedprice"))) / 100).alias("value")
    )


def urgent_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date list with repeats: one entry per matching order."""
    orders = table(spark, sf_dir, "orders")
    picked = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 350000)
    return orders.where(picked).select(F.to_date("o_orderdate").alias("date"))


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("time")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("o_orderkey").alias("keys")
    )
    amps = [((F.col("cnt") * k * 37 + F.col("keys")) % 101).cast("double").alias(f"wave{k}_amp") for k in range(1, 11)]
    return days.select(
        "time",
        *amps,
        ((F.col("keys") % 80) * 0.75).alias("wave6_phase"),
        (F.col("keys") % 12).alias("sign_count"),
        F.log(1 + F.col("keys")).alias("env_max"),
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderdate")
    length = F.make_dt_interval(days=(F.col("o_orderkey") % 5).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), start.alias("start_ts"), (start + length).alias("end_ts")
    )


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("ts").alias("time"), "event_type", "value", "user_id")


def rank_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two orthogonal patterns times two orthogonal monthly series taken from the line items."""
    items = table(spark, sf_dir, "lineitem")
    cells = items.groupBy(
        _month("l_shipdate").alias("time"), (F.col("l_suppkey") % 17).alias("li"), (F.col("l_partkey") % 36).alias("lj")
    ).agg(F.sqrt(F.avg("l_quantity")).alias("quantity"), (F.sqrt(F.avg("l_extendedprice")) / 10).alias("price"))
    months = cells.groupBy("time").agg((F.avg("quantity") * 4).alias("a"), (F.avg("price") / 10).alias("b"))
    means = months.agg(
        F.avg("a").alias("ma"), F.avg("b").alias("mb"), (F.covar_pop("a", "b") / F.var_pop("a")).alias("slope")
    )
    a1 = F.col("a") - F.col("ma")
    pair = months.join(F.broadcast(means), F.lit(True)).select(  # one row
        "time", a1.alias("a1"), (F.col("b") - F.col("mb") - a1 * F.col("slope")).alias("a2")
    )
    cells = pair.withColumn("lat", F.explode(F.array(*[F.lit(-60.0 + 15 * i) for i in range(5)]))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(11)))
    )
    lon = F.col("j") * 30.0
    p1 = F.cos(F.radians(lon)) + 0.5 * F.cos(F.radians(lon * 2))
    p2 = F.cos(F.radians(lon * 3)) + 0.5 * F.cos(F.radians(lon * 4))
    return cells.select("time", "lat", lon.alias("lon"), (F.col("a1") * p1 + F.col("a2") * p2).alias("value"))
