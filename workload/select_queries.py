"""Projections, filters, predicates and scalar functions."""

from pyspark.sql import functions as F

from fieldloom.functions import scalars
from fieldloom.functions.regions import REGIONS, region_table
from fieldloom.operators import rotation, select
from fieldloom.operators.quantiles import percentile_by_axis
from workload import views
from workload.registry import query

CELLS = "time:d lat lon value:6"


@query("region_box", CELLS, "SELECT * FROM obs WHERE lat BETWEEN -75 AND -60 AND lon BETWEEN 180 AND 310")
def _(spark, d):
    return select.region_box(views.obs(spark, d), "asl")


@query("region_box_wrap", CELLS, "SELECT * FROM obs WHERE lat BETWEEN -40 AND 0 AND (lon >= 300 OR lon <= 60)")
def _(spark, d):
    return select.region_box(views.obs(spark, d), (-40, 0, 300, 420), wrap=True)


@query("point_or_slice", CELLS, "SELECT * FROM obs WHERE lat = -40 AND lon BETWEEN 90 AND 200")
def _(spark, d):
    return select.point_or_slice(views.obs(spark, d), lat=(-40.0, -40.0), lon=(90.0, 200.0))


@query("time_range", CELLS, "SELECT * FROM obs WHERE CAST(time AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'")
def _(spark, d):
    return select.time_range(views.obs(spark, d), "1997-03-01", "1998-02-28")


@query("time_range_day", "time:t event_type:s value:4", "SELECT * FROM stream WHERE CAST(time AS DATE) = DATE '2024-01-10'")
def _(spark, d):
    return select.time_range(views.stream(spark, d), "2024-01-10", "2024-01-10")


@query("year_filter", "time:d value:6 n:i", "SELECT * FROM series WHERE year(time) BETWEEN 1996 AND 1998")
def _(spark, d):
    return select.year_filter(views.series(spark, d), 1996, 1998)


@query("season_filter", "time:d value:6 n:i", "SELECT * FROM series WHERE month(time) IN (12, 1, 2)")
def _(spark, d):
    return select.season_filter(views.series(spark, d), "DJF")


@query("max_latitude", CELLS, "SELECT * FROM obs WHERE lat <= -45")
def _(spark, d):
    return select.max_latitude(views.obs(spark, d), -45.0)


@query(
    "level_select",
    "time:d level lat value:6",
    "SELECT *, CAST(l AS DOUBLE) AS level FROM (SELECT l_shipdate AS time, l_linenumber * 100 AS l, "
    "CAST(-80 + 5 * (l_suppkey % 17) AS DOUBLE) AS lat, ln(l_extendedprice) AS value FROM lineitem) WHERE l BETWEEN 250 AND 500",
)
def _(spark, d):
    items = views.table(spark, d, "lineitem").select(
        F.col("l_shipdate").alias("time"),
        (F.col("l_linenumber") * 100).cast("double").alias("level"),
        (-80 + 5 * (F.col("l_suppkey") % 17)).cast("double").alias("lat"),
        F.log("l_extendedprice").alias("value"),
    )
    return select.level_select(items, low=250.0, high=500.0)


@query(
    "nearest_label",
    "target:1 lat",
    "SELECT t AS target, (SELECT lat FROM obs ORDER BY abs(lat - t), lat LIMIT 1) AS lat FROM (VALUES (-41.0), (-62.5), (7.0)) v(t)",
)
def _(spark, d):
    return select.nearest_label(views.obs(spark, d), "lat", [-41.0, -62.5, 7.0])


@query(
    "zero_outside_lon",
    CELLS,
    "SELECT time, lat, lon, CASE WHEN lon <= 110 OR lon >= 240 THEN 0 ELSE value END AS value FROM field",
)
def _(spark, d):
    return select.zero_outside_lon(views.field(spark, d), 110, 240)


@query(
    "zero_outside_lon_keep_ends",
    CELLS,
    "SELECT time, lat, lon, CASE WHEN lon < 110 OR lon > 240 THEN 0 ELSE value END AS value FROM field",
)
def _(spark, d):
    return select.zero_outside_lon(views.field(spark, d), 110, 240, zero_ends=False)


@query("threshold_dates", "time:d", "SELECT time FROM series WHERE value >= (SELECT quantile_cont(value, 0.9) FROM series)")
def _(spark, d):
    return select.threshold_dates(views.series(spark, d), "90pct")


@query("threshold_dates_raw", "time:d", "SELECT time FROM series WHERE value * value / n <= 240")
def _(spark, d):
    mean_price = views.series(spark, d).withColumn("value", F.col("value") * F.col("value") / F.col("n"))
    return select.threshold_dates(mean_price, 240, "less")


@query("percentile_by_axis", "lat lon percentile:6", "SELECT lat, lon, quantile_cont(value, 0.9) AS percentile FROM obs GROUP BY ALL")
def _(spark, d):
    return percentile_by_axis(views.obs(spark, d), 90)


@query("phase_filter", "time:d wave6_phase:2", "SELECT * FROM waves WHERE wave6_phase > 10 AND wave6_phase < 25")
def _(spark, d):
    return select.phase_filter(views.waves(spark, d), 10, 25)


@query("phase_filter_wrapped", "time:d wave6_phase:2", "SELECT * FROM waves WHERE wave6_phase > 50 OR wave6_phase < 10")
def _(spark, d):
    return select.phase_filter(views.waves(spark, d), 50, 70)


@query("sign_change_filter", "time:d sign_count:i", "SELECT * FROM waves WHERE sign_count <= 6")
def _(spark, d):
    return select.sign_change_filter(views.waves(spark, d), 6)


@query("clamp", CELLS, "SELECT time, lat, lon, greatest(8.5, least(10.5, value)) AS value FROM obs")
def _(spark, d):
    return select.clamp_values(views.obs(spark, d), 8.5, 10.5)


@query("magnitude_abs", CELLS, "SELECT time, lat, lon, abs(value - 10) AS value FROM obs")
def _(spark, d):
    centred = select.convert_units(views.obs(spark, d), offset=-10.0)
    return select.absolute_values(centred)


@query("unit_convert", CELLS, "SELECT time, lat, lon, value / 9.80665 + 1 AS value FROM obs")
def _(spark, d):
    return select.convert_units(views.obs(spark, d), 1 / 9.80665, 1.0)


@query(
    "unpack_scale_offset",
    "time:d value:6",
    "SELECT l_shipdate AS time, 273.15 + (l_partkey % 32768) * 0.0317 AS value FROM lineitem",
)
def _(spark, d):
    packed = views.table(spark, d, "lineitem").select(
        F.col("l_shipdate").alias("time"), (F.col("l_partkey") % 32768).alias("value")
    )
    return select.unpack_scale_offset(packed, 0.0317, 273.15)


@query("reorient_axes", CELLS, "SELECT * FROM obs")
def _(spark, d):
    west = views.obs(spark, d).withColumn("lon", scalars.adjust_lon("lon", -180.0))
    return select.reorient_axes(west)


@query("rename_variable", "time:d lat lon tas:6", "SELECT time, lat, lon, value AS tas FROM obs")
def _(spark, d):
    return select.rename_variable(views.obs(spark, d), "value", "tas", units="K", long_name="surface_air_temperature")


@query(
    "thin_stride",
    "time:d value:6",
    "SELECT time, value FROM (SELECT *, row_number() OVER (ORDER BY time) - 1 AS i FROM series) WHERE i % 7 = 0",
)
def _(spark, d):
    return select.thin_stride(views.series(spark, d), 7)


@query(
    "select_timestep_or_mean",
    "lat lon value:6",
    "SELECT lat, lon, value FROM field WHERE time = (SELECT DISTINCT time FROM months ORDER BY time LIMIT 1 OFFSET 12)",
)
def _(spark, d):
    return select.time_slice_or_mean(views.field(spark, d), 12)


@query("select_time_mean", "lat lon value:6", "SELECT lat, lon, avg(value) AS value FROM obs GROUP BY ALL")
def _(spark, d):
    return select.time_slice_or_mean(views.obs(spark, d))


@query("significance_mask", "lat lon p:6 significant:b", """
    SELECT *, p BETWEEN 0 AND 0.05 AS significant FROM (
        SELECT lat, lon, exp(-abs(avg(value) - 10.2) * 50) AS p FROM obs GROUP BY ALL)""")
def _(spark, d):
    fake = views.obs(spark, d).groupBy("lat", "lon").agg(F.exp(-F.abs(F.avg("value") - 10.2) * 50).alias("p"))
    return select.significance_mask(fake)


# Scalar functions.


@query(
    "adjust_lon",
    "l_orderkey:i l_linenumber:i deg0:6 deg180:6 rad:9",
    """SELECT l_orderkey, l_linenumber, raw - 360 * floor(raw / 360) AS deg0,
              (raw + 180) - 360 * floor((raw + 180) / 360) - 180 AS deg180,
              radians(raw) - 2 * pi() * floor(raw / 360) AS rad
       FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 1500 AS DOUBLE) - 810.25 AS raw FROM lineitem)""",
)
def _(spark, d):
    raw = (F.col("l_partkey") % 1500).cast("double") - 810.25
    return views.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        scalars.adjust_lon(raw).alias("deg0"),
        scalars.adjust_lon(raw, -180.0).alias("deg180"),
        scalars.adjust_lon(F.radians(raw), radians=True).alias("rad"),
    )


@query("date_only", "event_id:i date:d", "SELECT event_id, CAST(ts AS DATE) AS date FROM events")
def _(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return views.table(spark, d, "events").select("event_id", scalars.date_only(text).alias("date"))


@query("standard_date", "event_id:i text:s date:s", """
    SELECT event_id, text, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date FROM (
        SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
            WHEN 2 THEN strftime(ts, '%Y/%m/%d') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS text FROM events)""")
def _(spark, d):
    kind = F.col("event_id") % 4
    layouts = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss"]
    text = F.coalesce(*[F.when(kind == i, F.date_format("ts", layout)) for i, layout in enumerate(layouts)])
    rows = views.table(spark, d, "events").select("event_id", text.alias("text"))
    return rows.withColumn("date", scalars.standard_date("text"))


@query("season_of", "time:d season:s", "SELECT time, season FROM series JOIN seasons ON month(time) = mon")
def _(spark, d):
    return views.series(spark, d).select("time", scalars.season_of("time").alias("season"))


@query(
    "climatology_key",
    "time:d by_month:i by_day:i by_date:i",
    "SELECT time, month(time) AS by_month, dayofyear(time) AS by_day, month(time) * 100 + day(time) AS by_date FROM series",
)
def _(spark, d):
    key = scalars.climatology_key
    return views.series(spark, d).select(
        "time",
        key("time", "monthly").alias("by_month"),
        key("time", "daily").alias("by_day"),
        key("time", "monthday").alias("by_date"),
    )


@query(
    "run_label",
    "p_partkey:i run:s",
    "SELECT p_partkey, 'r' || (p_partkey % 10) || 'i' || (p_size % 3) || 'p' || (p_size % 2) AS run FROM part",
)
def _(spark, d):
    return views.table(spark, d, "part").select(
        "p_partkey", scalars.run_label(F.col("p_partkey") % 10, F.col("p_size") % 3, F.col("p_size") % 2).alias("run")
    )


@query("run_details", "p_partkey:i model:s experiment:s run:s", """
    SELECT p_partkey, 'M' || (p_partkey % 7) AS model, CASE WHEN p_size % 2 = 0 THEN 'historical' ELSE 'control' END AS experiment,
           'r' || (p_partkey % 10) || 'i' || (p_size % 3) || 'p' || (p_size % 2) AS run FROM part""")
def _(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    model, experiment = F.concat(F.lit("M"), (key % 7).cast("string")), F.when(size % 2 == 0, "historical").otherwise("control")
    return views.table(spark, d, "part").select("p_partkey", scalars.run_details(model, experiment, key % 10, size % 3, size % 2).alias("r")).select("p_partkey", "r.*")


@query("local_date", "event_id:i date:d", """
    SELECT event_id, CAST(ts + to_hours(CASE event_id % 3 WHEN 0 THEN 10 WHEN 1 THEN -8 ELSE 0 END) AS DATE) AS date FROM events""")
def _(spark, d):
    zone = F.when(F.col("event_id") % 3 == 0, "+10:00").when(F.col("event_id") % 3 == 1, "-08:00").otherwise("UTC")
    return views.table(spark, d, "events").select("event_id", scalars.local_date("ts", zone).alias("date"))


@query("wind_speed", "time:d lat lon spd:6", "SELECT time, lat, lon, sqrt(u * u + v * v) AS spd FROM wind")
def _(spark, d):
    return views.wind(spark, d).withColumn("spd", scalars.wind_speed("u", "v"))


@query("planetary_vorticity", "time:d lat lon pvrt:12", "SELECT time, lat, lon, 2 * 7.292e-5 * sin(radians(lat)) AS pvrt FROM obs")
def _(spark, d):
    return views.obs(spark, d).withColumn("pvrt", scalars.planetary_vorticity("lat"))


_POLE = "sin(radians(20)) AS sp, cos(radians(20)) AS cp"


@query("rotate_coordinates", "time:d lat lon rot_lat:6 rot_lon:6 back_lat:6 back_lon:6", f"""
    SELECT time, lat, lon, degrees(asin(greatest(-1, least(1, zz)))) AS rot_lat,
           (degrees(atan2(yy, xx)) + 360) % 360 AS rot_lon, lat AS back_lat, lon AS back_lon
    FROM (SELECT time, lat, lon, cp * sin(radians(lat)) - sp * cos(radians(lat)) * cos(radians(lon - 260)) AS xx,
                 -cos(radians(lat)) * sin(radians(lon - 260)) AS yy,
                 sp * sin(radians(lat)) + cp * cos(radians(lat)) * cos(radians(lon - 260)) AS zz
          FROM (SELECT time, lat, lon + 0.5 AS lon, {_POLE} FROM obs))""")
def _(spark, d):
    moved = views.obs(spark, d).withColumn("lon", F.col("lon") + 0.5)
    there = rotation.rotate_points(moved)
    back_lat, back_lon = rotation.rotate_coordinates("rot_lat", "rot_lon", invert=True)
    return there.withColumn("back_lat", back_lat).withColumn("back_lon", back_lon)


@query(
    "region_table",
    "name:s south north west east n_cells:i",
    "SELECT r.*, count(o.lat) AS n_cells FROM (VALUES "
    + ", ".join(f"('{n}', {b.south}, {b.north}, {b.west}, {b.east})" for n, b in REGIONS.items())
    + ") r(name, south, north, west, east) LEFT JOIN obs o ON o.lat BETWEEN south AND north AND o.lon BETWEEN west AND east GROUP BY ALL",
)
def _(spark, d):
    from fieldloom.functions.regions import region_column

    cells = views.obs(spark, d).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"))
    counts = cells.withColumn("name", F.explode(region_column(list(REGIONS)))).groupBy("name").agg(F.sum("n").alias("n_cells"))
    return region_table(spark).join(counts, "name", "left").fillna(0, ["n_cells"])
