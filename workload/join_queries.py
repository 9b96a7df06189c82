"""Joins, unions and set operations."""

from pyspark.sql import functions as F

from fieldloom.functions.scalars import climatology_key
from fieldloom.operators import align, calendars, rotation, select, stats
from workload import views
from workload.registry import query, shown

CELLS = "time:d lat lon value:6"


@query("date_semi_join", CELLS, "SELECT * FROM obs WHERE CAST(time AS DATE) IN (SELECT date FROM urgent_days)")
def _(spark, d):
    return align.date_semi_join(views.obs(spark, d), views.urgent_days(spark, d))


@query("date_anti_join", CELLS, "SELECT * FROM obs WHERE CAST(time AS DATE) NOT IN (SELECT date FROM urgent_days)")
def _(spark, d):
    return align.date_anti_join(views.obs(spark, d), views.urgent_days(spark, d))


@query(
    "align_series",
    "time:d x:6 y:6",
    "SELECT a.time, a.value AS x, b.value AS y FROM series a JOIN series_b b ON a.time = b.time",
)
def _(spark, d):
    x = views.series(spark, d).select("time", F.col("value").alias("x"))
    return align.align_series(x, views.series_b(spark, d).withColumnRenamed("value", "y"))


@query("climatology_join", CELLS, """
    SELECT time, lat, lon, value / nullif(stddev_pop(value) OVER (PARTITION BY lat, lon, month(time)), 0) AS value
    FROM (SELECT *, value AS v FROM field)""")
def _(spark, d):
    return align.climatology_join(
        views.field(spark, d), climatology_key("time", "month"), by=["lat", "lon"], subtract=False, divide=True
    )


@query("wind_pair_join", "time:d lat lon u:6 v:6", "SELECT a.time, a.lat, a.lon, a.value AS u, b.value AS v FROM field a JOIN field_b b USING (time, lat, lon)")
def _(spark, d):
    return align.wind_pair_join(views.field(spark, d), views.field_b(spark, d))


def _asof(spark, d, method):
    """For every second event of a type the value of one of the others of its type."""
    rows = views.table(spark, d, "events").select(F.col("ts").alias("time"), "event_type", "value", (F.col("event_id") % 2).alias("odd"))
    targets = rows.where("odd = 1").select("event_type", F.col("time").alias("target"))
    return align.asof_select(rows.where("odd = 0").drop("odd"), targets, method, by=["event_type"])


_ASOF = "event_type:s target:t label:t value:4"
_SIDES = """
    WITH lab AS (SELECT event_type, ts AS time, min(value) AS value FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
         tgt AS (SELECT DISTINCT event_type, ts AS target FROM events WHERE event_id % 2 = 1)"""


@query("asof_select", _ASOF, _SIDES + """,
         both_sides AS (SELECT tgt.event_type, target, p.time AS pt, p.value AS pv, n.time AS nt, n.value AS nv
                   FROM tgt ASOF LEFT JOIN lab p ON tgt.event_type = p.event_type AND target >= p.time ASOF LEFT JOIN lab n ON tgt.event_type = n.event_type AND target <= n.time)
    SELECT event_type, target, CASE WHEN use_p THEN pt ELSE nt END AS label, CASE WHEN use_p THEN pv ELSE nv END AS value FROM (
        SELECT *, nt IS NULL OR (pt IS NOT NULL AND epoch_us(target) - epoch_us(pt) <= epoch_us(nt) - epoch_us(target)) AS use_p FROM both_sides)""")
def _(spark, d):
    return _asof(spark, d, "nearest")


@query("asof_select_pad", _ASOF, _SIDES + """
    SELECT tgt.event_type, target, p.time AS label, p.value FROM tgt ASOF LEFT JOIN lab p ON tgt.event_type = p.event_type AND target >= p.time""")
def _(spark, d):
    return _asof(spark, d, "pad")


@query("asof_select_backfill", _ASOF, _SIDES + """
    SELECT tgt.event_type, target, p.time AS label, p.value FROM tgt ASOF LEFT JOIN lab p ON tgt.event_type = p.event_type AND target <= p.time""")
def _(spark, d):
    return _asof(spark, d, "backfill")


@query("interval_join", "time:t id:i value:4", """
    SELECT e.time, e.value, i.event_id AS id FROM stream e JOIN (
        SELECT event_id, ts AS s, ts + to_minutes(CAST(event_id % 30 AS INTEGER)) AS f FROM events) i
    ON e.time BETWEEN i.s AND i.f""", formatted=True)
def _(spark, d):
    # An event lies in many intervals: its time and value are written out before it is paired, but after it has moved.
    rows = views.stream(spark, d).select(F.col("time").alias("at"), "value")
    spans = views.table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("start_ts"),
        (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 30).cast("int"))).alias("end_ts"),
    )
    return align.interval_join(rows, spans, time="at", made={"time": shown("at:t"), "value": shown("value:4")})


@query("event_number_join", "time:d lat lon value:6 event_number:i", """
    SELECT o.time, lat, lon, value, event_number FROM obs o
    LEFT JOIN numbered n ON CAST(o.time AS DATE) = CAST(n.time AS DATE)""")
def _(spark, d):
    from workload.event_queries import numbered_days

    return align.event_number_join(views.obs(spark, d), numbered_days(spark, d))


@query("broadcast_dims", "time:d lat lon value:6 zonal:6", """
    SELECT f.time, f.lat, f.lon, f.value, z.zonal FROM field f
    JOIN (SELECT time, lat, avg(value) AS zonal FROM field_b GROUP BY ALL) z ON z.time = f.time AND z.lat = f.lat""")
def _(spark, d):
    lower = stats.zonal_mean(views.field_b(spark, d)).withColumnRenamed("value", "zonal")
    return align.broadcast_dims(views.field(spark, d), lower, ["time", "lat"])


@query("grid_cross_join", "cell:i lat lon", """
    SELECT a.i * (SELECT count(DISTINCT lon) FROM obs) + b.j AS cell, lat, lon
    FROM (SELECT lat, row_number() OVER (ORDER BY lat) - 1 AS i FROM (SELECT DISTINCT lat FROM obs)) a
    CROSS JOIN (SELECT lon, row_number() OVER (ORDER BY lon) - 1 AS j FROM (SELECT DISTINCT lon FROM obs)) b""")
def _(spark, d):
    cells = views.obs(spark, d)
    return align.grid_pairs(cells.select("lat"), cells.select("lon"))


LAT_AXIS, LON_AXIS = (-80.0, 5.0, 17), (0.0, 10.0, 36)


def _targets(spark, lat_step, n_lat, lat0, lon_step, n_lon, lon0):
    """Cells of a target grid, one row per latitude expanded along longitude."""
    lats = spark.range(n_lat).select((F.lit(float(lat0)) + F.col("id") * lat_step).alias("lat"))
    return lats.withColumn("lon", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_lon - 1)), lambda j: F.lit(float(lon0)) + j * F.lit(float(lon_step)))))


_BILINEAR = """
    SELECT f.time, t.lat, t.lon, sum(f.value * (CASE WHEN f.lat = t.la THEN 1 - t.wa ELSE t.wa END) * (CASE WHEN f.lon = t.lo THEN 1 - t.wo ELSE t.wo END)) AS value
    FROM (SELECT lat, lon, 5.0 * floor(lat / 5) AS la, lat / 5 - floor(lat / 5) AS wa, 10.0 * floor(lon / 10) AS lo, lon / 10 - floor(lon / 10) AS wo
          FROM (SELECT -78.0 + 7 * i AS lat, 4.0 + 9 * j AS lon FROM range(11) a(i), range(40) b(j))) t
    JOIN field f ON f.lat IN (t.la, t.la + 5) AND f.lon IN (t.lo, (t.lo + 10) % 360) GROUP BY ALL"""


@query("sparse_weight_regrid", CELLS, _BILINEAR)
def _(spark, d):
    targets = _targets(spark, 7.0, 11, -78.0, 9.0, 40, 4.0)
    weights = align.bilinear_weights(targets, LAT_AXIS, LON_AXIS)
    return align.sparse_weight_regrid(views.field(spark, d), weights, LAT_AXIS, LON_AXIS)


@query("conservative_regrid", CELLS, """
    SELECT time, lat, lon, sum(value * h * w / area) AS value FROM (
        SELECT (sin(radians(t.lat + 5)) - sin(radians(t.lat - 5))) * 15 AS area, f.time, t.lat, t.lon, f.value,
               sin(radians(least(t.lat + 5, f.lat + 2.5))) - sin(radians(greatest(t.lat - 5, f.lat - 2.5))) AS h,
               least(t.lon + 7.5, f.flon + 5) - greatest(t.lon - 7.5, f.flon - 5) AS w
        FROM (SELECT CAST(-70 + 10 * i AS DOUBLE) AS lat, CAST(15 * j AS DOUBLE) AS lon FROM range(7) a(i), range(24) b(j)) t
        JOIN (SELECT *, lon AS flon FROM field UNION ALL SELECT *, lon - 360 FROM field) f
        ON f.lat + 2.5 > t.lat - 5 AND f.lat - 2.5 < t.lat + 5 AND f.flon + 5 > t.lon - 7.5 AND f.flon - 5 < t.lon + 7.5)
    GROUP BY ALL""")
def _(spark, d):
    targets = _targets(spark, 10.0, 7, -70.0, 15.0, 24, 0.0)
    weights = align.conservative_weights(targets, LAT_AXIS, LON_AXIS, 10.0, 15.0)
    return align.sparse_weight_regrid(views.field(spark, d), weights, LAT_AXIS, LON_AXIS)


_SECOND = """
    WITH src AS (SELECT time, lat, lon, value, CAST((lat + 80) / 5 AS INTEGER) AS i, (sin(radians(lat - 2.5)) + sin(radians(lat + 2.5))) / 2 AS mid FROM field),
    sloped AS (
        SELECT *, (coalesce(lead(value) OVER up, value) - coalesce(lag(value) OVER up, value)) / (coalesce(lead(mid) OVER up, mid) - coalesce(lag(mid) OVER up, mid)) AS gn,
               (coalesce(lead(value) OVER around, first_value(value) OVER around) - coalesce(lag(value) OVER around, last_value(value) OVER (around ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) / 20 AS ge
        FROM src WINDOW up AS (PARTITION BY time, lon ORDER BY lat), around AS (PARTITION BY time, lat ORDER BY lon)),
    turned AS (SELECT *, lon AS flon FROM sloped UNION ALL SELECT *, lon - 360 FROM sloped),
    overlap AS (
        SELECT f.time, t.lat, t.lon, f.value, gn, ge, mid, flon, (sin(radians(t.lat + 5)) - sin(radians(t.lat - 5))) * 15 AS area,
               sin(radians(least(t.lat + 5, f.lat + 2.5))) AS top, sin(radians(greatest(t.lat - 5, f.lat - 2.5))) AS bottom,
               least(t.lon + 7.5, f.flon + 5) AS e, greatest(t.lon - 7.5, f.flon - 5) AS w
        FROM (SELECT CAST(-70 + 10 * i AS DOUBLE) AS lat, CAST(15 * j AS DOUBLE) AS lon FROM range(7) a(i), range(24) b(j)) t
        JOIN turned f ON f.lat + 2.5 > t.lat - 5 AND f.lat - 2.5 < t.lat + 5 AND f.flon + 5 > t.lon - 7.5 AND f.flon - 5 < t.lon + 7.5)
    SELECT time, lat, lon, sum((top - bottom) * (e - w) / area * (value + gn * ((top + bottom) / 2 - mid) + ge * ((e + w) / 2 - flon))) AS value FROM overlap GROUP BY ALL"""


@query("conservative_regrid_second", CELLS, _SECOND)
def _(spark, d):
    targets = _targets(spark, 10.0, 7, -70.0, 15.0, 24, 0.0)
    weights = align.conservative_weights(targets, LAT_AXIS, LON_AXIS, 10.0, 15.0, order=2)
    return align.sparse_weight_regrid(views.field(spark, d), weights, LAT_AXIS, LON_AXIS)


# Set operations.


@query("date_intersect", "date:d", "SELECT date FROM high_days INTERSECT SELECT date FROM urgent_days")
def _(spark, d):
    high = select.threshold_dates(views.series(spark, d), "75pct").select(F.to_date("time").alias("date"))
    return calendars.date_intersect(high, views.urgent_days(spark, d))


@query("time_union", "time:d value:6", "SELECT time, value FROM series")
def _(spark, d):
    days = views.series(spark, d).drop("n")
    early, late = select.time_range(days, end="1997-12-31"), select.time_range(days, start="1998-01-01")
    return calendars.time_union(late, early)


@query("last_time", "last_time:t", "SELECT max(l_shipdate) AS last_time FROM lineitem")
def _(spark, d):
    return calendars.last_time(views.obs(spark, d))


@query("rotated_box_filter", CELLS, """
    SELECT time, lat, lon, value FROM (
        SELECT *, degrees(asin(greatest(-1, least(1, sp * sin(radians(lat)) + cp * cos(radians(lat)) * cos(radians(lon - 260)))))) AS rlat,
               (degrees(atan2(-cos(radians(lat)) * sin(radians(lon - 260)), cp * sin(radians(lat)) - sp * cos(radians(lat)) * cos(radians(lon - 260)))) + 360) % 360 AS rlon
        FROM (SELECT *, sin(radians(20)) AS sp, cos(radians(20)) AS cp FROM obs))
    WHERE rlat BETWEEN -10 AND 10 AND rlon BETWEEN 115 AND 235""")
def _(spark, d):
    return rotation.rotated_box_filter(views.obs(spark, d))
