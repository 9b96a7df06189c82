"""Named climate indices and the complete workflows."""

from pyspark.sql import functions as F

from fieldloom.operators import indices, spectral
from fieldloom.plans import workflows
from workload import views
from workload.registry import query

BASE = ("1996-01-01", "1999-12-31")

_NINO = """
    SELECT time, value - clim AS anom, value FROM (
        SELECT time, avg(value) AS value FROM tropics_obs WHERE lat BETWEEN {s} AND {n} AND lon BETWEEN {w} AND {e} GROUP BY time) a
    LEFT JOIN (SELECT month(time) AS mon, avg(value) AS clim FROM (
        SELECT time, avg(value) AS value FROM tropics_obs WHERE lat BETWEEN {s} AND {n} AND lon BETWEEN {w} AND {e} GROUP BY time)
        WHERE year(time) BETWEEN 1996 AND 1999 GROUP BY 1) c ON month(a.time) = c.mon"""
_N3 = _NINO.format(s=-5, n=5, w=210, e=270)
_N4 = _NINO.format(s=-5, n=5, w=160, e=210)


@query("index_nino", "time:d nino34:6", f"SELECT time, anom AS nino34 FROM ({_NINO.format(s=-5, n=5, w=190, e=240)})")
def _(spark, d):
    return indices.climate_index("NINO34", views.tropics_obs(spark, d), base=BASE)


@query("index_nino12", "time:d nino12:6", f"SELECT time, anom AS nino12 FROM ({_NINO.format(s=-10, n=0, w=270, e=280)})")
def _(spark, d):
    return indices.climate_index("NINO12", views.tropics_obs(spark, d), base=BASE)


@query("index_nino_new", "time:d ninoCT:6", f"""
    SELECT a.time, a.anom - CASE WHEN a.anom * b.anom > 0 THEN 0.4 ELSE 0 END * b.anom AS ninoCT FROM ({_N3}) a JOIN ({_N4}) b ON a.time = b.time""")
def _(spark, d):
    return indices.climate_index("NINOCT", views.tropics_obs(spark, d), base=BASE)


@query("index_nino_wp", "time:d ninoWP:6", f"""
    SELECT a.time, b.anom - CASE WHEN a.anom * b.anom > 0 THEN 0.4 ELSE 0 END * a.anom AS ninoWP FROM ({_N3}) a JOIN ({_N4}) b ON a.time = b.time""")
def _(spark, d):
    return indices.climate_index("NINOWP", views.tropics_obs(spark, d), base=BASE)


@query("index_sam", "time:d sam:6", """
    WITH z AS (SELECT time, lat, avg(value) AS v FROM field WHERE lat IN (-40, -65) GROUP BY ALL),
         s AS (SELECT time, lat, (v - avg(v) OVER p) / stddev_pop(v) OVER p AS v FROM z WINDOW p AS (PARTITION BY lat, month(time)))
    SELECT a.time, a.v - b.v AS sam FROM s a JOIN s b ON a.time = b.time AND a.lat = -40 AND b.lat = -65""")
def _(spark, d):
    return indices.climate_index("SAM", views.field(spark, d))


@query("index_zw3", "time:d zw3:6", """
    WITH b AS (SELECT r, time, avg(value) AS v FROM field JOIN (VALUES (1, 45, 60), (2, 161, 171), (3, 279, 289)) t(r, w, e)
               ON lon BETWEEN w AND e WHERE lat BETWEEN -50 AND -45 GROUP BY ALL),
         s AS (SELECT r, time, (v - avg(v) OVER p) / stddev_pop(v) OVER p AS v FROM b WINDOW p AS (PARTITION BY r, month(time)))
    SELECT time, sum(v) / 3 AS zw3 FROM s GROUP BY time""")
def _(spark, d):
    return indices.climate_index("ZW3", views.field(spark, d))


@query("index_asl", "time:d asl_value:6 asl_lat asl_lon", """
    SELECT time, value AS asl_value, lat AS asl_lat, lon AS asl_lon FROM (
        SELECT *, row_number() OVER (PARTITION BY time ORDER BY value, lat, lon) AS i FROM obs WHERE lat BETWEEN -75 AND -60 AND lon BETWEEN 180 AND 310) WHERE i = 1""")
def _(spark, d):
    return indices.climate_index("ASL", views.obs(spark, d))


@query("index_mi", "time:d mi:6", "SELECT time, avg(abs(value - 10)) AS mi FROM obs WHERE lat BETWEEN -70 AND -40 GROUP BY time")
def _(spark, d):
    shifted = views.obs(spark, d).withColumn("value", F.col("value") - 10)
    return indices.climate_index("MI", shifted)


@query("index_pwi", "time:d pwi:6", "SELECT * FROM pwi_series")
def _(spark, d):
    return indices.climate_index("PWI", spectral.wave_envelope(views.field(spark, d), 1, 9, 36))


@query("composite_on_high_index", "season:s lat lon value:6 n:i", """
    SELECT season, lat, lon, avg(value) AS value, count(*) AS n FROM (
        SELECT o.*, s.season FROM field_b o JOIN seasons s ON month(o.time) = s.mon UNION ALL SELECT o.*, 'annual' FROM field_b o)
    WHERE CAST(time AS DATE) IN (SELECT date FROM pwi_days) GROUP BY ALL""")
def high_index_composite(spark, d):
    return workflows.composite_on_high_index(views.field(spark, d), views.field_b(spark, d), 36, threshold="75pct")


@query("smoothed_anomaly", "time:d lat lon value:6", """
    SELECT time, lat, lon, m AS value FROM (SELECT *, avg(a) OVER w AS m, count(a) OVER w AS c FROM (
        SELECT time, lat, lon, value - avg(value) OVER (PARTITION BY lat, lon, month(time)) AS a FROM field)
        WINDOW w AS (PARTITION BY lat, lon ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE c = 5""")
def _(spark, d):
    return workflows.smoothed_anomaly(views.field(spark, d), 5, key="month")


@query("index_comparison", "top_right:i bottom_right:i bottom_left:i top_left:i slope:6 intercept:6 r:6", """
    WITH p AS (SELECT (a.value - avg(a.value) OVER ()) / stddev_samp(a.value) OVER () AS x, (b.value - avg(b.value) OVER ()) / stddev_samp(b.value) OVER () AS y
               FROM series a JOIN series_b b ON a.time = b.time)
    SELECT round(100.0 * avg(CASE WHEN x >= 0 AND y >= 0 THEN 1 ELSE 0 END)) AS top_right, round(100.0 * avg(CASE WHEN x >= 0 AND y < 0 THEN 1 ELSE 0 END)) AS bottom_right,
           round(100.0 * avg(CASE WHEN x < 0 AND y < 0 THEN 1 ELSE 0 END)) AS bottom_left, round(100.0 * avg(CASE WHEN x < 0 AND y >= 0 THEN 1 ELSE 0 END)) AS top_left,
           regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(x, y) AS r FROM p""")
def _(spark, d):
    x = views.series(spark, d).select("time", F.col("value").alias("x"))
    return workflows.index_comparison(x, views.series_b(spark, d).withColumnRenamed("value", "y"))


@query("wave_event_statistics", "time:d event_number:i event_duration:i event_phase:3 event_gradient:5 wave5_amp:1 wave6_amp:1 sign_count:i")
def _(spark, d):
    from workload.dynamics_queries import rotated_targets

    return workflows.wave_event_statistics(
        views.wind(spark, d), rotated_targets(spark), (-90.0, 10.0, 19), (0.0, 10.0, 36), window=3, lat_band=(-40.0, 40.0), key="month", min_sum=8
    )
