"""Means, climatologies, composites, significance and series statistics."""

from pyspark.sql import functions as F

from fieldloom.operators import calendars, composite, select, stats
from workload import views
from workload.registry import query, student_p

CELLS = "time:d lat lon value:6"


def high_days(spark, d):
    return select.threshold_dates(views.series(spark, d), "75pct").select(F.to_date("time").alias("date"))


@query("area_mean", "time:d value:6", "SELECT time, avg(value) AS value FROM obs WHERE lat BETWEEN -75 AND -60 AND lon BETWEEN 180 AND 310 GROUP BY time")
def _(spark, d):
    return stats.area_mean(select.region_box(views.obs(spark, d), "asl"))


@query("area_mean_coslat", "time:d value:6", "SELECT time, sum(value * cos(radians(lat))) / sum(cos(radians(lat))) AS value FROM obs GROUP BY time")
def _(spark, d):
    return stats.area_mean(views.obs(spark, d), weight="coslat")


@query("region_means", "region:s time:d value:6", """
    SELECT 'asl' AS region, time, avg(value) AS value FROM obs WHERE lat BETWEEN -75 AND -60 AND lon BETWEEN 180 AND 310 GROUP BY time
    UNION ALL SELECT 'sh', time, avg(value) FROM obs WHERE lat BETWEEN -90 AND 0 AND lon BETWEEN 0 AND 360 GROUP BY time
    UNION ALL SELECT 'aus', time, avg(value) FROM obs WHERE lat BETWEEN -45 AND -10 AND lon BETWEEN 110 AND 160 GROUP BY time""")
def _(spark, d):
    return stats.region_means(views.obs(spark, d), ["asl", "sh", "aus"])


@query("zonal_mean", "time:d lat value:6", "SELECT time, lat, avg(value) AS value FROM obs GROUP BY ALL")
def _(spark, d):
    return stats.zonal_mean(views.obs(spark, d))


@query("meridional_mean", "time:d lon value:6", "SELECT time, lon, avg(value) AS value FROM obs GROUP BY ALL")
def _(spark, d):
    return stats.meridional_mean(views.obs(spark, d))


@query("meridional_max", "time:d lon value:6", "SELECT time, lon, max(value) AS value FROM obs GROUP BY ALL")
def _(spark, d):
    return stats.meridional_max(views.obs(spark, d))


@query("zonal_median", "time:d value:6", "SELECT time, median(value) AS value FROM (SELECT time, lon, max(value) AS value FROM obs GROUP BY ALL) GROUP BY time")
def _(spark, d):
    return stats.zonal_median(stats.meridional_max(views.obs(spark, d)))


@query("argmin_cell", "time:d min_value:6 min_lat min_lon", """
    SELECT time, value AS min_value, lat AS min_lat, lon AS min_lon FROM (
        SELECT *, row_number() OVER (PARTITION BY time ORDER BY value, lat, lon) AS i FROM obs) WHERE i = 1""")
def _(spark, d):
    return stats.argmin_cell(views.obs(spark, d))


@query("climatology", "key:i lat lon clim_mean:6", "SELECT month(time) AS key, lat, lon, avg(value) AS clim_mean FROM obs WHERE year(time) BETWEEN 1996 AND 1999 GROUP BY ALL")
def _(spark, d):
    base = F.year("time").between(1996, 1999)
    return stats.climatology(views.obs(spark, d), "monthly", base=base)


@query("climatology_daily", "key:i clim_mean:6", "SELECT dayofyear(time) AS key, avg(value) AS clim_mean FROM obs GROUP BY ALL")
def _(spark, d):
    return stats.climatology(views.obs(spark, d), "daily", by=[])


@query("climatology_std", "key:i lat lon clim_std:6", "SELECT month(time) AS key, lat, lon, stddev_pop(value) AS clim_std FROM obs GROUP BY ALL")
def _(spark, d):
    return stats.climatology(views.obs(spark, d), "monthly")


@query("yday_anomaly", CELLS, "SELECT time, lat, lon, value - avg(value) OVER (PARTITION BY lat, lon, dayofyear(time)) AS value FROM obs")
def _(spark, d):
    return stats.yday_anomaly(views.obs(spark, d))


@query("monthday_anomaly", CELLS, "SELECT time, lat, lon, value - avg(value) OVER (PARTITION BY lat, month(time), day(time)) AS value FROM obs")
def _(spark, d):
    return stats.yday_anomaly(views.obs(spark, d), key="monthday", by=["lat"])


@query("zonal_anomaly", CELLS, "SELECT time, lat, lon, value - avg(value) OVER (PARTITION BY time, lat) AS value FROM obs")
def _(spark, d):
    return stats.zonal_anomaly(views.obs(spark, d))


_SEASONAL = """
    SELECT season, lat, lon, avg(value) AS value, count(value) AS n FROM (
        SELECT o.*, s.season FROM {src} o JOIN seasons s ON month(o.time) = s.mon
        UNION ALL SELECT o.*, 'annual' FROM {src} o) WHERE {cond} GROUP BY ALL"""


@query("seasonal_composite", "season:s lat lon value:6 n:i", _SEASONAL.format(src="obs", cond="CAST(time AS DATE) IN (SELECT date FROM high_days)"))
def _(spark, d):
    return composite.seasonal_composite(views.obs(spark, d), high_days(spark, d))


@query("seasonal_composite_all", "season:s lat lon value:6 n:i", _SEASONAL.format(src="field", cond="true"))
def _(spark, d):
    return composite.seasonal_composite(views.field(spark, d))


GROUPS = {"g13": (8.0, 18.0), "g30": (25.0, 35.0), "g44": (39.0, 49.0), "g57": (52.0, 62.0), "wide": (20.0, 40.0)}


@query("phase_group_composite", "label:s season:s lat value:6 n:i", """
    SELECT label, season, lat, avg(value) AS value, count(*) AS n FROM (
        SELECT o.lat, o.value, label, unnest(['annual', s.season]) AS season FROM obs o JOIN seasons s ON month(o.time) = s.mon
        JOIN (SELECT time AS day, label FROM waves JOIN (VALUES ('g13', 8, 18), ('g30', 25, 35), ('g44', 39, 49), ('wide', 20, 40)) g(label, lo, hi)
                ON wave6_phase > lo AND wave6_phase < hi
              UNION ALL SELECT time, 'g57' FROM waves WHERE wave6_phase > 52 OR wave6_phase < 2) p ON p.day = o.time)
    GROUP BY ALL""")
def _(spark, d):
    return composite.phase_group_composite(views.obs(spark, d), views.waves(spark, d), GROUPS, by=["lat"])


def _conditions(spark, d):
    days = views.series(spark, d)
    price = F.col("value") * F.col("value") / F.col("n")
    level = F.when(price > 265, "high").when(price < 235, "low")
    size = F.when(F.col("n") % 2 == 0, "even").otherwise("odd")
    date = F.to_date("time").alias("date")
    return days.select(date, level.alias("label")).where("label IS NOT NULL"), days.select(date, size.alias("label"))


@query("joint_condition_composite", "label:s season:s lat lon value:6 n:i", """
    SELECT label, season, lat, lon, avg(value) AS value, count(*) AS n FROM (
        SELECT o.lat, o.lon, o.value, label, unnest(['annual', s.season]) AS season FROM obs o JOIN seasons s ON month(o.time) = s.mon
        JOIN (SELECT time AS day, (CASE WHEN value * value / n > 265 THEN 'high' ELSE 'low' END) || '+' || (CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END) AS label
              FROM series WHERE value * value / n > 265 OR value * value / n < 235) c ON c.day = o.time)
    GROUP BY ALL""")
def _(spark, d):
    return composite.joint_condition_composite(views.obs(spark, d), *_conditions(spark, d))


_NEFF = """
    SELECT season, lat, lon, any_value(n) AS n, any_value(m) AS mean, any_value(c0) / any_value(n) AS var,
           any_value(n) / (1 + 2 * sum(CASE WHEN lag BETWEEN 1 AND n - 2 THEN (n - lag) / n * c / c0 ELSE 0 END)) AS n_eff
    FROM (SELECT a.season, a.lat, a.lon, a.n, a.m, b.i - a.i AS lag, sum(a.x * b.x) AS c, max(a.c0) AS c0
          FROM centred a JOIN centred b ON a.season = b.season AND a.lat = b.lat AND a.lon = b.lon AND b.i >= a.i GROUP BY ALL)
    GROUP BY season, lat, lon"""

_CENTRED = """
    picked AS (SELECT f.*, unnest(['annual', s.season]) AS season FROM field f JOIN seasons s ON month(f.time) = s.mon
               WHERE CAST(f.time AS DATE) IN (SELECT date FROM pwi_days)),
    centred AS (SELECT season, lat, lon, count(*) OVER p AS n, avg(value) OVER p AS m, value - avg(value) OVER p AS x,
                       var_pop(value) OVER p * count(*) OVER p AS c0, row_number() OVER (PARTITION BY season, lat, lon ORDER BY time) AS i
                FROM picked WINDOW p AS (PARTITION BY season, lat, lon))"""


def pwi_days(spark, d):
    from fieldloom.plans.workflows import high_wave_dates

    return high_wave_dates(views.field(spark, d), 36, threshold="75pct")


@query("effective_sample_size", "lat lon n:i mean:6 var:5 n_eff:5", """
    WITH centred AS (SELECT 'all' AS season, lat, lon, count(*) OVER p AS n, avg(value) OVER p AS m, value - avg(value) OVER p AS x,
                       var_pop(value) OVER p * count(*) OVER p AS c0, row_number() OVER (PARTITION BY lat, lon ORDER BY time) AS i
                FROM field WINDOW p AS (PARTITION BY lat, lon)) """ + _NEFF)
def _(spark, d):
    return composite.effective_sample_size(views.field(spark, d))


_TESTED = "WITH " + _CENTRED + ", eff AS (" + _NEFF + """),
    everything AS (SELECT season, lat, lon, avg(value) AS mean_all FROM (
        SELECT o.*, s.season FROM field o JOIN seasons s ON month(o.time) = s.mon UNION ALL SELECT o.*, 'annual' FROM field o) GROUP BY ALL)
    SELECT season, lat, lon, n, mean, mean_all, n_eff, CASE WHEN var / n_eff >= 0 THEN (mean - mean_all) / sqrt(var / n_eff) END AS t
    FROM eff JOIN everything USING (season, lat, lon)"""


@query("composite_significance", "season:s lat lon n:i mean:6 mean_all:6 n_eff:4 t:4", _TESTED)
def _(spark, d):
    tested = composite.composite_significance(views.field(spark, d), pwi_days(spark, d))
    return tested.withColumn("t", F.nanvl("t", F.lit(None).cast("double")))


@query("composite_p_values", "season:s lat lon p:5", f"SELECT season, lat, lon, {student_p('t', '(n - 1)')} AS p FROM ({_TESTED})")
def _(spark, d):
    return composite.composite_significance(views.field(spark, d), pwi_days(spark, d))


@query("autocorrelation", "lag:i r:6", """
    SELECT b.i - a.i AS lag, sum(a.x * b.x) / max(a.c0) AS r FROM
        (SELECT row_number() OVER (ORDER BY time) AS i, value - avg(value) OVER () AS x, var_pop(value) OVER () * count(*) OVER () AS c0 FROM series) a
        JOIN (SELECT row_number() OVER (ORDER BY time) AS i, value - avg(value) OVER () AS x FROM series) b ON b.i >= a.i AND b.i <= a.i + 60
    GROUP BY 1""")
def _(spark, d):
    return stats.autocorrelation(views.series(spark, d), 60)


@query("autocorrelation_cells", "lat lon lag:i r:6", """
    WITH x AS (SELECT lat, lon, row_number() OVER (PARTITION BY lat, lon ORDER BY time) AS i, value - avg(value) OVER (PARTITION BY lat, lon) AS x,
                      var_pop(value) OVER (PARTITION BY lat, lon) * count(*) OVER (PARTITION BY lat, lon) AS c0, count(*) OVER (PARTITION BY lat, lon) AS n FROM field)
    SELECT a.lat, a.lon, b.i - a.i AS lag, sum(a.x * b.x) / max(a.c0) AS r FROM x a JOIN x b ON a.lat = b.lat AND a.lon = b.lon AND b.i >= a.i AND b.i <= a.i + 24 GROUP BY ALL""")
def _(spark, d):
    return stats.autocorrelation(views.field(spark, d), 24, by=["lat", "lon"])


@query("daily_mean", "date:d event_type:s value:5", "SELECT CAST(time AS DATE) AS date, event_type, avg(ln(1 + value)) AS value FROM stream GROUP BY ALL")
def _(spark, d):
    rows = views.stream(spark, d).withColumn("value", F.log1p("value"))
    return stats.daily_mean(rows, ["event_type"])


@query("daily_sum_shifted", "date:d event_type:s value:3", """
    SELECT CAST(time - INTERVAL 12 HOUR AS DATE) AS date, event_type, sum(ln(1 + value)) * 1000 AS value FROM stream GROUP BY ALL""")
def _(spark, d):
    rows = views.stream(spark, d).withColumn("value", F.log1p("value"))
    return stats.daily_sum_shifted(rows, ["event_type"])


_SEASON_START = "CAST(date_trunc('quarter', CAST(time AS DATE) + INTERVAL 1 MONTH) AS DATE) - INTERVAL 1 MONTH"


@query("calendar_aggregate", "bucket:d value:5", """
    SELECT * FROM (SELECT date_trunc('month', time) AS bucket, sum(value) AS value FROM series GROUP BY 1)
    WHERE bucket < (SELECT max(date_trunc('month', time)) FROM series)""")
def _(spark, d):
    return stats.calendar_aggregate(views.series(spark, d))


@query("calendar_aggregate_seasonal", "bucket:d value:6", f"""
    WITH b AS (SELECT {_SEASON_START} AS bucket, avg(value) AS value FROM series GROUP BY 1)
    SELECT * FROM b WHERE bucket < (SELECT max(bucket) FROM b)""")
def _(spark, d):
    return stats.calendar_aggregate(views.series(spark, d), "seasonal", "mean")


@query("seasonal_index_mean", "bucket:d season:s value:6 flag:i", f"""
    WITH b AS (SELECT {_SEASON_START} AS bucket, avg(value) AS value FROM (
                   SELECT time, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS value FROM series_b) GROUP BY 1)
    SELECT bucket, season, value, CASE WHEN value > 0.02 THEN 1 WHEN value < -0.02 THEN -1 ELSE 0 END AS flag
    FROM b JOIN seasons ON month(bucket) = mon WHERE bucket < (SELECT max(bucket) FROM b)""")
def _(spark, d):
    return stats.seasonal_index_mean(stats.normalise_series(views.series_b(spark, d)), -0.02, 0.02)


@query("normalise_series", "time:d value:6", "SELECT time, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS value FROM series")
def _(spark, d):
    return stats.normalise_series(views.series(spark, d))


@query("normalise_series_population", "time:d value:6", "SELECT time, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS value FROM series")
def _(spark, d):
    return stats.normalise_series(views.series(spark, d), sample=False)


def _pair(spark, d):
    from fieldloom.operators.align import align_series

    x = views.series(spark, d).select("time", F.col("value").alias("x"))
    return align_series(x, views.series_b(spark, d).withColumnRenamed("value", "y"))


_PAIR = "(SELECT a.time, a.value AS x, b.value AS y FROM series a JOIN series_b b ON a.time = b.time)"


@query("linear_trend_fit", "slope:6 intercept:6", f"SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM {_PAIR}")
def _(spark, d):
    return stats.linear_trend_fit(_pair(spark, d))


@query("pearson_correlation", "r:6", f"SELECT corr(x, y) AS r FROM {_PAIR}")
def _(spark, d):
    return stats.pearson_correlation(_pair(spark, d))


@query("quadrant_percent", "top_right:i bottom_right:i bottom_left:i top_left:i", f"""
    SELECT round(100.0 * avg(CASE WHEN x >= 0 AND y >= 0 THEN 1 ELSE 0 END)) AS top_right, round(100.0 * avg(CASE WHEN x >= 0 AND y < 0 THEN 1 ELSE 0 END)) AS bottom_right,
           round(100.0 * avg(CASE WHEN x < 0 AND y < 0 THEN 1 ELSE 0 END)) AS bottom_left, round(100.0 * avg(CASE WHEN x < 0 AND y >= 0 THEN 1 ELSE 0 END)) AS top_left
    FROM (SELECT x - avg(x) OVER () AS x, y - avg(y) OVER () AS y FROM {_PAIR})""")
def _(spark, d):
    return stats.quadrant_percent(stats.normalise_series(stats.normalise_series(_pair(spark, d), "x"), "y"))


@query("series_extent", "highest:6 lowest:6", "SELECT max(value) AS highest, min(value) AS lowest FROM (SELECT value FROM series UNION ALL SELECT value FROM series_b)")
def _(spark, d):
    return stats.series_extent(views.series(spark, d), views.series_b(spark, d))


@query("find_duplicates", "date:d position:i occurrences:i", """
    SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS position, n AS occurrences FROM (
        SELECT *, count(*) OVER (PARTITION BY CAST(o_orderdate AS DATE)) AS n FROM orders) WHERE n > 1""")
def _(spark, d):
    rows = views.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("position"))
    return stats.find_duplicates(rows, "date", "position")


@query("marginal_distribution", "label:s variable:s bin:i n:i", f"""
    SELECT label, variable, CASE WHEN v < 0 THEN 0 WHEN v >= 60 THEN 31 ELSE 1 + CAST(floor(v / 2) AS BIGINT) END AS bin, count(*) AS n FROM (
        SELECT label, unnest(['x', 'y']) AS variable, unnest([x, y]) AS v FROM (
            SELECT 'all' AS label, x, y FROM {_PAIR}
            UNION ALL SELECT 'high', x, y FROM {_PAIR} WHERE CAST(time AS DATE) IN (SELECT date FROM high_days)
            UNION ALL SELECT 'urgent', x, y FROM {_PAIR} WHERE CAST(time AS DATE) IN (SELECT date FROM urgent_days)))
    GROUP BY ALL""")
def _(spark, d):
    labelled = stats.label_by_dates(_pair(spark, d), high=high_days(spark, d), urgent=views.urgent_days(spark, d))
    return stats.marginal_distribution(labelled, ["x", "y"], 0, 60, 30)


@query("event_mean_field", "event_number:i lat value:6", """
    SELECT event_number, lat, avg(value) AS value FROM obs o JOIN numbered n ON CAST(o.time AS DATE) = CAST(n.time AS DATE) GROUP BY ALL""")
def _(spark, d):
    from fieldloom.operators.align import event_number_join
    from workload.event_queries import numbered_days

    return composite.event_mean_field(event_number_join(views.obs(spark, d), numbered_days(spark, d)), by=["lat"])


@query("infer_timescale", "step_hours:3 timescale:s", """
    SELECT step_hours, CASE WHEN step_hours >= 8760 THEN 'yearly' WHEN step_hours >= 648 THEN 'monthly' WHEN step_hours >= 24 THEN 'daily'
        WHEN step_hours >= 12 THEN '12hourly' WHEN step_hours >= 6 THEN '6hourly' WHEN step_hours >= 1 THEN 'hourly' END AS timescale
    FROM (SELECT date_diff('hour', min(time), max(time)) AS step_hours FROM (SELECT time FROM months ORDER BY time LIMIT 2))""")
def _(spark, d):
    return stats.infer_timescale(views.field(spark, d))
