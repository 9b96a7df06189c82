"""Scans, sinks and data-quality checks."""

import uuid

from pyspark.sql import functions as F

from fieldloom.operators import stats
from fieldloom.operators.events import running_mean
from fieldloom.plans.workflows import stored_composite
from fieldloom.session import shared_folder
from fieldloom.sources import quality, readers, writers
from fieldloom.streaming.incremental import climatology_of_state, incremental_years, update_climatology, update_running_mean
from workload import views
from workload.registry import query


def scratch(spark, name):
    """A new folder for what a sink writes, in the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored_lines(spark, name, lines):
    """Path of a text file of ``lines`` (one column ``value``)."""
    path = scratch(spark, name)
    lines.select("value").write.text(path)
    return path


@query("scan_field", "time:t value:4", "SELECT ts AS time, value FROM events")
def _(spark, d):
    path = scratch(spark, "field")
    views.table(spark, d, "events").withColumnRenamed("ts", "time").write.parquet(path)
    return readers.scan_field(spark, path, "value", ["time"])


@query("scan_multi_file", "time:t key:i", "SELECT o_orderdate AS time, o_orderkey AS key FROM orders UNION ALL SELECT l_shipdate, l_orderkey FROM lineitem")
def _(spark, d):
    both = readers.scan_multi_file(spark, [f"{d}/orders.parquet", f"{d}/lineitem.parquet"])
    return both.select(F.coalesce("o_orderdate", "l_shipdate").alias("time"), F.coalesce("o_orderkey", "l_orderkey").alias("key"))


@query("scan_date_list", "date:d", "SELECT date FROM urgent_days")
def _(spark, d):
    lines = views.urgent_days(spark, d).select(F.concat(F.col("date").cast("string"), F.lit("T12:00:00")).alias("value"))
    return readers.scan_date_list(spark, stored_lines(spark, "dates", lines))


@query("scan_event_intervals", "start_ts:t end_ts:t flag:s", """
    SELECT start_ts + INTERVAL 3 HOUR AS start_ts, end_ts + INTERVAL 21 HOUR AS end_ts, CASE WHEN id % 7 = 0 THEN 'skirt' END AS flag FROM intervals""")
def _(spark, d):
    rows = views.intervals(spark, d)
    flag = F.when(F.col("id") % 7 == 0, "skirt").otherwise("")

    def day(c):
        return F.to_date(c).cast("string")

    line = F.concat_ws(",", day("start_ts"), F.lit("03:00"), day("end_ts"), F.lit("21:00"), flag)
    line = F.when(F.col("id") % 2 == 0, F.concat(line, F.lit(","))).otherwise(line)
    heading = spark.createDataFrame([("Some Land,,,,",), ("Start YYYY-MM-DD,Start Time UTC,End YYYY-MM-DD,End Time UTC,",)], "value string")
    return readers.scan_event_intervals(spark, stored_lines(spark, "intervals", heading.unionByName(rows.select(line.alias("value")))))


@query("scan_wide_monthly", "date:d value:3", """
    SELECT make_date(year(o_orderdate), month(o_orderdate), 15) AS date, count(*) / 8.0 AS value FROM orders GROUP BY 1""")
def _(spark, d):
    orders = views.table(spark, d, "orders")
    counts = orders.groupBy(F.year("o_orderdate").alias("y")).agg(
        *[F.sum(F.when(F.month("o_orderdate") == m, 1)).alias(str(m)) for m in range(1, 13)]
    )
    texts = [F.coalesce(F.format_string("%.3f", F.col(str(m)) / 8.0), F.lit("NaN")) for m in range(1, 13)]
    lines = counts.select(F.concat_ws("   ", F.col("y").cast("string"), *texts).alias("value"))
    heading = spark.createDataFrame([("An index",), ("     JAN FEB MAR",)], "value string")
    return readers.scan_wide_monthly(spark, stored_lines(spark, "wide", heading.unionByName(lines)))


@query("scan_metric_table", "date:d value:4", """
    SELECT make_date(year(o_orderdate), month(o_orderdate), 15) AS date, count(*) / 16.0 AS value FROM orders GROUP BY 1""")
def _(spark, d):
    orders = views.table(spark, d, "orders")
    counts = orders.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    cells = [F.format_string("%.4f", F.col("n") / (2.0 ** (i + 1))) for i in range(8)]
    lines = counts.select(F.concat_ws("  ", F.col("y").cast("string"), F.col("m").cast("string"), *cells).alias("value"))
    heading = spark.createDataFrame([(" YR MON NINO1+2 ANOM NINO3 ANOM",)], "value string")
    return readers.scan_metric_table(spark, stored_lines(spark, "metrics", heading.unionByName(lines)), "nino3_anom")


@query("filename_metadata", "key:i var:s dataset:s level:s tstep:s aggregation:s season:s grid:s region:s bounds:s north_pole:s", """
    SELECT p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN 'va' ELSE 'psl' END AS var, 'D' || (p_partkey % 5) AS dataset, p_size || 'hPa' AS level,
           'daily' AS tstep, CASE WHEN p_size % 3 = 0 THEN 'anom-wrt-all' ELSE '030day-runmean' END AS aggregation,
           CASE WHEN p_partkey % 2 = 0 THEN 'JJA' END AS season, 'native' AS grid, CASE WHEN p_partkey % 3 = 0 THEN 'sh' END AS region,
           CASE WHEN p_partkey % 7 = 0 THEN 'lon225E335E-lat10S10N' END AS bounds, CASE WHEN p_partkey % 4 = 0 THEN 'np20N260E' END AS north_pole
    FROM part""")
def _(spark, d):
    part = views.table(spark, d, "part")
    key, size = F.col("p_partkey"), F.col("p_size")

    def piece(condition, text):
        return F.when(condition, F.lit(text)).otherwise(F.lit(""))

    name = F.concat(
        F.lit("/data/"), F.when(size % 2 == 0, "va").otherwise("psl"), F.lit("_D"), (key % 5).cast("string"), F.lit("_"), size.cast("string"),
        F.lit("hPa_daily-"), F.when(size % 3 == 0, "anom-wrt-all").otherwise("030day-runmean"), piece(key % 2 == 0, "-JJA"), F.lit("_native"),
        piece(key % 3 == 0, "-sh"), piece(key % 7 == 0, "-lon225E335E-lat10S10N"), piece(key % 4 == 0, "-np20N260E"), F.lit(".nc"),
    )
    return readers.filename_metadata(part.select(key.alias("key"), name.alias("_name")), F.col("_name"))


@query("scan_file_names", "source:s var:s dataset:s rows:i", """
    SELECT 'orders' AS source, 'price' AS var, 'Dorders' AS dataset, count(*) AS rows FROM orders
    UNION ALL SELECT 'lineitem', 'price', 'Dlineitem', count(*) FROM lineitem""")
def _(spark, d):
    root = scratch(spark, "named")
    for name, column in (("orders", "o_totalprice"), ("lineitem", "l_extendedprice")):
        views.table(spark, d, name).select(F.col(column).alias("price")).write.parquet(f"{root}/price_D{name}_surface_daily_native.parquet")
    found = None
    for name in ("orders", "lineitem"):
        folder = f"{root}/price_D{name}_surface_daily_native.parquet"
        stored = spark.read.parquet(folder).select(F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("_name"))
        counted = stored.groupBy("_name").agg(F.count(F.lit(1)).alias("rows"))
        part = readers.filename_metadata(counted, F.col("_name")).withColumn("source", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found


@query("unread_lines", "value:s lines:i", """
    SELECT 'An index' AS value, 1 AS lines UNION ALL SELECT '# ' || o_orderstatus, count(*) FROM orders WHERE o_orderkey % 9 = 0 GROUP BY o_orderstatus""")
def _(spark, d):
    orders = views.table(spark, d, "orders")
    note, data = F.concat(F.lit("# "), F.col("o_orderstatus")), F.concat_ws(" ", F.year("o_orderdate").cast("string"), F.lit("1.5 2.5"))
    lines = orders.select(F.when(F.col("o_orderkey") % 9 == 0, note).otherwise(data).alias("value"))
    heading = spark.createDataFrame([("An index",), ("  ",)], "value string")
    return readers.unread_lines(spark.read.text(stored_lines(spark, "notes", heading.unionByName(lines))), "wide_monthly")


@query("sink_field", "time:d lat value:6 year:i", "SELECT time, lat, avg(value) AS value, year(time) AS year FROM obs GROUP BY time, lat")
def _(spark, d):
    path = scratch(spark, "field")
    writers.sink_field(stats.zonal_mean(views.obs(spark, d)), path)
    return spark.read.parquet(path)


@query("sink_date_list", "date:d", "SELECT date FROM urgent_days")
def _(spark, d):
    path = scratch(spark, "dates")
    writers.sink_date_list(views.urgent_days(spark, d), path)
    return readers.scan_date_list(spark, path)


@query("sink_event_stats", "time:d event_number:i event_duration:i event_phase:2", "SELECT * FROM unwrapped")
def _(spark, d):
    from workload.event_queries import event_days

    path = scratch(spark, "events")
    writers.sink_event_stats(event_days(spark, d), path)
    return spark.read.option("header", True).csv(path).withColumn("time", F.to_date("time"))


@query("lineage_table", "output:s input:s history:s", """
    SELECT 'composite' AS output, 'orders' AS input, 'rows: ' || count(*) AS history FROM orders
    UNION ALL SELECT 'composite', 'lineitem', 'rows: ' || count(*) FROM lineitem""")
def _(spark, d):
    path = scratch(spark, "lineage")
    for name in ("orders", "lineitem"):
        rows = views.table(spark, d, name).count()
        writers.append_lineage(spark, path, "composite", {name: f"rows: {rows}"})
    return spark.read.parquet(path)


@query("lineage_ancestors", "output:s ancestor:s steps:i history:s days:i", """
    WITH n AS (SELECT count(DISTINCT date) AS days FROM pwi_days),
    waves AS (SELECT 'envelope of wavenumbers 1-9 on 36 longitudes' AS w)
    SELECT 'index' AS output, 'field' AS ancestor, 1 AS steps, w AS history, days FROM n, waves
    UNION ALL SELECT 'dates', 'index', 1, 'days at or above 75pct', days FROM n UNION ALL SELECT 'dates', 'field', 2, w, days FROM n, waves
    UNION ALL SELECT 'composite', 'dates', 1, 'days of the composite', days FROM n UNION ALL SELECT 'composite', 'field_b', 1, 'values', days FROM n
    UNION ALL SELECT 'composite', 'index', 2, 'days at or above 75pct', days FROM n UNION ALL SELECT 'composite', 'field', 3, w, days FROM n, waves""")
def _(spark, d):
    folder = scratch(spark, "workflow")
    stored_composite(views.field(spark, d), views.field_b(spark, d), 36, folder, ("field", "field_b"), threshold="75pct")
    days = readers.scan_date_list(spark, f"{folder}/dates").agg(F.count_distinct("date").alias("days"))
    return writers.ancestors(spark.read.parquet(f"{folder}/lineage")).join(F.broadcast(days), F.lit(True))


@query("stored_composite", "season:s lat lon value:6 n:i", """
    SELECT season, lat, lon, avg(value) AS value, count(*) AS n FROM (
        SELECT f.lat, f.lon, f.value, unnest(['annual', s.season]) AS season FROM field_b f JOIN seasons s ON month(f.time) = s.mon
        WHERE CAST(f.time AS DATE) IN (SELECT date FROM pwi_days)) GROUP BY ALL""")
def _(spark, d):
    return stored_composite(views.field(spark, d), views.field_b(spark, d), 36, scratch(spark, "workflow"), threshold="75pct")


@query("quality_check", "rule:s violations:i", """
    SELECT 'units_present' AS rule, 0 AS violations UNION ALL SELECT 'long_name_present', 0 UNION ALL SELECT 'long_name_without_spaces', 1
    UNION ALL SELECT 'dimensions_accepted', 0 UNION ALL SELECT 'lon_within_0_360', count(*) FILTER (lon - 20 < 0) FROM obs
    UNION ALL SELECT 'lat_within_90', 0 UNION ALL SELECT 'coordinates_present', 0""")
def _(spark, d):
    shifted = views.obs(spark, d).withColumn("lon", F.col("lon") - 20)
    labelled = shifted.withMetadata("value", {"units": "K", "long_name": "air temperature"})
    return quality.quality_check(labelled)


_HOLED = """(SELECT * FROM (SELECT *, month(time) * 7 + lat * 3 + lon AS h FROM field) WHERE h % 11 <> 0
    UNION ALL SELECT *, 0 FROM field WHERE lat = 0 AND lon < 90 AND year(time) = 1996)"""


@query("axis_check", "rule:s violations:i", f"""
    WITH g AS (SELECT time, lat, lon FROM {_HOLED}), c AS (SELECT time, lat, count(DISTINCT lon) AS n FROM g GROUP BY ALL)
    SELECT 'repeated_cells' AS rule, (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM g GROUP BY time, lat, lon)) AS violations
    UNION ALL SELECT 'lat_uneven', 0 UNION ALL SELECT 'lon_uneven', 0
    UNION ALL SELECT 'incomplete_circles', (SELECT count(*) FROM c WHERE n < (SELECT count(DISTINCT lon) FROM g))
    UNION ALL SELECT 'incomplete_times', (SELECT count(*) FROM (SELECT time FROM c GROUP BY time HAVING count(*) < (SELECT count(DISTINCT lat) FROM g)))""")
def _(spark, d):
    field = views.field(spark, d)
    h = F.month("time") * 7 + F.col("lat") * 3 + F.col("lon")
    again = field.where("lat = 0 AND lon < 90 AND year(time) = 1996")
    return quality.axis_check(field.where(h % 11 != 0).unionByName(again))


@query("axis_spacing", "rule:s violations:i", """
    SELECT 'repeated_cells' AS rule, (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM obs WHERE lat <> -40 AND lon <> 120 GROUP BY time, lat, lon)) AS violations
    UNION ALL SELECT 'lat_uneven', 1 UNION ALL SELECT 'lon_uneven', 1
    UNION ALL SELECT 'incomplete_circles', (SELECT count(*) FROM (SELECT 1 FROM obs WHERE lat <> -40 AND lon <> 120 GROUP BY time, lat HAVING count(DISTINCT lon) < 35))
    UNION ALL SELECT 'incomplete_times', (SELECT count(*) FROM (SELECT time FROM obs WHERE lat <> -40 AND lon <> 120 GROUP BY time HAVING count(DISTINCT lat) < 16))""")
def _(spark, d):
    return quality.axis_check(views.obs(spark, d).where("lat <> -40 AND lon <> 120"))


@query("range_assert_convert", "time:d value:6 unit:s", """
    SELECT l_shipdate AS time, CASE WHEN l_partkey % 2 = 0 THEN l_discount / 7 * 1000 ELSE l_quantity + 0.3 END AS value, 'g/kg' AS unit FROM lineitem""")
def _(spark, d):
    mixed = views.table(spark, d, "lineitem").select(
        F.col("l_shipdate").alias("time"),
        F.when(F.col("l_partkey") % 2 == 0, F.col("l_discount") / 7).otherwise(F.col("l_quantity") + 0.3).alias("value"),
        F.when(F.col("l_partkey") % 2 == 0, "1").otherwise("g/kg").alias("unit"),
    )
    return quality.range_assert_convert(mixed)


@query("range_report", "lowest:4 highest:4 ok:b", "SELECT min(value) AS lowest, max(value) AS highest, min(value) >= 0 AND max(value) < 100 AS ok FROM events")
def _(spark, d):
    return quality.range_report(views.table(spark, d, "events"))


@query("decode_epoch_time", "o_orderkey:i time:t", """
    SELECT o_orderkey, TIMESTAMP '1900-01-01 00:00:00' + to_hours(CAST(o_orderkey % 900000 AS INTEGER)) + to_minutes(CAST(30 * (o_custkey % 2) AS INTEGER)) AS time FROM orders""")
def _(spark, d):
    orders = views.table(spark, d, "orders")
    hours = (F.col("o_orderkey") % 900000) + 0.5 * (F.col("o_custkey") % 2)
    return readers.decode_epoch_time(orders.select("o_orderkey", hours.alias("time")), "hours since 1900-01")


@query("incremental_years", "time:d lat lon value:6", """
    SELECT time, lat, lon, value - avg(value) OVER (PARTITION BY time, lat) AS value FROM field WHERE year(time) BETWEEN 1996 AND 1998""")
def _(spark, d):
    path = scratch(spark, "anomaly")
    source = views.field(spark, d)
    incremental_years(source, [1996, 1997], stats.zonal_anomaly, path)
    incremental_years(source, [1997, 1998], stats.zonal_anomaly, path)
    return spark.read.parquet(path)


@query("incremental_climatology", "key:i lat lon clim_mean:6 clim_std:6", """
    SELECT month(time) AS key, lat, lon, avg(v) AS clim_mean, stddev_pop(v) AS clim_std
    FROM (SELECT *, CASE WHEN year(time) IN (1996, 1998) THEN 2 * value + 1 ELSE value END AS v FROM obs) GROUP BY ALL""")
def _(spark, d):
    """All years are stored, then two of them come anew."""
    path, source = scratch(spark, "state"), views.obs(spark, d)
    years = [r[0] for r in source.select(F.year("time")).distinct().collect()]  # as many as the record has years
    update_climatology(source, years, path)
    update_climatology(source.withColumn("value", 2 * F.col("value") + 1), [1996, 1998], path)
    return climatology_of_state(spark.read.parquet(path))


@query("incremental_running_mean", "time:d lat lon value:6", """
    SELECT time, lat, lon, value FROM (
        SELECT time, lat, lon, avg(v) OVER w AS value, count(*) OVER w AS n
        FROM (SELECT *, CASE WHEN year(time) BETWEEN 1996 AND 1997 THEN value - 5 ELSE value END AS v FROM field)
        WINDOW w AS (PARTITION BY lat, lon ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE n = 5""")
def _(spark, d):
    path, source = scratch(spark, "smooth"), views.field(spark, d)
    years = [r[0] for r in source.select(F.year("time")).distinct().collect()]  # as many as the record has years

    def smooth(rows):
        return running_mean(rows, 5, by=["lat", "lon"])

    update_running_mean(source, years, 2, smooth, path)
    lower = source.withColumn("value", F.when(F.year("time").between(1996, 1997), F.col("value") - 5).otherwise(F.col("value")))
    update_running_mean(lower, [1996, 1997], 2, smooth, path)
    return spark.read.parquet(path)
