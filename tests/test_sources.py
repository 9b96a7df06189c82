import pytest
from pyspark.sql import functions as F

from fieldloom.operators import align, along, stats
from fieldloom.sources import quality, readers, writers
from fieldloom.operators.events import running_mean
from fieldloom.streaming.incremental import climatology_of_state, incremental_years, update_climatology, update_running_mean
from workload.catalog import QUERIES


def test_text_scans(spark, tmp_path):
    (tmp_path / "dates.txt").write_text("2001-02-03\n2001-02-04T12:00:00\n\n")
    got = [str(r.date) for r in readers.scan_date_list(spark, str(tmp_path / "dates.txt")).collect()]
    assert got == ["2001-02-03", "2001-02-04"]

    (tmp_path / "wide.txt").write_text("Index\n  JAN FEB\n2000  1.5  -2  NaN 4\n2001 -0.5\n")
    rows = readers.scan_wide_monthly(spark, str(tmp_path / "wide.txt")).orderBy("date").collect()
    assert [(str(r.date), r.value) for r in rows] == [
        ("2000-01-15", 1.5),
        ("2000-02-15", -2.0),
        ("2000-04-15", 4.0),
        ("2001-01-15", -0.5),
    ]

    (tmp_path / "metric.txt").write_text(" YR MON A B\n 2000  1 1 2 3 4 5 6 7 8\n 2000 12 9 9 9 9 9 9 9 NaN\n")
    rows = readers.scan_metric_table(spark, str(tmp_path / "metric.txt"), "nino34_anom").collect()
    assert [(str(r.date), r.value) for r in rows] == [("2000-01-15", 8.0)]


def test_interval_files(spark, tmp_path):
    text = "Land,,,,\nStart YYYY-MM-DD,Start Time UTC,End YYYY-MM-DD,End Time UTC,\n"
    (tmp_path / "east_times.csv").write_text(text + "2031-05-06,09:00,2031-05-08,18:00,edge\n")
    (tmp_path / "west_times.csv").write_text(text + "2032-10-11,12:00,2032-10-12,06:00,,\n")
    rows = readers.scan_event_intervals(spark, str(tmp_path)).orderBy("region").collect()
    assert [(r.region, str(r.start_ts), str(r.end_ts), r.flag) for r in rows] == [
        ("east", "2031-05-06 09:00:00", "2031-05-08 18:00:00", "edge"),
        ("west", "2032-10-11 12:00:00", "2032-10-12 06:00:00", None),
    ]


def test_epoch_units(spark):
    df = spark.createDataFrame([(36.5,)], "time double")
    cases = {
        "days since 1850-01": "1850-02-06 12:00:00",
        "hours since 1900-01-01": "1900-01-02 12:30:00",
        "days since 2000-1-1": "2000-02-06 12:00:00",
    }
    for units, want in cases.items():
        assert str(readers.decode_epoch_time(df, units).first().time) == want


def test_epoch_texts_that_fail(spark):
    df = spark.createDataFrame([(1.5,)], "time double")
    for units, number, message in (("months since 2000-01", 1.5, "fraction"), ("years since 2000-1-1", 0.5, "fraction"), ("days since 2000-01-01 06:00 +05:00", 1.0, "zone"), ("hours since 2000-01-01t00:00:00z", 1.0, "zone"), ("days since 2000-01-01 -03", 1.0, "zone")):
        with pytest.raises(Exception, match=message):
            readers.decode_epoch_time(df.withColumn("time", F.lit(number)), units).collect()
    assert str(readers.decode_epoch_time(df.withColumn("time", F.lit(2.0)), "months since 2000-01").first().time) == "2000-03-01 00:00:00"
    assert str(readers.decode_epoch_time(df, "days since 2000-01-01 06:30").first().time) == "2000-01-02 18:30:00"


def test_axis_rules(spark):
    def rules(df, cyclic=True):
        return {r.rule: r.violations for r in quality.axis_check(df, cyclic).collect()}

    whole = spark.sql("SELECT explode(sequence(1, 3)) AS time").crossJoin(spark.sql("SELECT explode(array(-10D, 0D, 10D)) AS lat")).crossJoin(spark.sql("SELECT explode(array(0D, 90D, 180D, 270D)) AS lon"))
    assert set(rules(whole).values()) == {0}
    holes = whole.where("not (time = 1 and lat = 0 and lon = 90) and not (time = 2 and lat = 10)").unionAll(whole.where("time = 3 and lon = 0")).unionAll(whole.where("time = 3 and lon = 0"))
    assert rules(holes) == {"repeated_cells": 6, "lat_uneven": 0, "lon_uneven": 0, "incomplete_circles": 1, "incomplete_times": 1}
    odd = whole.where("lat <> 0 and lon <> 90")
    assert rules(odd)["lon_uneven"] == 1 and rules(odd)["lat_uneven"] == 0
    half = whole.where("lon < 200")
    assert rules(half)["lon_uneven"] == 1 and rules(half, cyclic=False)["lon_uneven"] == 0
    assert set(rules(whole.limit(0)).values()) == {0}


def test_ancestors(spark, tmp_path):
    path = str(tmp_path / "lineage")
    for output, inputs in (("b", {"a": "one"}), ("c", {"b": "two", "x": "three"}), ("d", {"c": "four", "a": "five"}), ("b", {"a": "again"})):
        writers.append_lineage(spark, path, output, inputs)
    got = {(r.output, r.ancestor): (r.steps, r.history) for r in writers.ancestors(spark.read.parquet(path)).collect()}
    assert got[("d", "a")] == (1, "five") and got[("d", "x")] == (2, "three") and got[("c", "a")] == (2, "again") and len(got) == 8


def test_replaced_years_equal_a_full_computation(spark, tmp_path):
    rows = spark.sql(
        "SELECT CAST(make_date(2000 + CAST(floor(m / 12) AS INT), CAST(m % 12 AS INT) + 1, 15) AS TIMESTAMP_NTZ) AS time, 0D AS lat, 0D AS lon, CAST(hash(m) % 1000 AS DOUBLE) + 1e9 AS value "
        "FROM (SELECT explode(sequence(0, 71)) AS m)"
    )
    changed = rows.withColumn("value", F.when(F.year("time").isin(2001, 2002, 2004), F.col("value") * 2).otherwise(F.col("value")))
    state, smooth = str(tmp_path / "state"), str(tmp_path / "smooth")
    update_climatology(rows, range(2000, 2006), state)
    update_climatology(changed, [2001, 2002, 2004], state)
    got = {r.key: (r.clim_mean, r.clim_std) for r in climatology_of_state(spark.read.parquet(state)).collect()}
    want = {r.key: (r.clim_mean, r.clim_std) for r in stats.climatology(changed, "monthly").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)

    def mean(df):
        return running_mean(df, 7, by=["lat", "lon"])

    update_running_mean(rows, range(2000, 2006), 3, mean, smooth)
    update_running_mean(changed, [2001, 2002, 2004], 3, mean, smooth)
    got = {r.time: r.value for r in spark.read.parquet(smooth).collect()}
    want = {r.time: r.value for r in mean(changed).collect()}
    assert got == pytest.approx(want) and len(got) == 66


def test_file_names(spark):
    df = spark.createDataFrame([("/x/hum_Invented_low_daily-anom-wrt-2031-2040-MAM_y19x36-nh-mermax-np30N120E.nc",)], "n string")
    row = readers.filename_metadata(df, F.col("n")).first()
    assert (row["var"], row.dataset, row.level, row.tstep, row.aggregation, row.season) == (
        "hum",
        "Invented",
        "low",
        "daily",
        "anom-wrt-2031-2040",
        "MAM",
    )
    assert (row.grid, row.region, row.bounds, row.north_pole) == ("y19x36", "nh", "mermax", "np30N120E")


def yearly(spark):
    return spark.sql(
        "SELECT CAST(make_date(y, 6, 1) AS TIMESTAMP_NTZ) AS time, CAST(-10 AS DOUBLE) AS lat, CAST(j * 90 AS DOUBLE) AS lon, "
        "CAST(y * j AS DOUBLE) AS value FROM (SELECT explode(sequence(2000, 2003)) AS y) LATERAL VIEW explode(sequence(0, 3)) t AS j"
    )


def test_incremental_years_keep_other_years(spark, tmp_path):
    path = str(tmp_path / "out")
    incremental_years(yearly(spark), [2000, 2001, 2002], stats.zonal_anomaly, path)
    incremental_years(yearly(spark).withColumn("value", F.lit(1.0)), [2001], stats.zonal_anomaly, path)
    got = spark.read.parquet(path).groupBy("year").agg(F.sum(F.abs("value")).alias("s"), F.count("*").alias("n")).toPandas().set_index("year")
    assert list(got.n.sort_index()) == [4, 4, 4]
    assert got.s[2001] == 0 and got.s[2000] > 0 and got.s[2002] > 0


def test_sinks_and_lineage(spark, tmp_path):
    dates = yearly(spark).select(F.to_date("time").alias("date"))
    writers.sink_date_list(dates, str(tmp_path / "dates"))
    assert readers.scan_date_list(spark, str(tmp_path / "dates")).count() == 16
    writers.append_lineage(spark, str(tmp_path / "lineage"), "a", {"x": "made", "y": "made"})
    writers.append_lineage(spark, str(tmp_path / "lineage"), "b", {"a": "from x"})
    assert spark.read.parquet(str(tmp_path / "lineage")).count() == 3


def test_scan_field_and_multi_file(spark, tmp_path):
    yearly(spark).withColumnRenamed("value", "tas").write.parquet(str(tmp_path / "a"))
    yearly(spark).withColumnRenamed("value", "tas").withColumn("pr", F.lit(1)).write.parquet(str(tmp_path / "b"))
    field = readers.scan_field(spark, str(tmp_path / "a"), "tas")
    assert field.columns == ["time", "lat", "lon", "value"] and field.count() == 16
    both = readers.scan_multi_file(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert both.count() == 32 and both.where("pr is null").count() == 16


def test_quality(spark):
    labelled = yearly(spark).withMetadata("value", {"long_name": "two words"})
    got = {r.rule: r.violations for r in quality.quality_check(labelled).collect()}
    assert got["units_present"] == 1 and got["long_name_without_spaces"] == 1 and got["lon_within_0_360"] == 0
    bad = spark.createDataFrame([(0.2, "1")], "value double, unit string")
    with pytest.raises(Exception, match="out of range"):
        quality.range_assert_convert(bad).collect()
    assert quality.range_assert_convert(bad.withColumn("value", F.lit(0.035))).first().value == pytest.approx(35)


def test_timescales(spark):
    for step, want in (("1 HOUR", "hourly"), ("6 HOURS", "6hourly"), ("1 DAY", "daily"), ("31 DAYS", "monthly"), ("366 DAYS", "yearly")):
        df = spark.sql(f"SELECT TIMESTAMP_NTZ'2000-01-01' + i * INTERVAL {step} AS time FROM (SELECT explode(sequence(0, 3)) AS i)")
        assert stats.infer_timescale(df).first().timescale == want


def test_grid_pairs_order(spark):
    got = align.grid_pairs(yearly(spark).select("lat").union(spark.sql("SELECT 5.0D")), yearly(spark).select("lon")).orderBy("cell").collect()
    assert [(r.cell, r.lat, r.lon) for r in got] == [(i, -10.0 if i < 4 else 5.0, (i % 4) * 90.0) for i in range(8)]


def test_apply_along_dim_rejects_copies(spark):
    twice = yearly(spark).unionAll(yearly(spark))
    with pytest.raises(Exception, match="two values"):
        along.apply_along_dim(twice, lambda x: x, "lon", ["time", "lat"]).collect()


def test_asof_edges(spark):
    axis = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2000-01-10', 1.0D), (TIMESTAMP_NTZ'2000-03-10', 2.0D) AS t(time, value)")
    targets = spark.sql(
        "SELECT explode(array(TIMESTAMP_NTZ'2000-01-01', TIMESTAMP_NTZ'2000-01-10', TIMESTAMP_NTZ'2000-02-09', TIMESTAMP_NTZ'2000-04-01')) AS target"
    )

    def values(method):
        return [r.value for r in align.asof_select(axis, targets, method).orderBy("target").collect()]

    assert values("pad") == [None, 1.0, 1.0, 2.0]
    assert values("backfill") == [1.0, 1.0, 2.0, None]
    assert values("nearest") == [1.0, 1.0, 1.0, 2.0]


def test_interval_join_pairs_neighbours_only(spark):
    """Intervals of no length to a year; bins hold few more pairs than lie within the intervals."""
    rows = spark.range(4000).select(
        (F.lit("2020-02-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") * 7919) % 86400)).alias("time"), F.col("id").alias("row")
    )
    spans = spark.range(300).select(
        F.col("id").alias("id"), (F.lit("2020-02-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") * 6151) % 86400)).alias("start_ts")
    )
    length = F.element_at(F.array(*[F.lit(n) for n in (0, 1, 59, 60, 1800, -5)]), (F.col("id") % 6 + 1).cast("int"))
    spans = spans.withColumn("end_ts", F.col("start_ts") + F.make_dt_interval(secs=F.when(F.col("id") == 4, 366 * 86400).otherwise(length)))
    spans = spans.unionAll(spark.sql("SELECT -1L, TIMESTAMP_NTZ'2020-02-01', CAST(NULL AS TIMESTAMP_NTZ)"))
    rows, spans = rows.unionAll(spark.sql("SELECT CAST(NULL AS TIMESTAMP_NTZ), -1L")).cache(), spans.cache()
    got = align.interval_join(rows, spans)
    assert got.columns == ["time", "row", "id", "start_ts", "end_ts"]
    plain = rows.toPandas().merge(spans.toPandas(), how="cross")
    plain = plain[(plain.time >= plain.start_ts) & (plain.time <= plain.end_ts)]
    found = sorted((r.row, r.id) for r in got.collect())
    assert found == sorted(zip(plain.row, plain.id, strict=True))
    a, b = align._binned(rows, spans, "time", "start_ts", "end_ts")
    assert a.join(b, ["_width", "_bin"]).count() < 6 * len(found)  # all pairs of the day: about 250,000
    assert align.interval_join(rows, spans.limit(0)).count() == 0


def test_interval_join_bins_are_much_finer_than_intervals(spark):
    """Nearly all rows that meet an interval in a bin lie within it, and no interval is listed more than nine times."""
    start = F.lit("2020-02-01").cast("timestamp_ntz")
    rows = spark.range(3000).select((start + F.make_dt_interval(secs=(F.col("id") * 7919) % 86400)).alias("time"), F.col("id").alias("row")).cache()
    spans = spark.range(600).select("id", (start + F.make_dt_interval(secs=(F.col("id") * 6151) % 86400)).alias("start_ts"))
    spans = spans.withColumn("end_ts", F.col("start_ts") + F.make_dt_interval(mins=(F.col("id") % 30).cast("int"))).cache()
    found = align.interval_join(rows, spans).count()
    plain = rows.toPandas().merge(spans.toPandas(), how="cross")
    assert found == int(((plain.time >= plain.start_ts) & (plain.time <= plain.end_ts)).sum()) > 10_000
    a, b = align._binned(rows, spans, "time", "start_ts", "end_ts")
    assert found <= a.join(b, ["_width", "_bin"]).count() < 1.6 * found
    assert b.count() <= 9 * 600


def test_interval_join_query_writes_out_events_before_they_are_paired(spark):
    """Text is made once an event and not once a pair: no date is formatted above the join."""
    plan = QUERIES["interval_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    top = next(i for i, line in enumerate(lines) if "Join Inner" in line)
    assert not any("date_format" in line for line in lines[:top]) and any("date_format" in line for line in lines[top:])


def test_interval_join_lists_rows_once_and_intervals_a_few_times(spark):
    """Lengths from nothing to a day, a third of the rows and intervals at one instant: what moves grows with the inputs alone, and no bin holds the crowd."""
    start, crowd = F.lit("2020-02-01").cast("timestamp_ntz"), F.col("id") % 3 == 0
    at = start + F.make_dt_interval(secs=F.when(crowd, 43200).otherwise((F.col("id") * 7919) % 86400))
    rows = spark.range(6000).select(at.alias("time"), F.col("id").alias("row")).cache()
    length = F.element_at(F.array(*[F.lit(n) for n in (0, 1, 20, 60, 300, 1800, 86400)]), (F.col("id") % 7 + 1).cast("int"))
    at = start + F.make_dt_interval(secs=F.when(F.col("id") % 30 == 0, 43200).otherwise((F.col("id") * 6151) % 86400))
    spans = spark.range(700).select("id", at.alias("start_ts"), (at + F.make_dt_interval(secs=length)).alias("end_ts")).cache()
    plain = rows.toPandas().merge(spans.toPandas(), how="cross")
    plain = plain[(plain.time >= plain.start_ts) & (plain.time <= plain.end_ts)]
    assert sorted((r.row, r.id) for r in align.interval_join(rows, spans).collect()) == sorted(zip(plain.row, plain.id, strict=True))
    a, b = align._binned(rows, spans, "time", "start_ts", "end_ts")
    assert a.count() == 6000 and b.count() <= 5 * 700
    assert a.groupBy("_bin").count().agg(F.max("count")).first()[0] < 1000  # the crowd: 2,000
    assert a.join(b, ["_width", "_bin"]).count() < 1.6 * len(plain)


def test_interval_join_of_few_instants(spark):
    """Fewer instants than places of the sketch, intervals before and after all rows, rows that come twice, maps, and no rows."""
    rows = spark.sql("""SELECT TIMESTAMP_NTZ'2020-01-02' + make_dt_interval(0, 0, 0, (id % 7) * 10) AS time, id % 40 AS row, map('k', id % 2) AS m FROM range(60)
        UNION ALL SELECT CAST(NULL AS TIMESTAMP_NTZ), -1L, NULL""").cache()
    spans = spark.sql("""SELECT id, TIMESTAMP_NTZ'2020-01-01 23:59:00' + make_dt_interval(0, 0, 0, id * 5) AS start_ts,
        TIMESTAMP_NTZ'2020-01-01 23:59:00' + make_dt_interval(0, 0, 0, id * 5 + (id % 4) * 10) AS end_ts FROM range(40)""").cache()
    plain = rows.drop("m").toPandas().merge(spans.toPandas(), how="cross")
    plain = plain[(plain.time >= plain.start_ts) & (plain.time <= plain.end_ts)]
    for few in (spans, spans.where("start_ts = end_ts"), spans.where("id = 39"), spans.limit(0)):
        ids = {r.id for r in few.collect()}
        wanted = sorted((r, i) for r, i in zip(plain.row, plain.id, strict=True) if i in ids)
        assert sorted((r.row, r.id) for r in align.interval_join(rows, few).collect()) == wanted
    assert len(plain) > 100 and align.interval_join(rows.limit(0), spans).count() == 0


def test_interval_join_query_moves_no_text(spark):
    """Text is made of an event after it has moved: no date is formatted below an exchange of rows."""
    plan = QUERIES["interval_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = next(i for i, line in enumerate(plan) if "date_format" in line)
    assert any("Repartition" in line for line in plan[made:]) and not any("Repartition" in line for line in plan[:made])
