"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import align, select, spectral, stats
from fieldloom.operators.wind import SphericalWind
from fieldloom.sources.readers import scan_field
from fieldloom.sources.writers import sink_field

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", plan(df)))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "field")
    rows = spark.sql(
        "SELECT TIMESTAMP_NTZ'1999-06-01' + make_dt_interval(d * 30) AS time, CAST(-90 + 10 * i AS DOUBLE) AS lat, CAST(10 * j AS DOUBLE) AS lon, "
        "CAST(d + i * j AS DOUBLE) AS tas, 1.0D AS other FROM (SELECT explode(sequence(0, 40)) AS d) "
        "LATERAL VIEW explode(sequence(0, 18)) t AS i LATERAL VIEW explode(sequence(0, 35)) s AS j"
    )
    sink_field(rows, path)
    return path


def test_filters_reach_the_scan(spark, stored):
    text = plan(select.region_box(scan_field(spark, stored, "tas"), "asl"))
    assert "GreaterThanOrEqual(lat,-75.0)" in text and "LessThanOrEqual(lon,310.0)" in text
    assert re.search(r"ReadSchema: struct<time:timestamp_ntz,lat:double,lon:double,tas:double>", text)


def test_years_are_pruned(spark, stored):
    kept = select.year_filter(spark.read.parquet(stored), 2000, 2000)
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan(kept)).group(1)
    assert "year" in filters and ">= 2000" in filters and "<= 2000" in filters
    assert kept.select(F.year("time")).distinct().collect()[0][0] == 2000


def test_date_lists_do_not_shuffle_the_field(spark, stored):
    field = scan_field(spark, stored, "tas")
    dates = field.where("value > 600").select(F.to_date("time").alias("date"))
    text = plan(align.date_semi_join(field, dates))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_fourier_family_needs_one_shuffle(spark, stored):
    field = scan_field(spark, stored, "tas")
    assert exchanges(spectral.zonal_dft(field, range(10), 36)) == 1
    assert exchanges(spectral.wave_envelope(field, 1, 9, 36)) == 1
    assert exchanges(spectral.envelope_max(field, 1, 9, 36)) == 1
    assert exchanges(spectral.wave_coefficients(field, range(1, 11), 36, env_band=(4, 7))) == 1


def test_wind_needs_two_shuffles(spark, stored):
    wind = scan_field(spark, stored, "tas").withColumnRenamed("value", "u").withColumn("v", F.col("u") / 2)
    for n_lat, n_lon in ((19, 36), (241, 480)):
        made = SphericalWind(wind, n_lat, n_lon)
        assert exchanges(made.vorticity()) == exchanges(made.rossby_wave_source()) == exchanges(made.coefficients()) == 2
        assert "Join" not in plan(made.rossby_wave_source()) and "Generate" not in plan(made.coefficients())


def test_whole_spectra_need_one_shuffle(spark, stored):
    field = scan_field(spark, stored, "tas")
    for df in (spectral.zonal_dft(field, range(241), 480), spectral.band_filter(field, 1, 239, 480), spectral.wave_envelope(field, 1, 239, 480)):
        assert exchanges(df) == 1
    assert exchanges(spectral.spectrum_power(field, 480)) == 1


def test_regions_are_one_pass(spark, stored):
    df = stats.region_means(scan_field(spark, stored, "tas"), ["zw31", "zw32", "zw33"])
    assert plan(df).count("FileScan") == 1
    assert "Or(" in re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan(df)).group(1)
