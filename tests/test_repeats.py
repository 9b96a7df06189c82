"""Repeated and missing cells, missing labels, clock times in epoch units."""

import datetime as dt

import pytest

from fieldloom.operators.events import running_mean
from fieldloom.operators.select import nearest_label
from fieldloom.sources.readers import decode_epoch_time


def test_calendar_mean_of_days_given_twice(spark):
    rows = [(dt.datetime(2001, 1, d, h), float(d)) for d in range(1, 11) for h in (0, 12)]
    got = running_mean(spark.createDataFrame(rows, "time timestamp, value double"), 3, by=(), axis="day").collect()
    assert sorted(r.value for r in got) == [float(d) for d in range(2, 10)]


def test_missing_labels_are_passed_over(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-60.0,), (-65.0,)], "lat double")
    assert [r.lat for r in nearest_label(df, "lat", [-64.0, -50.0]).collect()] == [-65.0, -60.0]


@pytest.mark.parametrize(
    ("number", "units", "want"),
    [
        (6.0, "hours since 1900-01-01 12:00:00", "1900-01-01 18:00:00"),
        (6.0, "months since 1900-01-01", "1900-07-01 00:00:00"),
        (2.0, "years since 1999-02", "2001-02-01 00:00:00"),
        (1.5, "days since 2000-01-01T06:30", "2000-01-02 18:30:00"),
        (30.0, "seconds since 2000-01-01", "2000-01-01 00:00:30"),
    ],
)
def test_epoch_units(spark, number, units, want):
    df = spark.createDataFrame([(number,)], "time double")
    assert str(decode_epoch_time(df, units).first().time) == want


def test_unknown_epoch_unit_fails(spark):
    with pytest.raises(Exception, match="unknown unit"):
        decode_epoch_time(spark.createDataFrame([(1.0,)], "time double"), "fortnights since 2000-01-01").collect()
