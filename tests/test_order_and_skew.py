"""Two-stage ordered scans, exact quantiles and hot groups against plain pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import align, events, select, stats
from fieldloom.operators.grouping import attach, group_stats, parted
from fieldloom.operators.ordered import even_buckets, scan_in_order
from fieldloom.operators.quantiles import exact_quantile


def daily(n, seed=0, drop=0.3):
    rng = np.random.default_rng(seed)
    days = pd.date_range("2000-01-01", periods=n)[rng.random(n) > drop]
    return pd.DataFrame({"time": days, "value": rng.normal(size=days.size)})


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("time", F.col("time").cast("timestamp_ntz")).repartition(5)


@pytest.mark.parametrize("hot_groups", [1, 3, 1000])
@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("reread", [True, False])
def test_attach_matches_plain_join(spark, hot_groups, how, reread):
    rng = np.random.default_rng(1)
    keys = np.where(rng.random(600) < 0.4, 0, rng.integers(1, 30, 600))
    df = spark.createDataFrame(pd.DataFrame({"k": keys, "v": rng.normal(size=600)})).repartition(6)
    df = df.union(df.where("k = 0"))  # identical copies must stay whole as well
    nulls = spark.createDataFrame([(None, 5.0)] * 40, "k long, v double")
    stats_df = group_stats(df.where("k <> 7"), ["k"], F.avg("v").alias("m"))
    got = attach(df.union(nulls), stats_df, ["k"], how=how, hot_groups=hot_groups, reread=reread).toPandas()
    assert got.k.isna().sum() == (40 if how == "left" else 0) and got[got.k.isna()].m.isna().all()
    got, pdf = got[got.k.notna()], df.toPandas()
    want = pdf[pdf.k != 7].groupby("k").v.mean().rename("m")
    want = pdf.merge(want, left_on="k", right_index=True, how=how)
    assert len(got) == len(want)
    assert np.allclose(sorted(got.m.fillna(-99)), sorted(want.m.fillna(-99)))
    assert np.isclose((got.v - got.m).sum(), (want.v - want.m).sum())


def test_rows_of_crowded_groups_do_not_move(spark):
    """A third of the rows in one key and a third without a key: neither is among the rows that are shuffled."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 2, F.col("id") % 500).alias("k"), "id")
    held = group_stats(df, ["k"], F.sum("id").alias("s")).where("k is not null").select("k", F.array(F.struct("s", "_group_rows")).alias("_stats"))
    near, far = parted(df, held, ["k"], "left", 1)
    assert far.where("k = 0 or k is null").count() == 0 and near.count() > 5900 and near.count() + far.count() == 9000
    text = attach(df, group_stats(df, ["k"], F.sum("id").alias("s")), ["k"], reread=True)._jdf.queryExecution().executedPlan().toString()
    assert "Union" in text and "BroadcastHashJoin" in text


def test_lower_arrays_have_one_row_a_key(spark):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "k int, v double")
    lower = spark.createDataFrame([(0, 1.0), (1, None)], "k int, low double")
    got = align.broadcast_dims(df, lower, ["k"]).collect()
    assert len(got) == 20 and {(r.k, r.low) for r in got} == {(0, 1.0), (1, None)}
    with pytest.raises(Exception, match="comes twice"):
        align.broadcast_dims(df, lower.union(lower), ["k"]).collect()


def test_far_values_do_not_widen_bins(spark):
    """One value of 1e12 among 200,000: what reaches the last pass stays a small part of the rows."""
    rng = np.random.default_rng(8)
    values = np.append(rng.normal(size=200_000), [1e12, -1e15])
    df = spark.createDataFrame(pd.DataFrame({"v": values, "g": np.arange(len(values)) % 2})).repartition(8)
    for q in (0.0, 0.37, 0.9, 1.0):
        quantile = exact_quantile(df, "v", q)
        assert quantile.first()[0] == np.quantile(values, q)
    got = {r.g: r["quantile"] for r in exact_quantile(df, "v", 0.9, by=["g"]).collect()}
    assert got == {g: np.quantile(values[g::2], 0.9) for g in (0, 1)}
    sides = df.agg(F.percentile_approx("v", [0.9 - 2e-4, 0.9 + 2e-4], 10_000).alias("s")).first().s
    assert 2 < ((values >= sides[0]) & (values <= sides[1])).sum() < 400
    text = select.threshold_dates(df.withColumnRenamed("g", "time"), "90pct", value="v")._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in text or "Scan" in text


def test_asof_with_a_third_of_the_rows_on_one_day(spark):
    rng = np.random.default_rng(4)
    spread = rng.integers(0, 300 * 86_400, 4000)
    crowd = 100 * 86_400 + rng.integers(0, 86_400, 2000)
    at = pd.to_datetime("2001-01-01") + pd.to_timedelta(np.concatenate([spread, crowd]), unit="s")
    pdf = pd.DataFrame({"time": at, "value": rng.normal(size=6000), "label": rng.random(6000) < 0.5})
    df = spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz")).repartition(6)
    pieces = even_buckets(df, F.unix_micros(F.col("time").cast("timestamp"))).groupBy("_split").count().toPandas()["count"]
    assert len(pieces) > 100 and pieces.max() <= 2 * pieces.median()
    got = align.asof_select(df.where("label"), df.where("not label").select(F.col("time").alias("target")), "pad").toPandas().sort_values("target")
    labels = pdf[pdf.label].groupby("time", as_index=False).value.min().sort_values("time")
    targets = pdf[~pdf.label][["time"]].drop_duplicates().sort_values("time")
    want = pd.merge_asof(targets, labels.assign(label=labels.time), on="time")
    assert np.allclose(got.value.astype(float).fillna(-9), want.value.fillna(-9)) and len(got) == len(want)
    back = align.asof_select(df.where("label"), df.where("not label").select(F.col("time").alias("target")), "backfill").toPandas().sort_values("target")
    want = pd.merge_asof(targets, labels.assign(label=labels.time), on="time", direction="forward")
    assert np.allclose(back.value.astype(float).fillna(-9), want.value.fillna(-9))


def test_scan_in_order_equals_global_window(spark):
    pdf = daily(800)
    pdf["gappy"] = pdf.value.where(pdf.value > 1)
    df = to_spark(spark, pdf).withColumn("gappy", F.when(~F.isnan("gappy"), F.col("gappy")))
    out = scan_in_order(
        df,
        "time",
        ordinal="i",
        lags={"before": "value"},
        leads={"after": "value"},
        totals={"total": "value"},
        carried={"pad": "gappy"},
        carried_back={"fill": "gappy"},
    )
    got = out.toPandas().sort_values("time").reset_index(drop=True)
    assert list(got.i) == list(range(len(pdf)))
    pd.testing.assert_series_equal(got.before, pdf.value.shift(), check_names=False)
    pd.testing.assert_series_equal(got.after, pdf.value.shift(-1), check_names=False)
    pd.testing.assert_series_equal(got.total, pdf.value.cumsum(), check_names=False)
    pd.testing.assert_series_equal(got["pad"], pdf.gappy.ffill(), check_names=False)
    pd.testing.assert_series_equal(got["fill"], pdf.gappy.bfill(), check_names=False)


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 0.975, 1.0])
def test_exact_quantile(spark, q):
    rng = np.random.default_rng(3)
    values = np.where(rng.random(3000) < 0.35, 1.5, rng.lognormal(0, 3, 3000))
    group = np.where(rng.random(3000) < 0.4, 0, rng.integers(1, 9, 3000))
    df = spark.createDataFrame(pd.DataFrame({"g": group, "v": values}))
    assert exact_quantile(df, "v", q).first()[0] == pytest.approx(np.quantile(values, q), rel=1e-12)
    got = {r.g: r["quantile"] for r in exact_quantile(df, "v", q, by=["g"], bins=16).collect()}
    for g in np.unique(group):
        assert got[g] == pytest.approx(np.quantile(values[group == g], q), rel=1e-12)


def test_quantile_of_constant_and_nan(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (float("nan"),), (None,)], "v double")
    assert exact_quantile(df, "v", 0.3).first()[0] == 2.0


@pytest.mark.parametrize("window", [1, 4, 5, 30])
def test_running_mean_blocks(spark, window, monkeypatch):
    monkeypatch.setattr(events, "BLOCK", 64)
    pdf = daily(700)
    got = events.running_mean(to_spark(spark, pdf), window, by=[]).toPandas().sort_values("time")
    want = pdf.set_index("time").value.rolling(window, center=True).mean().dropna()
    assert list(got.time) == list(want.index)
    assert np.allclose(got.value, want)
    one_window = events.running_mean(to_spark(spark, pdf).withColumn("c", F.lit(1)), window, by=["c"])
    assert np.allclose(one_window.toPandas().sort_values("time").value, want)


def test_running_mean_calendar_drops_gaps(spark):
    pdf = daily(300, drop=0.05)
    got = events.running_mean(to_spark(spark, pdf), 7, by=[], axis="day").toPandas().sort_values("time")
    full = pdf.set_index("time").value.asfreq("D")
    want = full.rolling(7, center=True).mean().dropna()
    want = want[want.index.isin(pdf.time)]
    assert list(got.time) == list(want.index) and np.allclose(got.value, want)


def test_gap_sessionise(spark):
    pdf = daily(900, seed=5, drop=0.4)
    got = events.gap_sessionise(to_spark(spark, pdf), position="i").toPandas().sort_values("time")
    gaps = pdf.time.diff()
    starts = ~(gaps < pd.Timedelta("2 days"))
    assert list(got.event_number) == list(starts.cumsum() - 1)
    assert list(got.in_event) == list(~starts)
    assert np.allclose(got.time_delta.fillna(-1), gaps.dt.days.fillna(-1))


def test_sessions_per_series(spark):
    parts = [daily(200, seed=s, drop=0.5).assign(station=s) for s in (1, 2, 3)]
    got = events.gap_sessionise(to_spark(spark, pd.concat(parts)), by=["station"]).toPandas()
    for part in parts:
        mine = got[got.station == part.station.iloc[0]].sort_values("time")
        assert list(mine.event_number) == list((~(part.time.diff() < pd.Timedelta("2 days"))).cumsum() - 1)


def test_autocorrelation_over_blocks(spark):
    n = 9000  # more than one block of positions
    start = dt.datetime(1990, 1, 1)
    x = np.cumsum(np.random.default_rng(2).normal(size=n)) * 0.1
    pdf = pd.DataFrame({"time": [start + dt.timedelta(hours=6 * i) for i in range(n)], "value": x})
    got = stats.autocorrelation(to_spark(spark, pdf), 50).toPandas().sort_values("lag")
    c = x - x.mean()
    want = [np.sum(c[: n - k] * c[k:]) / np.sum(c * c) for k in range(51)]
    assert list(got.lag) == list(range(51)) and np.allclose(got.r, want, atol=1e-9)


def test_autocorrelation_all_lags(spark):
    pdf = daily(60, drop=0)
    got = stats.autocorrelation(to_spark(spark, pdf), 100).toPandas()
    assert sorted(got.lag) == list(range(60))


def test_thin_stride(spark):
    pdf = daily(300)
    got = select.thin_stride(to_spark(spark, pdf), 7).toPandas().sort_values("time")
    assert list(got.time) == list(pdf.time[::7])


def test_time_slice_from_the_end(spark):
    pdf = daily(50, drop=0).assign(lat=0.0, lon=0.0)
    got = select.time_slice_or_mean(to_spark(spark, pdf), -2).first()
    assert got.value == pytest.approx(pdf.value.iloc[-2])


def test_find_duplicates_hot_item(spark):
    items = ["a"] * 40 + ["b", "b", "c"]
    df = spark.createDataFrame(list(enumerate(items)), "pos long, item string")
    got = stats.find_duplicates(df, "item", "pos").toPandas()
    assert len(got) == 42 and set(got.item) == {"a", "b"}
    assert set(got[got.item == "a"].occurrences) == {40}


def test_threshold_ignores_missing_values(spark):
    pdf = daily(200, drop=0)
    pdf.loc[::10, "value"] = np.nan
    got = select.threshold_dates(to_spark(spark, pdf), "90pct").toPandas()
    assert sorted(got.time) == list(pdf[pdf.value >= np.nanpercentile(pdf.value, 90)].time)
    low = select.threshold_dates(to_spark(spark, pdf), 0.5, "less").toPandas()
    assert len(low) == (pdf.value <= 0.5).sum()
    high = select.threshold_dates(to_spark(spark, pdf), 0.5).toPandas()
    assert len(high) == (pdf.value >= 0.5).sum()


def test_running_mean_of_cells_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(events, "BLOCK", 64)
    parts = [daily(300, seed=s).assign(lat=float(s)) for s in (1, 2)]
    df = to_spark(spark, pd.concat(parts))
    whole = events.running_mean(df, 6, by=["lat"]).toPandas().sort_values(["lat", "time"])
    blocks = events.running_mean(df, 6, by=["lat"], blocked=True).toPandas().sort_values(["lat", "time"])
    assert list(whole.time) == list(blocks.time) and np.allclose(whole.value, blocks.value)
