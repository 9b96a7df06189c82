import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import calendars, events, phases


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz")).repartition(4)


def wave_table(n=500, seed=0):
    rng = np.random.default_rng(seed)
    data = {"time": pd.date_range("2000-01-01", periods=n)}
    for k in range(1, 11):
        data[f"wave{k}_amp"] = rng.integers(0, 30, n).astype(float)
        data[f"wave{k}_phase"] = rng.integers(0, 80, n) * 0.75
    data["sign_count"] = rng.integers(0, 12, n)
    data["env_max"] = rng.random(n)
    return pd.DataFrame(data)


def expected_events(pdf, min_sum):
    amps = [f"wave{k}_amp" for k in range(1, 11)]
    ranks = pdf[amps].rank(axis=1)
    out = pdf.assign(**{a: ranks[a] for a in amps})
    out = out[(ranks.wave5_amp + ranks.wave6_amp) >= min_sum].copy()
    out["event_number"] = (~(out.time.diff() < pd.Timedelta("2 days"))).cumsum() - 1
    parts = []
    for _, part in out.groupby("event_number"):
        phase = part.wave6_phase.to_numpy()
        if len(phase) > 1 and np.abs(np.diff(phase)).max() > 50:
            phase = np.where(phase < 30, phase + 60, phase)
        slope = np.polyfit(np.arange(len(phase)), phase, 1)[0] if len(phase) > 1 else np.nan
        flags = np.arange(len(phase))
        parts.append(
            part.assign(
                event_duration=len(phase), event_phase=phase, event_gradient=slope, event_start=flags == 0, event_end=flags == len(phase) - 1
            )
        )
    return pd.concat(parts)


@pytest.mark.parametrize("min_sum", [10, 17])
def test_event_table(spark, min_sum):
    pdf = wave_table()
    got = events.event_table(to_spark(spark, pdf), min_sum=min_sum).toPandas().sort_values("time")
    want = expected_events(pdf, min_sum)
    assert list(got.time) == list(want.time)
    for c in ("event_number", "event_duration", "event_phase", "event_start", "event_end", "wave1_amp", "wave5_amp"):
        assert list(got[c]) == list(want[c]), c
    assert np.allclose(got.event_gradient.fillna(-99), want.event_gradient.fillna(-99))


def test_event_table_of_several_stations(spark):
    parts = [wave_table(seed=s).assign(station=s) for s in (1, 2)]
    got = events.event_table(to_spark(spark, pd.concat(parts)), min_sum=10, by=["station"]).toPandas()
    for part in parts:
        want = expected_events(part, 10)
        mine = got[got.station == part.station.iloc[0]].sort_values("time")
        assert list(mine.event_number) == list(want.event_number)
        assert list(mine.event_phase) == list(want.event_phase)


def test_event_statistics(spark):
    pdf = expected_events(wave_table(), 10)
    df = to_spark(spark, pdf)
    hist = events.duration_histogram(df).toPandas()
    lengths = pdf.groupby("event_number").size()
    assert dict(zip(hist.event_duration, hist.n_events)) == lengths.value_counts().to_dict()
    assert hist.mean_duration.iloc[0] == pytest.approx(lengths.mean())
    stats = events.gradient_stats(df.where(~F.isnan("event_gradient")), 2).first()
    slopes = pdf[pdf.event_duration >= 2].groupby("event_number").event_gradient.first()
    assert stats.gradient_mean == pytest.approx(slopes.mean())
    assert stats.gradient_std == pytest.approx(slopes.std(ddof=0))
    assert stats.forward == (slopes > 0.25).sum()


def test_phase_histogram_has_every_bin(spark):
    pdf = wave_table(40)
    got = phases.phase_histogram(to_spark(spark, pdf)).toPandas()
    annual = got[got.season == "annual"].sort_values("bin")
    assert len(annual) == 80 and annual.n.sum() == 40
    edges = np.arange(-0.375, 60, 0.75)
    assert list(annual.n) == list(np.histogram(pdf.wave6_phase, edges)[0])


def grow(data, centre, width, highest):
    size = len(data) - 1
    left = right = centre
    for _ in range(width):
        r, l = (right + 1) % size, (left - 1) % size
        better = data[r] >= data[l] if highest else data[r] <= data[l]
        left, right = (left, r) if better else (l, right)
    return left, right


def test_density_and_extrema(spark):
    pdf = wave_table(400)
    density = phases.cyclic_kde(to_spark(spark, pdf), bandwidth=2.5)
    annual = density.where("season = 'annual'").toPandas().sort_values("bin")
    bins, x = np.arange(80) * 0.75, pdf.wave6_phase.to_numpy()
    d = bins[:, None] - x[None, :] + np.array([-59.25, 0, 59.25])[:, None, None]
    want = np.exp(-0.5 * (d / 2.5) ** 2).sum(axis=(0, 2)) / (2.5 * np.sqrt(2 * np.pi)) * 0.75
    assert np.allclose(annual.density, want)
    got = phases.kde_extrema(density.where("season = 'annual'"), 10).toPandas().sort_values("bin")
    rows = []
    for i in range(1, 79):
        if want[i] > max(want[i - 1], want[i + 1]) or want[i] < min(want[i - 1], want[i + 1]):
            top = want[i] > want[i - 1]
            left, right = grow(want, i, 10, top)
            rows.append(("max" if top else "min", bins[i], bins[left], bins[right]))
    assert [tuple(r) for r in got[["kind", "bin", "left", "right"]].to_numpy()] == rows


def test_automatic_bandwidth(spark):
    pdf = wave_table(300)
    got = phases.cyclic_kde(to_spark(spark, pdf)).where("season = 'annual' and bin = 0").first().density
    x = pdf.wave6_phase.to_numpy()
    h = x.std(ddof=1) * 300**-0.2
    d = (0 - x[None, :] + np.array([-59.25, 0, 59.25])[:, None]) / h
    assert got == pytest.approx(np.exp(-0.5 * d**2).sum() / (h * np.sqrt(2 * np.pi)) * 0.75)


@pytest.mark.parametrize(
    "first, last, want",
    [
        ("1979-01-01", "2014-12-31", ("1979-12-01", "2014-11-30")),
        ("1979-12-01", "2014-11-30", ("1980-12-01", "2013-11-30")),
    ],
)
def test_season_year_bounds(spark, first, last, want):
    df = spark.createDataFrame([(first,), (last,)], "date string").selectExpr("date(date) as date")
    got = calendars.season_year_bounds(df).first()
    assert (str(got[0]), str(got[1])) == want


def test_calendar_counts(spark):
    dates = spark.createDataFrame([("2000-12-05",), ("2000-12-05",), ("2001-01-10",), ("2001-07-01",)], "date string")
    dates = dates.selectExpr("date(date) as date")
    filled = calendars.fill_calendar(calendars.counts_per_day(dates), "2000-12-01", "2001-11-30")
    assert filled.count() == 365
    row = calendars.season_year_counts(filled).first()
    assert (row.season_year, row.DJF, row.MAM, row.JJA, row.SON, row.annual) == (2001, 3, 0, 1, 0, 4)
    overlap = calendars.date_overlap_stats(dates, dates.where("month(date) = 12")).toPandas().set_index("season")
    assert tuple(overlap.loc["annual"]) == (4, 2, 1, 25.0)


def test_trend_p_value(spark):
    y = [3, 5, 4, 8, 7, 9]
    rows = [(2000 + i, v, v, v, v, 4 * v) for i, v in enumerate(y)]
    counts = spark.createDataFrame(rows, "season_year int, DJF int, MAM int, JJA int, SON int, annual int")
    got = calendars.seasonal_trend(counts).where("season = 'DJF'").first()
    assert got.slope == pytest.approx(np.polyfit(range(6), y, 1)[0])
    r = np.corrcoef(range(6), y)[0, 1]
    t = r * np.sqrt(4 / (1 - r * r))
    # Closed form of the tail for four degrees of freedom.
    z = t / np.sqrt(4 + t * t)
    assert got.p == pytest.approx(1 - z * (1 + (1 - z * z) / 2), rel=1e-9)


def test_calendars_follow_the_tables(spark, tmp_path):
    """Orders of other years than those of the supplied tables lose no day and no whole year."""
    from workload.catalog import QUERIES

    days = pd.date_range("2004-03-05", "2009-02-10")
    orders = pd.DataFrame({"o_orderdate": days, "o_totalprice": 4e5 + np.random.default_rng(1).integers(0, 900, len(days))})
    orders = orders.assign(o_orderkey=orders.index, o_orderpriority="1-URGENT", o_orderstatus="F")
    to_spark(spark, orders.rename(columns={"o_orderdate": "time"})).withColumnRenamed("time", "o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    filled = QUERIES["fill_calendar"](spark, str(tmp_path)).toPandas().sort_values("date")
    assert list(filled["date"].iloc[[0, -1]]) == ["2004-01-01", "2009-12-31"]
    assert len(filled) == len(pd.date_range("2004-01-01", "2009-12-31")) and filled["count"].sum() == len(days)
    high = days[orders.o_totalprice >= orders.o_totalprice.quantile(0.75)]
    whole = high[(high >= "2004-12-01") & (high <= "2008-11-30")]
    got = {r.season_year: r.annual for r in QUERIES["season_year_counts"](spark, str(tmp_path)).collect()}
    assert got == (whole + pd.DateOffset(months=1)).year.value_counts().to_dict() and sorted(got) == [2005, 2006, 2007, 2008]
    assert {r.n for r in QUERIES["seasonal_trend"](spark, str(tmp_path)).collect()} == {4}
    assert QUERIES["seasonal_trend_p"](spark, str(tmp_path)).count() == 5


def test_calendar_of_no_whole_year_is_empty(spark):
    days = spark.sql("SELECT DATE '2001-03-01' AS date UNION ALL SELECT DATE '2001-08-01'")
    counts = calendars.counts_per_day(days)
    assert calendars.fill_calendar(counts, bounds=calendars.season_year_bounds(days)).count() == 0
    none = calendars.calendar_year_bounds(days.limit(0))
    assert calendars.fill_calendar(counts, bounds=none).count() == 0
