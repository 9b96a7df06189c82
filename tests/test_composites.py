import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import composite
from reference import two_sided_p

SEASON = {12: "DJF", 1: "DJF", 2: "DJF", 3: "MAM", 4: "MAM", 5: "MAM", 6: "JJA", 7: "JJA", 8: "JJA", 9: "SON", 10: "SON", 11: "SON"}


def field(n=900, cells=3, seed=0):
    rng = np.random.default_rng(seed)
    days = pd.date_range("2001-01-01", periods=n)
    noise = rng.normal(size=(n, cells)).cumsum(axis=0) * 0.2 + rng.normal(size=(n, cells))
    parts = [pd.DataFrame({"time": days, "lat": -10.0 * c, "lon": 5.0, "value": noise[:, c]}) for c in range(cells)]
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz"))


def brute_n_eff(x):
    n = len(x)
    c = x - x.mean()
    c0 = np.sum(c * c) / n
    r = np.array([np.sum(c[: n - k] * c[k:]) / n / c0 for k in range(1, n - 1)])
    k = np.arange(1, n - 1)
    return n / (1 + 2 * np.sum((n - k) / n * r))


def test_effective_sample_size(spark):
    pdf = field()
    got = composite.effective_sample_size(to_spark(spark, pdf)).toPandas().set_index("lat")
    for lat, part in pdf.groupby("lat"):
        assert got.n_eff[lat] == pytest.approx(brute_n_eff(part.value.to_numpy()), rel=1e-9)
        assert got["var"][lat] == pytest.approx(part.value.var(ddof=0), rel=1e-9)


def test_effective_sample_size_of_one_series(spark):
    pdf = field(cells=1)
    got = composite.effective_sample_size(to_spark(spark, pdf), by=[]).first()
    assert got.n_eff == pytest.approx(brute_n_eff(pdf.value.to_numpy()), rel=1e-9)


@pytest.mark.parametrize("dof", ["n", "neff"])
def test_significance(spark, dof):
    pdf = field()
    days = pdf.time.unique()[::4]
    dates = spark.createDataFrame(pd.DataFrame({"date": days}))
    got = composite.composite_significance(to_spark(spark, pdf), dates, dof=dof).toPandas().set_index(["season", "lat"])
    assert len(got) == 15
    pdf["season"] = pdf.time.dt.month.map(SEASON)
    for (season, lat), row in got.iterrows():
        everything = pdf[(pdf.lat == lat) & ((season == "annual") | (pdf.season == season))]
        x = everything[everything.time.isin(days)].value.to_numpy()
        n_eff = brute_n_eff(x)
        var = x.var() / n_eff
        if var <= 0:
            continue
        t = (x.mean() - everything.value.mean()) / np.sqrt(var)
        freedom = (len(x) if dof == "n" else n_eff) - 1
        assert row.t == pytest.approx(t, rel=1e-8)
        if freedom > 0:
            assert row.p == pytest.approx(float(two_sided_p(np.array([t]), np.array([freedom]))[0]), rel=1e-6, abs=1e-9)


def test_significance_of_one_or_two_times(spark):
    """No lag enters the formula: n_eff is n. A single time has no spread, so t is infinite, and no freedom, so p is NULL."""
    values = {"2001-01-05": 1.0, "2001-02-05": 4.0, "2001-04-05": 2.0, "2001-05-05": 6.0, "2001-07-05": 9.0, "2001-08-05": 5.0, "2001-10-05": 3.0, "2001-11-05": 3.0}
    pdf = pd.DataFrame({"time": pd.to_datetime(list(values)), "lat": 0.0, "lon": 5.0, "value": list(values.values())})
    dates = spark.createDataFrame([(d,) for d in ("2001-01-05", "2001-02-05", "2001-04-05", "2001-07-05", "2001-10-05")], "date string")
    got = composite.composite_significance(to_spark(spark, pdf), dates).toPandas().set_index("season")
    assert got.n.to_dict() == {"annual": 5, "DJF": 2, "MAM": 1, "JJA": 1, "SON": 1}
    assert got.n_eff.drop("annual").to_dict() == {"DJF": 2.0, "MAM": 1.0, "JJA": 1.0, "SON": 1.0}
    assert got.t["DJF"] == 0.0 and got.t["MAM"] == -np.inf and got.t["JJA"] == np.inf
    assert np.isnan(got.t["SON"])  # no spread and no difference
    assert got.p["DJF"] == pytest.approx(1.0) and got.p[["MAM", "JJA", "SON"]].isna().all()


def test_composite_without_dates_and_annual_row(spark):
    pdf = field(n=400)
    got = composite.seasonal_composite(to_spark(spark, pdf)).toPandas().set_index(["season", "lat"])
    assert got.loc[("annual", 0.0)].value == pytest.approx(pdf[pdf.lat == 0].value.mean())
    assert got.loc[("annual", 0.0)].n == 400


def test_overlapping_phase_groups(spark):
    days = pd.DataFrame({"time": pd.date_range("2001-01-01", periods=4), "wave6_phase": [5.0, 12.0, 30.0, 58.0]})
    groups = {"wide": (0.0, 20.0), "narrow": (10.0, 15.0), "around": (55.0, 68.0)}
    got = composite.phase_groups(to_spark(spark, days), groups).toPandas()
    pairs = {(str(r.date), r.label) for r in got.itertuples()}
    assert pairs == {
        ("2001-01-01", "wide"),
        ("2001-01-02", "wide"),
        ("2001-01-02", "narrow"),
        ("2001-01-01", "around"),
        ("2001-01-04", "around"),
    }
