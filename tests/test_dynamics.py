import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.functions.legendre import legendre
from fieldloom.functions.scalars import EARTH_RADIUS, EARTH_ROTATION
from fieldloom.operators import align, eof, rotation
from fieldloom.operators.wind import SphericalWind, global_grid_check


def grid(lats, lons, **values):
    lat, lon = np.meshgrid(lats, lons, indexing="ij")
    data = {"time": 0, "lat": lat.ravel(), "lon": lon.ravel()}
    for name, func in values.items():
        data[name] = np.broadcast_to(func(np.radians(lat), np.radians(lon)), lat.shape).ravel()
    return pd.DataFrame(data)


LATS, LONS = np.linspace(-90, 90, 13), np.arange(0, 360, 15.0)


def solid(spark):
    return spark.createDataFrame(grid(LATS, LONS, u=lambda p, x: 20 * np.cos(p) + 0 * x, v=lambda p, x: 0 * p))


def test_legendre_functions_are_orthonormal():
    table = legendre(25, 10)
    for p in table.p:
        assert np.allclose((p * table.weight) @ p.T, np.eye(len(p)), atol=1e-12)
    assert table.weight.sum() == pytest.approx(2)


def test_legendre_slope_by_differences():
    table, step = legendre(7201, 4), np.radians(180 / 7200)
    for p, slope in zip(table.p, table.slope):
        assert np.allclose((p[:, 3002:3011] - p[:, 3000:3009]) / (2 * step), slope[:, 3001:3010], atol=1e-5)


def test_solid_rotation(spark):
    w = SphericalWind(solid(spark), 13, 24)
    vrt = w.vorticity().toPandas()
    assert np.allclose(vrt.vrt, 2 * 20 * np.sin(np.radians(vrt.lat)) / EARTH_RADIUS, atol=1e-16)
    assert np.allclose(w.divergence().toPandas()["div"], 0, atol=1e-9)
    sf = w.streamfunction().toPandas()
    assert np.allclose(sf.sf, -20 * EARTH_RADIUS * np.sin(np.radians(sf.lat)) / 1e6, atol=1e-8)
    up = w.nondivergent_wind().toPandas()
    assert np.allclose(up.upsi, 20 * np.cos(np.radians(up.lat))) and np.allclose(up.vpsi, 0, atol=1e-12)
    eta = w.absolute_vorticity_gradient().toPandas()
    want = (2 * 20 / EARTH_RADIUS + 2 * EARTH_ROTATION) * np.cos(np.radians(eta.lat)) / EARTH_RADIUS / 1e-5
    assert np.allclose(eta.avrtgrad, want, atol=1e-12)


def test_wind_coefficients_and_incomplete_steps(spark):
    """A streamfunction cos(lat)^2 sin(lat) cos(2 lon) has its vorticity at l = 3, m = 2 alone; a step with a missing cell has nulls."""
    r = EARTH_RADIUS
    rows = grid(
        LATS, LONS, u=lambda p, x: -np.cos(2 * x) * (np.cos(p) ** 3 - 2 * np.cos(p) * np.sin(p) ** 2), v=lambda p, x: -2 * np.cos(p) * np.sin(p) * np.sin(2 * x)
    )
    holed = rows.assign(time=1).drop(index=5)
    twice = pd.concat([rows.assign(time=2), rows.assign(time=2).iloc[:1]])
    df = spark.createDataFrame(pd.concat([rows, holed, twice])).repartition(4)
    w = SphericalWind(df, 13, 24)
    c = w.coefficients().toPandas()
    assert c[c.time > 0].z_re.isna().all() and len(c) == 3 * 28
    c = c[c.time == 0].set_index(["l", "m"])
    assert abs(c.loc[(3, 2), "z_re"]) * r > 1 and np.allclose(c.drop((3, 2)).z_re * r, 0, atol=1e-12) and np.allclose(c.d_re * r, 0, atol=1e-12)
    vrt = w.vorticity().toPandas()
    assert len(vrt) == 3 * 13 * 24 and vrt[vrt.time > 0].vrt.isna().all()
    one = vrt[vrt.time == 0]
    p, x = np.radians(one.lat), np.radians(one.lon)
    assert np.allclose(one.vrt, -12 / r * np.cos(p) ** 2 * np.sin(p) * np.cos(2 * x), atol=1e-18)
    assert SphericalWind(df.limit(0), 13, 24).vorticity().count() == 0


def test_grid_check(spark):
    one_degree = spark.createDataFrame(pd.DataFrame({"lat": np.linspace(-90, 90, 360), "lon": np.arange(360.0)}))
    row = global_grid_check(one_degree).first()
    assert (row.strict, row.periodic) == (False, True)


def test_pole_at_ninety_is_the_identity(spark):
    df = spark.createDataFrame(grid(LATS[1:-1], LONS, u=lambda p, x: np.sin(x), v=lambda p, x: np.cos(p)))
    got = rotation.rotate_wind_vectors(rotation.rotate_points(df, (90.0, 180.0)), (90.0, 180.0)).toPandas()
    assert np.allclose(got.rot_lat, got.lat)
    assert np.allclose((got.rot_lon - got.lon + 180) % 360, 180)
    assert np.allclose(got.u_rot, got.u) and np.allclose(got.v_rot, got.v)


def test_rotation_keeps_speed_and_reverses(spark):
    df = spark.createDataFrame(grid(LATS[1:-1], LONS + 1.0, u=lambda p, x: np.sin(x), v=lambda p, x: np.cos(p)))
    turned = rotation.rotate_wind_vectors(rotation.rotate_points(df))
    lat, lon = rotation.rotate_coordinates("rot_lat", "rot_lon", invert=True)
    got = turned.withColumn("back_lat", lat).withColumn("back_lon", lon).toPandas()
    assert np.allclose(got.u_rot**2 + got.v_rot**2, got.u**2 + got.v**2)
    assert np.allclose(got.back_lat, got.lat) and np.allclose((got.back_lon - got.lon + 180) % 360, 180)


def test_rotated_pole_lies_at_ninety(spark):
    df = spark.createDataFrame([(20.0, 260.0)], "lat double, lon double")
    assert rotation.rotate_points(df).first().rot_lat == pytest.approx(90)


def test_regrid_constant_and_linear(spark):
    lats, lons = np.arange(-40, 41, 10.0), np.arange(0, 360, 20.0)
    axes = (-40.0, 10.0, 9), (0.0, 20.0, 18)
    targets = spark.createDataFrame(grid(np.arange(-37, 38, 7.0), np.arange(5, 360, 11.0))[["lat", "lon"]])
    source = spark.createDataFrame(grid(lats, lons, value=lambda p, x: 3 + 2 * np.degrees(p) + 0 * x))
    out = align.sparse_weight_regrid(source, align.bilinear_weights(targets, *axes), *axes).toPandas()
    assert len(out) == 11 * 33 and np.allclose(out.value, 3 + 2 * out.lat)
    inner = targets.where("abs(lat) < 30")
    constant = source.withColumn("value", F.lit(7.0))
    weights = align.conservative_weights(inner, *axes, 7.0, 11.0)
    out = align.sparse_weight_regrid(constant, weights, *axes).toPandas()
    assert np.allclose(out.value.astype(float), 7)


def test_second_order_weights_keep_integrals_and_slopes(spark):
    """Targets that tile the source's domain: the area integral is kept to 1e-9, and a field linear in sine of latitude is reproduced."""
    lats, lons = np.arange(-80, 81, 5.0), np.arange(0, 360, 10.0)
    axes = (-80.0, 5.0, 33), (0.0, 10.0, 36)
    edge = np.radians(np.stack([lats - 2.5, lats + 2.5]))
    mid = dict(zip(lats, np.sin(edge).mean(axis=0)))
    rough = np.random.default_rng(3).normal(size=(33, 36))
    source = grid(lats, lons, value=lambda p, x: rough)
    smooth = grid(lats, lons, value=lambda p, x: 3 + 2 * np.vectorize(lambda d: mid[round(d, 1)])(np.degrees(p).round(1)) + 0 * x)
    targets = spark.createDataFrame(grid(np.arange(-75, 76, 15.0), np.arange(4, 360, 24.0))[["lat", "lon"]])
    weights = align.conservative_weights(targets, *axes, 15.0, 24.0, order=2).cache()

    def area(pdf, half):
        return np.sin(np.radians(pdf.lat + half)) - np.sin(np.radians(pdf.lat - half))

    out = align.sparse_weight_regrid(spark.createDataFrame(source), weights, *axes).toPandas()
    whole = (source.value * area(source, 2.5)).sum() * 10
    assert len(out) == 11 * 15 and abs((out.value * area(out, 7.5)).sum() * 24 - whole) < 1e-9
    out = align.sparse_weight_regrid(spark.createDataFrame(smooth), weights, *axes).toPandas()
    want = 3 + (np.sin(np.radians(out.lat - 7.5)) + np.sin(np.radians(out.lat + 7.5)))
    assert np.allclose(out.value, want, atol=1e-12)
    flat = align.sparse_weight_regrid(spark.createDataFrame(smooth), align.conservative_weights(targets, *axes, 15.0, 24.0), *axes).toPandas()
    assert len(flat) == 11 * 15
    with pytest.raises(ValueError):
        align.conservative_weights(targets, *axes, 15.0, 24.0, order=3)


def test_regrid_missing_source_is_null(spark):
    axes = (0.0, 10.0, 3), (0.0, 90.0, 4)
    source = spark.createDataFrame(grid([0.0, 10.0, 20.0], [0.0, 90.0, 180.0, 270.0], value=lambda p, x: 1 + 0 * x))
    holed = source.where("not (lat = 10 and lon = 90)")
    targets = spark.createDataFrame([(5.0, 80.0), (5.0, 200.0)], "lat double, lon double")
    got = {r.lon: r.value for r in align.sparse_weight_regrid(holed, align.bilinear_weights(targets, *axes), *axes).collect()}
    assert got[80.0] is None and got[200.0] == pytest.approx(1)


def test_eof_against_numpy(spark):
    rng = np.random.default_rng(0)
    nt, lats, lons = 30, np.array([-60.0, -30.0, 0.0]), np.arange(0, 360, 60.0)
    x = rng.normal(size=(nt, 18)) @ np.diag(np.linspace(3, 0.2, 18))
    cells = [(la, lo) for la in lats for lo in lons]
    days = pd.date_range("2000-01-01", periods=nt)
    pdf = pd.DataFrame(
        [(days[t], *cells[c], x[t, c]) for t in range(nt) for c in range(18)], columns=["time", "lat", "lon", "value"]
    )
    df = spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz")).repartition(5)
    result = eof.eof(df, 3)
    weight = np.sqrt(np.cos(np.radians([c[0] for c in cells])))
    a = (x - x.mean(axis=0)) * weight
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    modes = result.modes.toPandas().sort_values("mode")
    assert np.allclose(modes.eigenvalue, s[:3] ** 2 / (nt - 1))
    assert np.allclose(modes.var_exp, s[:3] ** 2 / np.sum(s**2))
    assert np.allclose(modes.north_error, modes.var_exp * np.sqrt(2 / nt))
    patterns = result.patterns.toPandas().sort_values(["mode", "lat", "lon"])
    pcs = result.pcs.toPandas().sort_values(["mode", "time"])
    for m in range(3):
        sign = np.sign(vt[m][np.argmax(np.abs(vt[m]))])
        assert np.allclose(patterns[patterns["mode"] == m + 1].loading, sign * vt[m])
        assert np.allclose(pcs[pcs["mode"] == m + 1].pc, sign * u[:, m] * s[m])
    unit = eof.scale_pcs(result, 1).toPandas()
    assert np.allclose(unit.groupby("mode").pc.var(), 1)
    corr = eof.scale_patterns(result, 3).toPandas()
    assert corr.loading.abs().max() <= 1 + 1e-12
