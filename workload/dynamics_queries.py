"""Rotated winds, EOFs and spherical-harmonic wind quantities."""

from pyspark.sql import functions as F

from fieldloom.operators import eof, rotation
from fieldloom.operators.wind import SphericalWind, global_grid_check
from workload import views
from workload.registry import query

A = "6.3712e6"
OMEGA = "7.292e-5"


def _wind(spark, d):
    return SphericalWind(views.wind(spark, d), views.WIND_LATS, views.WIND_LONS)


_GRID = "time:d lat lon"
_ZETA = f"(-12 / {A} * amp_a * c * c * s * cos(2 * x) + 2 * amp_u * s / {A})"
_DIV = f"(-6 / {A} * amp_b * c * s * cos(x))"


@query("wind_magnitude", f"{_GRID} spd:6", "SELECT time, lat, lon, sqrt(u * u + v * v) AS spd FROM wind")
def _(spark, d):
    return _wind(spark, d).magnitude()


@query("vorticity", f"{_GRID} vrt:11", f"SELECT time, lat, lon, {_ZETA} AS vrt FROM wind")
def _(spark, d):
    return _wind(spark, d).vorticity()


@query("divergence", f"{_GRID} div:5", f"SELECT time, lat, lon, {_DIV} / 1e-6 AS div FROM wind")
def _(spark, d):
    return _wind(spark, d).divergence()


@query("absolute_vorticity", f"{_GRID} avrt:5", f"SELECT time, lat, lon, ({_ZETA} + 2 * {OMEGA} * s) / 1e-5 AS avrt FROM wind")
def _(spark, d):
    return _wind(spark, d).absolute_vorticity()


_ETA_Y = f"((-12 * amp_a * cos(2 * x) * (c * c * c - 2 * c * s * s) / {A} + 2 * amp_u * c / {A} + 2 * {OMEGA} * c) / {A})"
_ETA_X = f"(24 * amp_a * c * s * sin(2 * x) / {A} / {A})"


@query("absolute_vorticity_gradient", f"{_GRID} avrtgrad:11", f"SELECT time, lat, lon, sqrt(pow({_ETA_X}, 2) + pow({_ETA_Y}, 2)) / 1e-5 AS avrtgrad FROM wind")
def _(spark, d):
    return _wind(spark, d).absolute_vorticity_gradient()


@query("streamfunction", f"{_GRID} sf:5", f"SELECT time, lat, lon, {A} * (amp_a * c * c * s * cos(2 * x) - amp_u * s) / 1e6 AS sf FROM wind")
def _(spark, d):
    return _wind(spark, d).streamfunction()


@query("velocity_potential", f"{_GRID} vp:5", f"SELECT time, lat, lon, {A} * amp_b * c * s * cos(x) / 1e6 AS vp FROM wind")
def _(spark, d):
    return _wind(spark, d).velocity_potential()


@query("irrotational_wind", f"{_GRID} uchi:6 vchi:6", "SELECT time, lat, lon, -amp_b * s * sin(x) AS uchi, amp_b * cos(x) * (c * c - s * s) AS vchi FROM wind")
def _(spark, d):
    return _wind(spark, d).irrotational_wind()


@query("nondivergent_wind", f"{_GRID} upsi:6 vpsi:6", """
    SELECT time, lat, lon, -amp_a * cos(2 * x) * (c * c * c - 2 * c * s * s) + amp_u * c AS upsi, -2 * amp_a * c * s * sin(2 * x) AS vpsi FROM wind""")
def _(spark, d):
    return _wind(spark, d).nondivergent_wind()


@query("rossby_wave_source", f"{_GRID} rws1:5 rws2:5 rws:5", f"""
    SELECT *, rws1 + rws2 AS rws FROM (SELECT time, lat, lon, -({_ZETA} + 2 * {OMEGA} * s) * {_DIV} / 1e-11 AS rws1,
        -(-amp_b * s * sin(x) * {_ETA_X} + amp_b * cos(x) * (c * c - s * s) * {_ETA_Y}) / 1e-11 AS rws2 FROM wind)""")
def _(spark, d):
    return _wind(spark, d).rossby_wave_source()


@query("global_grid_check", "lat_span:3 lon_span:3 strict:b periodic:b", """
    SELECT lat_span, lon_span, lat_span > 179 AND lon_span > 359 AS strict, lat_span > 179 AND lon_span + lon_span / (n - 1) >= 360 AS periodic
    FROM (SELECT max(lat) - min(lat) AS lat_span, max(lon) - min(lon) AS lon_span, count(DISTINCT lon) AS n FROM wind)""")
def _(spark, d):
    return global_grid_check(views.wind(spark, d))


def rotated_targets(spark):
    """The rotated grid: the labels of the geographic one, inner latitudes only."""
    lats = spark.range(views.WIND_LATS).select((F.col("id") * 10.0 - 90.0).alias("lat"))
    return lats.withColumn("lon", F.explode(F.array(*[F.lit(10.0 * j) for j in range(views.WIND_LONS)])))


_VROT = """
    (-u * cos(radians(20)) * sin(radians(lon - 260)) + v * (cos(radians(lat)) * sin(radians(20)) - sin(radians(lat)) * cos(radians(20)) * cos(radians(lon - 260))))
    / sqrt(pow(cos(radians(20)) * sin(radians(lon - 260)), 2) + pow(cos(radians(lat)) * sin(radians(20)) - sin(radians(lat)) * cos(radians(20)) * cos(radians(lon - 260)), 2))"""


@query("rotate_wind_vectors", f"{_GRID} v_rot:6", f"SELECT time, lat, lon, CASE WHEN abs(lat) = 20 AND lon IN (80, 260) AND sin(radians(lon - 260)) * lat < 1e-9 AND (lat - 20) * (lon - 80) <= 0 AND (lat = 20) = (lon = 260) THEN NULL ELSE {_VROT} END AS v_rot FROM wind")
def _(spark, d):
    return rotation.rotate_wind_vectors(views.wind(spark, d))


@query("rotated_wind", f"{_GRID} vrot:6", f"""
    WITH vr AS (SELECT time, lat, lon, CASE WHEN (lat = 20 AND lon = 260) OR (lat = -20 AND lon = 80) THEN NULL ELSE {_VROT} END AS w FROM wind),
    tgt AS (SELECT lat, lon, degrees(asin(greatest(-1, least(1, zz)))) AS glat, (degrees(atan2(yy, xx)) + 260 + 720) % 360 AS glon FROM (
        SELECT lat, lon, cp * sin(radians(lat)) - sp * cos(radians(lat)) * cos(radians(lon)) AS xx, -cos(radians(lat)) * sin(radians(lon)) AS yy,
               sp * sin(radians(lat)) + cp * cos(radians(lat)) * cos(radians(lon)) AS zz
        FROM (SELECT CAST(-90 + 10 * i AS DOUBLE) AS lat, CAST(10 * j AS DOUBLE) AS lon, sin(radians(20)) AS sp, cos(radians(20)) AS cp FROM range(19) a(i), range(36) b(j)))),
    spot AS (SELECT lat, lon, least(17, floor((glat + 90) / 10)) AS li, (glat + 90) / 10 AS la, floor(glon / 10) AS lj, glon / 10 AS lo FROM tgt),
    corner AS (SELECT lat, lon, -90 + 10 * (li + di) AS slat, (10 * (lj + dj)) % 360 AS slon,
                      (CASE WHEN di = 0 THEN 1 - (la - li) ELSE la - li END) * (CASE WHEN dj = 0 THEN 1 - (lo - lj) ELSE lo - lj END) AS wt
               FROM spot, range(2) a(di), range(2) b(dj))
    SELECT time, c.lat, c.lon, CASE WHEN count(w) FILTER (abs(wt) > 1e-9) = count(*) FILTER (abs(wt) > 1e-9) THEN sum(wt * w) END AS vrot
    FROM corner c JOIN vr ON vr.lat = slat AND vr.lon = slon GROUP BY ALL""")
def _(spark, d):
    return rotation.rotated_wind(views.wind(spark, d), rotated_targets(spark), (-90.0, 10.0, 19), (0.0, 10.0, 36))


# EOFs of a field with two known modes.


@query("eof_patterns", "mode:i lat lon loading:6", "SELECT * FROM mode_patterns")
def _(spark, d):
    return eof.scale_patterns(eof.eof(views.rank_two(spark, d), 2))


@query("eof_pcs", "mode:i time:d pc:5", "SELECT * FROM mode_pcs")
def _(spark, d):
    return eof.scale_pcs(eof.eof(views.rank_two(spark, d), 2))


@query("eof_scaling", "scaling:i mode:i lat lon loading:5", """
    SELECT 1 AS scaling, mode, lat, lon, loading / root AS loading FROM mode_patterns
    UNION ALL SELECT 2, mode, lat, lon, loading * root FROM mode_patterns""")
def _(spark, d):
    result = eof.eof(views.rank_two(spark, d), 2)
    one = eof.scale_patterns(result, 1).withColumn("scaling", F.lit(1))
    return one.unionByName(eof.scale_patterns(result, 2).withColumn("scaling", F.lit(2)))


@query("eof_correlation", "mode:i lat lon loading:5", """
    SELECT mode, lat, lon, corr(pc, value) AS loading FROM mode_pcs JOIN (
        SELECT time, lat, lon, a1 * p1 + a2 * p2 AS value FROM two_modes CROSS JOIN patterns) USING (time) GROUP BY ALL""")
def _(spark, d):
    return eof.scale_patterns(eof.eof(views.rank_two(spark, d), 2), 3)


@query("pc_scaling", "scaling:i mode:i time:d pc:5", """
    SELECT 1 AS scaling, mode, time, pc / root AS pc FROM mode_pcs UNION ALL SELECT 2, mode, time, pc * root FROM mode_pcs""")
def _(spark, d):
    result = eof.eof(views.rank_two(spark, d), 2)
    one = eof.scale_pcs(result, 1).withColumn("scaling", F.lit(1))
    return one.unionByName(eof.scale_pcs(result, 2).withColumn("scaling", F.lit(2)))


@query("eof_variance_fraction", "mode:i eigenvalue:4 var_exp:6", "SELECT mode, eig AS eigenvalue, eig / total AS var_exp FROM mode_list")
def _(spark, d):
    return eof.eof(views.rank_two(spark, d), 2).modes


@query("north_test", "mode:i north_error:6", "SELECT mode, eig * sqrt(2.0 / nt) / total AS north_error FROM mode_list")
def _(spark, d):
    return eof.eof(views.rank_two(spark, d), 2).modes


@query("eof_by_group", "group:s mode:i eigenvalue:4 var_exp:5")
def _(spark, d):
    groups = eof.group_predicates(["sh", "shextropics30"], ["annual", "DJF"])
    return eof.eof_by_group(views.field(spark, d), groups, 3).modes


# Parts of the field with two modes: what is left of it still has two, found from two-by-two covariances in the SQL.


def _grouped(spark, d):
    lat, month = F.col("lat"), F.month("time")
    groups = {"all": F.lit(True), "north": lat >= -15, "winter": month.isin(12, 1, 2), "north_summer": (lat >= 0) & month.between(6, 8)}
    return eof.eof_by_group(views.rank_two(spark, d), groups, 2)


@query("eof_group_modes", "part:s mode:i eigenvalue:4 var_exp:6 north_error:6 cells:i", 'SELECT part, mode, eig AS eigenvalue, eig / total AS var_exp, eig * sqrt(2.0 / nt) / total AS north_error, cells FROM part_modes')
def _(spark, d):
    return _grouped(spark, d).modes.withColumnRenamed("group", "part")


@query("eof_group_patterns", "part:s mode:i lat lon loading:6", """
    SELECT part, mode, lat, lon, turn * (y1 * p1 + y2 * p2) * w / norm AS loading FROM part_signs JOIN part_cells USING (part)""")
def _(spark, d):
    return eof.scale_patterns(_grouped(spark, d)).withColumnRenamed("group", "part")


@query("eof_group_pcs", "part:s mode:i time:d pc:5", """
    SELECT part, mode, time, turn * (c1 * (g11 * y1 + g12 * y2) + c2 * (g12 * y1 + g22 * y2)) / norm AS pc FROM part_signs JOIN part_times USING (part)""")
def _(spark, d):
    return eof.scale_pcs(_grouped(spark, d)).withColumnRenamed("group", "part")


@query("eof_group_correlation", "part:s mode:i lat lon loading:5", """
    SELECT part, mode, lat, lon, corr(turn * (c1 * (g11 * y1 + g12 * y2) + c2 * (g12 * y1 + g22 * y2)), a1 * p1 + a2 * p2) AS loading
    FROM part_signs JOIN part_times USING (part) JOIN part_cells USING (part) GROUP BY ALL""")
def _(spark, d):
    return eof.scale_patterns(_grouped(spark, d), 3).withColumnRenamed("group", "part")


@query("eof_field", "mode:i eigenvalue:4 var_exp:5")
def _(spark, d):
    return eof.eof(views.field(spark, d), 4).modes
