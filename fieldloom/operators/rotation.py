"""Rotated-pole coordinates and winds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.regions import as_box
from fieldloom.functions.scalars import adjust_lon, col
from fieldloom.operators.align import bilinear_weights, sparse_weight_regrid

DEFAULT_POLE = (20.0, 260.0)


def _sin(angle: Column) -> Column:
    return F.sin(F.radians(angle))


def _cos(angle: Column) -> Column:
    return F.cos(F.radians(angle))


def _unit(value: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def rotate_coordinates(
    lat: str | Column, lon: str | Column, pole: tuple[float, float] = DEFAULT_POLE, invert: bool = False, start: float = 0.0
) -> tuple[Column, Column]:
    """Latitude and longitude on the sphere whose north pole is at ``pole``, or back with ``invert``.

    A pole at 90N with longitude 180 is the identity.
    """
    lat, lon = col(lat), col(lon)
    pole_lat, pole_lon = F.lit(float(pole[0])), F.lit(float(pole[1]))
    if not invert:
        x, y, z = _cos(lat) * _cos(lon - pole_lon), _cos(lat) * _sin(lon - pole_lon), _sin(lat)
        east, north, up = _cos(pole_lat) * z - _sin(pole_lat) * x, -y, _sin(pole_lat) * z + _cos(pole_lat) * x
        turned = F.degrees(F.atan2(north, east))
    else:
        x, y, z = _cos(lat) * _cos(lon), _cos(lat) * _sin(lon), _sin(lat)
        east, north, up = _cos(pole_lat) * z - _sin(pole_lat) * x, -y, _sin(pole_lat) * z + _cos(pole_lat) * x
        turned = F.degrees(F.atan2(north, east)) + pole_lon
    return F.degrees(F.asin(_unit(up))), adjust_lon(turned, start)


def rotate_points(
    df: DataFrame, pole: tuple[float, float] = DEFAULT_POLE, invert: bool = False, lat: str = "lat", lon: str = "lon", start: float = 0.0
) -> DataFrame:
    new_lat, new_lon = rotate_coordinates(lat, lon, pole, invert, start)
    return df.withColumn("rot_lat", new_lat).withColumn("rot_lon", new_lon)


def rotate_wind_vectors(df: DataFrame, pole: tuple[float, float] = DEFAULT_POLE, u: str = "u", v: str = "v") -> DataFrame:
    """Adds ``u_rot`` and ``v_rot``, the wind along the axes of the rotated sphere; NULL at its poles."""
    pole_lat, turn = F.lit(float(pole[0])), F.col("lon") - F.lit(float(pole[1]))
    lat = F.col("lat")
    toward_east = -_cos(pole_lat) * _sin(turn)
    toward_north = _cos(lat) * _sin(pole_lat) - _sin(lat) * _cos(pole_lat) * _cos(turn)
    length = F.sqrt(toward_east * toward_east + toward_north * toward_north)
    nx = F.when(length > 1e-9, toward_east / length)
    ny = F.when(length > 1e-9, toward_north / length)
    return df.withColumn("u_rot", F.col(u) * ny - F.col(v) * nx).withColumn("v_rot", F.col(u) * nx + F.col(v) * ny)


def rotated_wind(
    df: DataFrame,
    targets: DataFrame,
    lat_axis: tuple[float, float, int],
    lon_axis: tuple[float, float, int],
    pole: tuple[float, float] = DEFAULT_POLE,
    others: Sequence[str] = ("time",),
    u: str = "u",
    v: str = "v",
) -> DataFrame:
    """Meridional wind on a rotated sphere, regridded linearly to ``targets`` (rotated ``lat, lon``)."""
    rotated = rotate_wind_vectors(df, pole, u, v).select(*others, "lat", "lon", F.col("v_rot").alias("vrot"))
    at_lat, at_lon = rotate_coordinates("lat", "lon", pole, invert=True)
    weights = bilinear_weights(targets, lat_axis, lon_axis, at_lat, at_lon)
    return sparse_weight_regrid(rotated, weights, lat_axis, lon_axis, others, "vrot")


def rotated_box_filter(
    df: DataFrame, box=(-10.0, 10.0, 115.0, 235.0), pole: tuple[float, float] = DEFAULT_POLE
) -> DataFrame:
    """Rows of a geographic field inside a box defined on the rotated sphere.

    The rotated place of a row is pure arithmetic on its own coordinates, so the
    filter runs in the scan stage.
    """
    box = as_box(box)
    lat, lon = rotate_coordinates("lat", "lon", pole)
    return df.where(lat.between(box.south, box.north) & (F.pmod(lon - box.west, F.lit(360.0)) <= box.east - box.west))
