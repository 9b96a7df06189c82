"""Named latitude-longitude boxes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Box(NamedTuple):
    south: float
    north: float
    west: float
    east: float


# South, north, west, east of each named region in degrees.
REGIONS = {
    "asl": Box(-75, -60, 180, 310),
    "aus": Box(-45, -10, 110, 160),
    "ausnz": Box(-50, 0, 100, 185),
    "emia": Box(-10, 10, 165, 220),
    "emib": Box(-15, 5, 250, 290),
    "emic": Box(-10, 20, 125, 145),
    "eqpacific": Box(-30, 30, 120, 280),
    "nino1": Box(-10, -5, 270, 280),
    "nino2": Box(-5, 0, 270, 280),
    "nino12": Box(-10, 0, 270, 280),
    "nino3": Box(-5, 5, 210, 270),
    "nino34": Box(-5, 5, 190, 240),
    "nino4": Box(-5, 5, 160, 210),
    "point": Box(-59.25, -59.25, 255, 255),
    "sh": Box(-90, 0, 0, 360),
    "shextropics15": Box(-90, -15, 0, 360),
    "shextropics20": Box(-90, -20, 0, 360),
    "shextropics30": Box(-90, -30, 0, 360),
    "small": Box(-5, 0, 10, 15),
    "tropics": Box(-30, 30, 0, 360),
    "glatt": Box(20, 80, -180, 180),
    "nonpolar70": Box(-70, 70, 0, 360),
    "nonpolar80": Box(-80, 80, 0, 360),
    "sh-psa": Box(-90, 0, 90, 450),
    "sh-psa-extra": Box(-90, 30, 90, 450),
    "world-dateline": Box(-90, 90, 0, 360),
    "world-dateline-duplicate360": Box(-90, 90, 0, 360),
    "world-greenwich": Box(-90, 90, -180, 180),
    "world-psa": Box(-90, 90, 90, 450),
    "zw31": Box(-50, -45, 45, 60),
    "zw32": Box(-50, -45, 161, 171),
    "zw33": Box(-50, -45, 279, 289),
}


def as_box(region: str | Box | tuple) -> Box:
    return REGIONS[region] if isinstance(region, str) else Box(*region)


def in_box(region: str | Box | tuple, lat: str = "lat", lon: str = "lon", wrap: bool = False) -> Column:
    """Predicate for a box, inclusive on all four sides.

    ``wrap`` measures longitude eastward from the west side, so a box such as
    90..450 or -180..180 works on a 0..360 axis; without it the longitudes are
    compared as they are, which keeps the predicate pushable.
    """
    box = as_box(region)
    inside_lat = F.col(lat).between(box.south, box.north)
    if not wrap:
        return inside_lat & F.col(lon).between(box.west, box.east)
    if box.east - box.west >= 360:
        return inside_lat
    return inside_lat & (F.pmod(F.col(lon) - box.west, F.lit(360.0)) <= box.east - box.west)


def region_table(spark: SparkSession) -> DataFrame:
    """The regions as a table of 32 rows."""
    rows = [(name, *map(float, box)) for name, box in REGIONS.items()]
    return spark.createDataFrame(rows, "name string, south double, north double, west double, east double")


def region_column(names: list[str], lat: str = "lat", lon: str = "lon", wrap: bool = False) -> Column:
    """Array of the given regions that hold the row's cell.

    Exploding it labels every cell in one pass over the field, with no join.
    """
    hits = [F.when(in_box(n, lat, lon, wrap), F.lit(n)) for n in names]
    return F.array_compact(F.array(*hits))
