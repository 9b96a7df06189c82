"""Column helpers: everything here is a built-in expression, no Python per row."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The months of each season.
SEASON_MONTHS = {
    "DJF": (12, 1, 2),
    "MAM": (3, 4, 5),
    "JJA": (6, 7, 8),
    "SON": (9, 10, 11),
}

EARTH_ROTATION = 7.292e-5
EARTH_RADIUS = 6.3712e6


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def adjust_lon(lon: str | Column, start: float = 0.0, radians: bool = False) -> Column:
    """Wrap a longitude into ``[start, start + full circle)``."""
    circle = 2.0 * math.pi if radians else 360.0
    return F.pmod(col(lon) - F.lit(float(start)), F.lit(circle)) + F.lit(float(start))


def date_only(stamp: str | Column) -> Column:
    """Date part of ISO text such as ``2001-02-03T04:05:06``."""
    return F.to_date(F.split(col(stamp), "T").getItem(0))


def local_date(stamp: str | Column, zone: str | Column) -> Column:
    """The day in ``zone`` (such as ``Australia/Melbourne`` or ``+10:00``) of a UTC time, as text or timestamp."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.to_date(F.convert_timezone(F.lit("UTC"), zone, col(stamp).cast("timestamp_ntz")))


# The text layouts accepted by ``standard_date``.
DATE_LAYOUTS = (
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "yyyyMMdd",
    "d MMM yyyy",
    "MMM d, yyyy",
)


def standard_date(text: str | Column, layouts: Sequence[str] = DATE_LAYOUTS) -> Column:
    """Any accepted date or time text as ``YYYY-MM-DD``; NULL if none fits."""
    tries = [F.try_to_timestamp(col(text), F.lit(layout)) for layout in layouts]
    return F.date_format(F.coalesce(*tries), "yyyy-MM-dd")


def season_of(time: str | Column) -> Column:
    month = F.month(col(time))
    season = F.when(month.isin(*SEASON_MONTHS["DJF"]), "DJF")
    for name in ("MAM", "JJA", "SON"):
        season = season.when(month.isin(*SEASON_MONTHS[name]), name)
    return season


def climatology_key(time: str | Column, timescale: str) -> Column:
    """Group key of a climatology: month, ordinal day, or month and day."""
    time = col(time)
    keys = {
        "monthly": F.month(time),
        "month": F.month(time),
        "daily": F.dayofyear(time),
        "dayofyear": F.dayofyear(time),
        "monthday": F.month(time) * 100 + F.dayofmonth(time),
    }
    if timescale not in keys:
        raise ValueError(f"a climatology needs one of {sorted(keys)}, not {timescale!r}")
    return keys[timescale]


def run_label(realization: str | Column, initialization: str | Column, physics: str | Column) -> Column:
    """Ensemble member label such as ``r1i1p1``."""
    parts = [F.lit("r"), col(realization), F.lit("i"), col(initialization), F.lit("p"), col(physics)]
    return F.concat(*[p.cast("string") for p in parts])


def run_details(model: str | Column, experiment: str | Column, realization: str | Column, initialization: str | Column, physics: str | Column) -> Column:
    """Struct of model, experiment and run label, from the global attributes of a run."""
    run = run_label(realization, initialization, physics)
    return F.struct(col(model).cast("string").alias("model"), col(experiment).cast("string").alias("experiment"), run.alias("run"))


def wind_speed(u: str | Column, v: str | Column) -> Column:
    u, v = col(u), col(v)
    return F.sqrt(u * u + v * v)


def planetary_vorticity(lat: str | Column, omega: float = EARTH_ROTATION) -> Column:
    return 2.0 * F.lit(omega) * F.sin(F.radians(col(lat)))


def clamp(value: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(value)))


def magnitude_abs(value: str | Column) -> Column:
    return F.abs(col(value))


def unit_convert(value: str | Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    return col(value) * F.lit(scale) + F.lit(offset)


def unpack_scale_offset(packed: str | Column, scale_factor: float, add_offset: float) -> Column:
    return F.lit(add_offset) + col(packed) * F.lit(scale_factor)


def sign_class(value: str | Column, limit: float, labels: Sequence[str]) -> Column:
    """Three-way label: below ``-limit``, above ``limit``, or between."""
    low, middle, high = labels
    value = col(value)
    return F.when(value > limit, high).when(value < -limit, low).otherwise(middle)


def tidy(value: str | Column, digits: int) -> Column:
    """Rounded value with negative zero written as zero."""
    rounded = F.round(col(value), digits)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)
