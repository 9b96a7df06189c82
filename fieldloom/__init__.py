"""Analysis of gridded, time-stamped fields and their derived series on Spark.

A *field* is a DataFrame with one row per cell, ``(time, lat, lon, value)`` and
optionally ``level``; a *series* has one row per time; a *date list* one row per
date. Every operator takes and returns DataFrames and stays lazy.
"""

TIME, LAT, LON, VALUE = "time", "lat", "lon", "value"
CELL = (LAT, LON)
