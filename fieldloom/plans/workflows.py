"""The reference workflows as single lazy plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.align import align_series
from fieldloom.operators.composite import composite_significance, seasonal_composite
from fieldloom.operators.events import event_table, running_mean
from fieldloom.operators.indices import index_pwi
from fieldloom.operators.phases import phase_histogram
from fieldloom.operators.rotation import rotated_wind
from fieldloom.operators.select import threshold_dates, zero_outside_lon
from fieldloom.operators.spectral import fourier_information, wave_envelope
from fieldloom.operators.stats import (
    linear_trend_fit,
    meridional_mean,
    normalise_series,
    pearson_correlation,
    quadrant_percent,
    yday_anomaly,
)
from fieldloom.session import cut_lineage
from fieldloom.sources.readers import scan_date_list
from fieldloom.sources.writers import Lineage, sink_date_list, sink_table


def smoothed_anomaly(field: DataFrame, window: int = 30, key: str = "dayofyear", axis: str = "rows") -> DataFrame:
    """Calendar anomaly followed by a running mean along time, cell by cell."""
    return running_mean(yday_anomaly(field, key), window, axis=axis)


def high_wave_dates(
    field: DataFrame, n_lon: int, band: tuple[int, int] = (1, 9), threshold: str | float = "90pct", direction: str = "greater"
) -> DataFrame:
    """Dates on which the planetary wave index of a field is beyond a threshold."""
    pwi = index_pwi(wave_envelope(field, *band, n_lon))
    return threshold_dates(pwi, threshold, direction, value="pwi").select(F.to_date("time").alias("date"))


def composite_on_high_index(
    field: DataFrame,
    target: DataFrame,
    n_lon: int,
    band: tuple[int, int] = (1, 9),
    threshold: str | float = "90pct",
    significance: bool = False,
) -> DataFrame:
    """Seasonal composite of ``target`` on the days when the wave index of ``field`` is high."""
    dates = high_wave_dates(field, n_lon, band, threshold)
    return composite_significance(target, dates) if significance else seasonal_composite(target, dates)


def stored_composite(
    field: DataFrame,
    target: DataFrame,
    n_lon: int,
    folder: str,
    inputs: tuple[str, str] = ("field", "target"),
    band: tuple[int, int] = (1, 9),
    threshold: str | float = "90pct",
    significance: bool = False,
) -> DataFrame:
    """``composite_on_high_index`` in stages that are kept below ``folder``: ``index``, ``dates`` and ``composite``.

    Each stage reads the stored one before it and notes its inputs in the table
    ``lineage`` there; ``inputs`` names the two fields. Returns the stored composite.
    """
    spark, table = field.sparkSession, f"{folder}/lineage"
    waves = f"envelope of wavenumbers {band[0]}-{band[1]} on {n_lon} longitudes"
    sink_table(index_pwi(wave_envelope(field, *band, n_lon)), f"{folder}/index", Lineage(table, "index", {inputs[0]: waves}))
    index = spark.read.parquet(f"{folder}/index")
    chosen = threshold_dates(index, threshold, value="pwi").select(F.to_date("time").alias("date"))
    sink_date_list(chosen, f"{folder}/dates", lineage=Lineage(table, "dates", {"index": f"days at or above {threshold}"}))
    dates = scan_date_list(spark, f"{folder}/dates")
    composite = composite_significance(target, dates) if significance else seasonal_composite(target, dates)
    sink_table(composite, f"{folder}/composite", Lineage(table, "composite", {"dates": "days of the composite", inputs[1]: "values"}))
    return spark.read.parquet(f"{folder}/composite")


def wave_event_statistics(
    winds: DataFrame,
    targets: DataFrame,
    lat_axis: tuple[float, float, int],
    lon_axis: tuple[float, float, int],
    window: int = 30,
    lat_band: tuple[float, float] = (-10.0, 10.0),
    lon_band: tuple[float, float] = (115.0, 235.0),
    key: str = "dayofyear",
    env_band: tuple[int, int] = (4, 7),
    min_sum: float = 17,
    freq: int = 6,
) -> DataFrame:
    """Event table of waves in the rotated meridional wind.

    The latitude mean comes before the anomaly and the running mean: all three
    are linear, so the order does not matter and far fewer rows are shuffled. It is
    checkpointed (days times longitudes), as the anomaly reads it twice.
    """
    vrot = rotated_wind(winds, targets, lat_axis, lon_axis).withColumnRenamed("vrot", "value")
    band = cut_lineage(meridional_mean(vrot.where(F.col("lat").between(*lat_band))))
    smooth = running_mean(yday_anomaly(band, key, by=["lon"]), window, by=["lon"])
    padded = zero_outside_lon(smooth, *lon_band)
    fourier = fourier_information(padded, list(range(1, 11)), lon_axis[2], env_band=env_band, sign_change=True)
    return event_table(fourier, freq=freq, min_sum=min_sum)


def wave_event_phases(events: DataFrame, res: float = 0.75, freq: int = 6, min_duration: int = 1) -> DataFrame:
    return phase_histogram(events.where(F.col("event_duration") >= min_duration), res, freq)


def index_comparison(x: DataFrame, y: DataFrame, normalise: bool = True) -> DataFrame:
    """One row comparing two ``(time, x)`` and ``(time, y)`` series: quadrants, trend and correlation."""
    pair = align_series(x, y)
    if normalise:
        pair = normalise_series(normalise_series(pair, "x"), "y")
    quadrants, trend, corr = quadrant_percent(pair), linear_trend_fit(pair), pearson_correlation(pair)
    return quadrants.join(F.broadcast(trend), F.lit(True)).join(F.broadcast(corr), F.lit(True))  # one row each
