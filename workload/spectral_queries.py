"""Fourier analysis along latitude circles."""

from pyspark.sql import functions as F

from fieldloom.operators import select, spectral, stats
from workload import views
from workload.registry import query

N = 36
CIRCLE_COLUMNS = "time:d lat"


def band_mean(spark, d):
    """Mean of the field over 45-30S, one circle per month."""
    rows = views.field(spark, d).where(F.col("lat").between(-45, -30))
    return stats.meridional_mean(rows)


@query("zonal_dft", "time:d lat k:i re:5 im:5", "SELECT * FROM dft WHERE k BETWEEN 0 AND 9")
def _(spark, d):
    return spectral.zonal_dft(views.field(spark, d), range(10), N)


@query("zonal_dft_full", "time:d lat k:i re:5 im:5", "SELECT * FROM dft WHERE k BETWEEN 0 AND 18")
def _(spark, d):
    return spectral.zonal_dft(views.field(spark, d), range(19), N)


_KEPT = """
    SELECT time, lat, lon, {scale} / 36 * sum(re * cos(radians(k * lon)) - im * sin(radians(k * lon))) AS real,
           {imag} / 36 * sum(re * sin(radians(k * lon)) + im * cos(radians(k * lon))) AS imag
    FROM dft CROSS JOIN lon_axis WHERE k BETWEEN {low} AND {high} GROUP BY ALL"""


@query("band_filter", "time:d lat lon real:6 imag:6", _KEPT.format(scale="1.0", imag="1.0", low=2, high=6))
def _(spark, d):
    return spectral.band_filter(views.field(spark, d), 2, 6, N, "negative")


@query("band_filter_positive", "time:d lat lon real:6 imag:6", _KEPT.format(scale="1.0", imag="-1.0", low=4, high=4))
def _(spark, d):
    return spectral.band_filter(views.field(spark, d), 4, 4, N, "positive")


@query("band_filter_all", "time:d lat lon real:6 imag:6", "SELECT time, lat, lon, value AS real, 0 AS imag FROM field")
def _(spark, d):
    return spectral.band_filter(views.field(spark, d), None, None, N)


@query("inverse_filtered", "time:d lat lon value:6", "SELECT time, lat, lon, real AS value FROM (" + _KEPT.format(scale="2.0", imag="0", low=1, high=9) + ")")
def _(spark, d):
    return spectral.inverse_filtered(views.field(spark, d), 1, 9, N)


@query("wave_envelope", "time:d lat lon value:6", "SELECT * FROM envelope")
def _(spark, d):
    return spectral.wave_envelope(views.field(spark, d), 1, 9, N)


_CRESTS = """
    SELECT time, lat, k, max(s) AS amp, coalesce(min(lon) FILTER (s > prev AND s > next), 0) AS phase FROM (
        SELECT *, coalesce(lag(s) OVER w, last_value(s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev,
               coalesce(lead(s) OVER w, first_value(s) OVER w) AS next
        FROM single WINDOW w AS (PARTITION BY time, lat, k ORDER BY lon)) GROUP BY ALL"""


@query("wave_amplitude", "time:d lat k:i amp:6", "SELECT time, lat, k, max(s) AS amp FROM single GROUP BY ALL")
def _(spark, d):
    return spectral.wave_amplitude(views.field(spark, d), range(1, 11), N)


@query("wave_phase", "time:d lat k:i phase:3", f"SELECT * FROM ({_CRESTS}) WHERE k < 10")
def _(spark, d):
    return spectral.wave_phase(views.field(spark, d), range(1, 10), N)


@query("wave_coefficients", "time:d lat " + " ".join(f"wave{k}_amp:6 wave{k}_phase:3" for k in range(1, 7)),
       "SELECT time, lat, " + ", ".join(f"max(amp) FILTER (k = {k}) AS wave{k}_amp, max(phase) FILTER (k = {k}) AS wave{k}_phase" for k in range(1, 7))
       + f" FROM ({_CRESTS}) GROUP BY time, lat")
def _(spark, d):
    return spectral.wave_coefficients(views.field(spark, d), range(1, 7), N)


@query("envelope_max", "time:d lat env_max:6", "SELECT time, lat, max(value) AS env_max FROM envelope GROUP BY ALL")
def _(spark, d):
    return spectral.envelope_max(views.field(spark, d), 1, 9, N)


@query("sign_change_count", "time:d lat sign_count:i", """
    SELECT time, lat, count(*) FILTER (f <> before) AS sign_count FROM (
        SELECT time, lat, lon, f, lag(f) OVER (PARTITION BY time, lat ORDER BY lon) AS before FROM (
            SELECT time, lat, lon, coalesce(first_value(s IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                                            last_value(s IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS f
            FROM (SELECT time, lat, lon, nullif(sign(CASE WHEN lon <= 40 OR lon >= 300 THEN 0 ELSE value - 20 END), 0) AS s FROM field)
            WINDOW w AS (PARTITION BY time, lat ORDER BY lon)))
    GROUP BY time, lat""")
def _(spark, d):
    shifted = select.convert_units(views.field(spark, d), offset=-20.0)
    return spectral.sign_change_count(select.zero_outside_lon(shifted, 40, 300))


_AMP = "2.0 / 36 * sqrt(re * re + im * im)"


@query("spectrum_power", "time:d lat k:i power:6", f"SELECT time, lat, k, pow({_AMP}, 2) AS power FROM dft WHERE k BETWEEN 1 AND 17")
def _(spark, d):
    return spectral.spectrum_power(views.field(spark, d), N, "power")


@query("spectrum_amplitude", "time:d lat k:i power:6", f"SELECT time, lat, k, {_AMP} AS power FROM dft WHERE k BETWEEN 1 AND 17")
def _(spark, d):
    return spectral.spectrum_power(views.field(spark, d), N)


@query("r2_global_variance", "time:d lat k:i power:8", f"""
    SELECT time, lat, k, 18 * pow({_AMP}, 2) / (35 * (SELECT var_pop(value) FROM field)) AS power FROM dft WHERE k BETWEEN 1 AND 17""")
def _(spark, d):
    return spectral.spectrum_power(views.field(spark, d), N, "R2")


@query("r2_row_variance", "time:d lat k:i power:7", f"""
    SELECT time, lat, k, 18 * pow({_AMP}, 2) / (35 * var) AS power FROM dft
    JOIN (SELECT time, lat, var_pop(value) AS var FROM field GROUP BY ALL) USING (time, lat) WHERE k BETWEEN 1 AND 17""")
def _(spark, d):
    return spectral.spectrum_power(views.field(spark, d), N, "R2", per_row=True)


@query("time_mean_spectrum", "label:s k:i power:6", f"""
    SELECT label, k, avg({_AMP}) AS power FROM (
        SELECT *, 'all' AS label FROM band_dft UNION ALL SELECT *, 'high' FROM band_dft WHERE CAST(time AS DATE) IN (SELECT date FROM pwi_days))
    WHERE k BETWEEN 1 AND 17 GROUP BY ALL""")
def _(spark, d):
    from workload.stats_queries import pwi_days

    labelled = stats.label_by_dates(band_mean(spark, d), high=pwi_days(spark, d))
    return spectral.time_mean_spectrum(labelled, N, labels=["label"])


@query("time_mean_spectrum_windows", "width:i k:i power:8", f"""
    WITH smooth AS (
        SELECT 1 AS win, time, lon, value FROM lat_band
        UNION ALL SELECT 5, time, lon, m FROM (SELECT *, avg(value) OVER w AS m, count(*) OVER w AS c FROM lat_band
            WINDOW w AS (PARTITION BY lon ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE c = 5
        UNION ALL SELECT 10, time, lon, m FROM (SELECT *, avg(value) OVER w AS m, count(*) OVER w AS c FROM lat_band
            WINDOW w AS (PARTITION BY lon ORDER BY time ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)) WHERE c = 10),
    coef AS (SELECT win, time, k, sum(value * cos(radians(k * lon))) AS re, -sum(value * sin(radians(k * lon))) AS im
             FROM smooth CROSS JOIN range(1, 18) r(k) GROUP BY ALL),
    var AS (SELECT win, var_pop(value) AS v FROM smooth GROUP BY win)
    SELECT win AS width, k, avg(18 * pow({_AMP}, 2) / (35 * v)) AS power FROM coef JOIN var USING (win) GROUP BY ALL""")
def _(spark, d):
    from fieldloom.operators.events import running_mean

    band = band_mean(spark, d)
    parts = None
    for window in (1, 5, 10):
        part = running_mean(band, window, by=["lon"]).withColumn("width", F.lit(window))
        parts = part if parts is None else parts.unionByName(part)
    return spectral.time_mean_spectrum(parts, N, "R2", labels=["width"])


@query("periodogram_day", "time:d k:i peak:6", """
    SELECT time, k, max(s) AS peak FROM (SELECT time, k, lon, 1.0 / 36 * (re * cos(radians(k * lon)) - im * sin(radians(k * lon))) AS s
        FROM band_dft CROSS JOIN lon_axis WHERE k BETWEEN 1 AND 9) GROUP BY ALL""")
def _(spark, d):
    return spectral.periodogram_day(band_mean(spark, d), range(1, 10), N)


@query("fourier_components_day", "time:d lon series:s value:6", """
    WITH wave AS (SELECT time, lon, k, 2.0 / 36 * (re * cos(radians(k * lon)) - im * sin(radians(k * lon))) AS a,
                         -2.0 / 36 * (re * sin(radians(k * lon)) + im * cos(radians(k * lon))) AS b FROM band_dft CROSS JOIN lon_axis)
    SELECT time, lon, 'component_' || k AS series, a AS value FROM wave WHERE k BETWEEN 1 AND 4
    UNION ALL SELECT time, lon, 'reconstruction_2_6', sum(a) FROM wave WHERE k BETWEEN 2 AND 6 GROUP BY ALL
    UNION ALL SELECT time, lon, 'envelope_2_6', sqrt(pow(sum(a), 2) + pow(sum(b), 2)) FROM wave WHERE k BETWEEN 2 AND 6 GROUP BY ALL
    UNION ALL SELECT time, lon, 'original', value FROM lat_band""")
def _(spark, d):
    return spectral.fourier_components_day(band_mean(spark, d), range(1, 5), [(2, 6)], N)


@query("local_extrema", "time:d lat lon value:6 kind:s", """
    SELECT * FROM (SELECT time, lat, lon, value, CASE WHEN value > before AND value > after THEN 'max' WHEN value < before AND value < after THEN 'min' END AS kind FROM (
        SELECT *, coalesce(lag(value) OVER w, last_value(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS before,
               coalesce(lead(value) OVER w, first_value(value) OVER w) AS after FROM field WINDOW w AS (PARTITION BY time, lat ORDER BY lon))) WHERE kind IS NOT NULL""")
def _(spark, d):
    return spectral.local_extrema(views.field(spark, d))


@query("local_extrema_series", "time:d value:6 kind:s", """
    SELECT time, value, kind FROM (SELECT time, value, CASE WHEN value > before AND value > after THEN 'max' WHEN value < before AND value < after THEN 'min' END AS kind FROM (
        SELECT time, value, lag(value) OVER w AS before, lead(value) OVER w AS after FROM series WINDOW w AS (ORDER BY time))) WHERE kind IS NOT NULL""")
def _(spark, d):
    return spectral.local_extrema(views.series(spark, d), "time", by=[], wrap=False)


@query("fourier_information", "time:d wave1_amp:6 wave3_amp:6 wave3_phase:3 wave9_amp:6 env_max:6 sign_count:i", """
    WITH s AS (SELECT time, k, lon, 2.0 / 36 * (re * cos(radians(k * lon)) - im * sin(radians(k * lon))) AS s,
                      2.0 / 36 * (re * sin(radians(k * lon)) + im * cos(radians(k * lon))) AS i FROM band_dft CROSS JOIN lon_axis),
    n AS (SELECT *, coalesce(lag(s) OVER w, last_value(s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev,
                 coalesce(lead(s) OVER w, first_value(s) OVER w) AS next FROM s WINDOW w AS (PARTITION BY time, k ORDER BY lon)),
    e AS (SELECT time, max(v) AS env_max FROM (SELECT time, lon, sqrt(pow(sum(s), 2) + pow(sum(i), 2)) AS v FROM s WHERE k BETWEEN 4 AND 7 GROUP BY ALL) GROUP BY time),
    z AS (SELECT time, count(*) FILTER (sign(value) <> before) AS sign_count FROM (SELECT *, lag(sign(value)) OVER (PARTITION BY time ORDER BY lon) AS before FROM lat_band) GROUP BY time)
    SELECT time, max(s) FILTER (k = 1) AS wave1_amp, max(s) FILTER (k = 3) AS wave3_amp, coalesce(min(lon) FILTER (k = 3 AND s > prev AND s > next), 0) AS wave3_phase,
           max(s) FILTER (k = 9) AS wave9_amp, any_value(env_max) AS env_max, any_value(sign_count) AS sign_count
    FROM n JOIN e USING (time) JOIN z USING (time) GROUP BY time""")
def _(spark, d):
    return spectral.fourier_information(band_mean(spark, d), range(1, 11), N, env_band=(4, 7), sign_change=True)


@query("apply_along_dim", "time:d lat lon value:6", """
    SELECT time, lat, lon, sum(value) OVER (PARTITION BY time, lat ORDER BY lon) - lon * value AS value FROM field""")
def _(spark, d):
    import numpy as np

    from fieldloom.operators.along import apply_along_dim

    return apply_along_dim(views.field(spark, d), lambda x: np.cumsum(x) - 10.0 * np.arange(x.size) * x, "lon", ["time", "lat"])
