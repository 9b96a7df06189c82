"""Fourier analysis along latitude circles.

Whole spectra and bands come from a fast Fourier transform of circles that one
shuffle has gathered into rows. Amplitudes and phases of single wavenumbers are
plain sums by circle, with map-side partial sums, and work inside that
partitioning without a further shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.circles import gather, transform
from fieldloom.operators.ordered import even_buckets, scan_in_order

CIRCLE = ("time", "lat")


def _angle(k: Column | int, lon: Column | str, start: float) -> Column:
    lon = F.col(lon) if isinstance(lon, str) else lon
    return F.radians((lon - F.lit(float(start))) * k)


def _complete(value: str, n_lon: int) -> Column:
    return (F.count(value) == n_lon) & (F.count(F.lit(1)) == n_lon)


def _wide_coefficients(
    df: DataFrame, ks: Sequence[int], n_lon: int, by: Sequence[str], value: str, lon: str, start: float
) -> DataFrame:
    """``(by..., re_k, im_k...)``; a circle with missing cells gives NULLs."""
    v, full = F.col(value), _complete(value, n_lon)
    sums = []
    for k in ks:
        angle = _angle(k, lon, start)
        sums.append(F.when(full, F.sum(v * F.cos(angle))).alias(f"re_{k}"))
        sums.append(F.when(full, -F.sum(v * F.sin(angle))).alias(f"im_{k}"))
    return df.groupBy(*by).agg(*sums)


def zonal_dft(
    df: DataFrame,
    ks: Sequence[int],
    n_lon: int,
    by: Sequence[str] = CIRCLE,
    value: str = "value",
    lon: str = "lon",
    start: float = 0.0,
) -> DataFrame:
    """Fourier coefficients ``(by..., k, re, im)`` for the given wavenumbers.

    ``n_lon`` is the number of equally spaced longitudes of a full circle and
    ``start`` the first one.
    """
    ks = sorted(set(ks))
    folded = np.array([k % n_lon for k in ks], int)
    mirrored = 2 * folded > n_lon
    folded = np.where(mirrored, n_lon - folded, folded)

    def spectrum(matrices: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found = np.fft.rfft(matrices[0], axis=1)[:, folded]
        return found.real, np.where(mirrored, -found.imag, found.imag)

    lists = transform(gather(df, by, [value], lon), 1, n_lon, start, ["re", "im"], spectrum)
    waves = lists.withColumn("k", F.array(*[F.lit(k) for k in ks]))
    return waves.select(*by, F.inline(F.arrays_zip("k", "re", "im")))


def _band(n_lon: int, low: int | None, high: int | None) -> list[int]:
    """Wavenumbers kept by bounds; 0 or None is no bound."""
    return [k for k in range(0, n_lon // 2 + 1) if (not low or k >= low) and (not high or k <= high)]


def _weights(n_lon: int, k: int, exclude: str | None) -> tuple[int, int]:
    """How often wavenumber k counts from the positive and from the negative half.

    The mean belongs to neither half; the Nyquist term of an even axis counts as
    negative.
    """
    if k == 0:
        return 1, 0
    if 2 * k == n_lon:
        return 0, 0 if exclude == "negative" else 1
    return (0 if exclude == "positive" else 1), (0 if exclude == "negative" else 1)


def _synthesis(lon: Column, ks: Sequence[int], n_lon: int, exclude: str | None, start: float) -> tuple[Column, Column]:
    """Real and imaginary part of the inverse transform at a longitude."""
    real, imag = F.lit(0.0), F.lit(0.0)
    for k in ks:
        plus, minus = _weights(n_lon, k, exclude)
        if plus + minus == 0:
            continue
        angle = _angle(k, lon, start)
        re, im, c, s = F.col(f"re_{k}"), F.col(f"im_{k}"), F.cos(angle), F.sin(angle)
        real = real + F.lit((plus + minus) / n_lon) * (re * c - im * s)
        if plus != minus:
            imag = imag + F.lit((plus - minus) / n_lon) * (re * s + im * c)
    return real, imag


def _circle(n_lon: int, start: float) -> Column:
    step = 360.0 / n_lon
    return F.transform(F.sequence(F.lit(0), F.lit(n_lon - 1)), lambda j: F.lit(float(start)) + j * F.lit(step))


def _filtered(
    df: DataFrame,
    low: int | None,
    high: int | None,
    n_lon: int,
    exclude: str | None,
    by: Sequence[str],
    value: str,
    lon: str,
    start: float,
    outputs: dict[str, Callable[[np.ndarray], np.ndarray]],
) -> DataFrame:
    """``(by..., outputs...)``: array columns made of the complex inverse transform of a wavenumber band."""
    if exclude not in ("positive", "negative", None):
        raise ValueError("exclude is 'positive', 'negative' or None")
    plus, minus = np.zeros(n_lon), np.zeros(n_lon)
    for k in _band(n_lon, low, high):
        plus[k], minus[k] = _weights(n_lon, k, exclude)
    weight = plus + np.roll(minus[::-1], 1)  # a negative wavenumber -k lies at n_lon - k

    def inverse(matrices: list[np.ndarray]) -> list[np.ndarray]:
        found = np.fft.ifft(np.fft.fft(matrices[0], axis=1) * weight, axis=1)
        return [make(found) for make in outputs.values()]

    return transform(gather(df, by, [value], lon), 1, n_lon, start, list(outputs), inverse)


def _cells(lists: DataFrame, by: Sequence[str], names: Sequence[str], n_lon: int, lon: str, start: float) -> DataFrame:
    """A row per longitude of the array columns ``names``."""
    axis = lists.withColumn("_lon", _circle(n_lon, start))
    return axis.select(*by, F.inline(F.arrays_zip("_lon", *names))).withColumnRenamed("_lon", lon)


def band_filter(
    df: DataFrame,
    low: int | None,
    high: int | None,
    n_lon: int,
    exclude: str | None = None,
    by: Sequence[str] = CIRCLE,
    value: str = "value",
    lon: str = "lon",
    start: float = 0.0,
) -> DataFrame:
    """Inverse transform of a wavenumber band: ``(by..., lon, real, imag)``."""
    parts = {"real": lambda z: z.real, "imag": lambda z: z.imag}
    lists = _filtered(df, low, high, n_lon, exclude, by, value, lon, start, parts)
    return _cells(lists, by, list(parts), n_lon, lon, start)


def inverse_filtered(
    df: DataFrame, low, high, n_lon: int, by: Sequence[str] = CIRCLE, value: str = "value", lon: str = "lon", start: float = 0.0
) -> DataFrame:
    """Real signal of the band: ``(by..., lon, value)``."""
    lists = _filtered(df, low, high, n_lon, None, by, value, lon, start, {value: lambda z: z.real})
    return _cells(lists, by, [value], n_lon, lon, start)


# The real signal of a band is also known by this name.
hilbert = inverse_filtered


def _envelope(z: np.ndarray) -> np.ndarray:
    return 2.0 * np.abs(z)


def wave_envelope(
    df: DataFrame, low, high, n_lon: int, by: Sequence[str] = CIRCLE, value: str = "value", lon: str = "lon", start: float = 0.0
) -> DataFrame:
    """Twice the modulus of the positive half of the band: ``(by..., lon, value)``."""
    lists = _filtered(df, low, high, n_lon, "negative", by, value, lon, start, {value: _envelope})
    return _cells(lists, by, [value], n_lon, lon, start)


def envelope_max(
    df: DataFrame, low, high, n_lon: int, by: Sequence[str] = CIRCLE, value: str = "value", lon: str = "lon", start: float = 0.0
) -> DataFrame:
    """Largest envelope of each circle: ``(by..., env_max)``."""
    largest = {"env_max": lambda z: _envelope(z).max(1, keepdims=True)}
    lists = _filtered(df, low, high, n_lon, "negative", by, value, lon, start, largest)
    return lists.withColumn("env_max", F.get("env_max", F.lit(0)))


def wave_coefficients(
    df: DataFrame,
    ks: Sequence[int],
    n_lon: int,
    by: Sequence[str] = CIRCLE,
    value: str = "value",
    lon: str = "lon",
    start: float = 0.0,
    env_band: tuple[int, int] | None = None,
) -> DataFrame:
    """``(by..., waveK_amp, waveK_phase..., [env_max])``.

    The amplitude is the largest value of the single-wavenumber signal on the
    grid; the phase is the longitude of its first strict local maximum on the
    circle, or the first longitude if there is none. Neighbouring values follow
    from the coefficients, so no row looks at another row. ``env_band`` adds the
    largest envelope of a band from the same coefficients.
    """
    ks = list(ks)
    band = _band(n_lon, *env_band) if env_band else []
    step = 360.0 / n_lon
    wide = _wide_coefficients(df, sorted({*ks, *band}), n_lon, by, value, lon, start)
    cells = wide.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n_lon - 1))))
    here = F.lit(float(start)) + F.col("_j") * F.lit(step)

    # s(j) and s(j+1) + s(j-1), s(j+1) - s(j-1) of one wavenumber are the same sine
    # and cosine sums with fixed factors, so each longitude needs one angle per k.
    columns = []
    for k in ks:
        plus, minus = _weights(n_lon, k, None)
        scale, angle, turn = (plus + minus) / n_lon, _angle(k, here, start), math.radians(k * step)
        c, s = F.cos(angle), F.sin(angle)
        signal = F.lit(scale) * (F.col(f"re_{k}") * c - F.col(f"im_{k}") * s)
        quarter = F.lit(scale) * (F.col(f"re_{k}") * s + F.col(f"im_{k}") * c)
        columns += [signal.alias(f"_s{k}"), (F.lit(math.sin(turn)) * quarter).alias(f"_q{k}")]
        columns.append((F.lit(math.cos(turn)) * signal).alias(f"_c{k}"))
    if band:
        real, imag = _synthesis(here, band, n_lon, "negative", start)
        columns.append((2.0 * F.sqrt(real * real + imag * imag)).alias("_env"))
    cells = cells.select(*by, "_j", *columns)
    aggs = []
    for k in ks:
        s, q, c = F.col(f"_s{k}"), F.col(f"_q{k}"), F.col(f"_c{k}")
        crest = F.min(F.when((s > c - q) & (s > c + q), F.col("_j")))
        aggs.append(F.max(s).alias(f"wave{k}_amp"))
        phase = F.lit(float(start)) + F.coalesce(crest, F.lit(0)) * F.lit(step)
        aggs.append(F.when(F.max(s).isNotNull(), phase).alias(f"wave{k}_phase"))
    if band:
        aggs.append(F.max("_env").alias("env_max"))
    return cells.groupBy(*by).agg(*aggs)


def wave_amplitude(df: DataFrame, ks: Sequence[int], n_lon: int, by: Sequence[str] = CIRCLE, **options) -> DataFrame:
    """``(by..., k, amp)``."""
    wide = wave_coefficients(df, ks, n_lon, by, **options)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"wave{k}_amp").alias("amp")) for k in ks])
    return wide.select(*by, F.inline(rows))


def wave_phase(df: DataFrame, ks: Sequence[int], n_lon: int, by: Sequence[str] = CIRCLE, **options) -> DataFrame:
    """``(by..., k, phase)``."""
    wide = wave_coefficients(df, ks, n_lon, by, **options)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"wave{k}_phase").alias("phase")) for k in ks])
    return wide.select(*by, F.inline(rows))


def fourier_information(
    df: DataFrame,
    ks: Sequence[int],
    n_lon: int,
    env_band: tuple[int, int] | None = None,
    sign_change: bool = False,
    by: Sequence[str] = ("time",),
    **options,
) -> DataFrame:
    """Amplitudes and phases with the optional envelope maximum and sign-change count, one row per circle."""
    out = wave_coefficients(df, ks, n_lon, by, env_band=env_band, **options)
    if sign_change:
        out = out.join(sign_change_count(df, by, options.get("value", "value"), options.get("lon", "lon")), list(by), "inner")
    return out


def sign_change_count(df: DataFrame, by: Sequence[str] = CIRCLE, value: str = "value", lon: str = "lon") -> DataFrame:
    """Sign flips along each circle. A zero takes the next non-zero sign, trailing zeros the previous; all zeros give 0."""
    along = Window.partitionBy(*by).orderBy(lon)
    rest = along.rowsBetween(0, Window.unboundedFollowing)
    sofar = along.rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.col(value) != 0, F.signum(value))
    filled = df.select(*by, lon, sign.alias("_s")).withColumn(
        "_f", F.coalesce(F.first("_s", ignorenulls=True).over(rest), F.last("_s", ignorenulls=True).over(sofar))
    )
    flips = filled.withColumn("_flip", (F.col("_f") != F.lag("_f").over(along)).cast("int"))
    return flips.groupBy(*by).agg(F.coalesce(F.sum("_flip"), F.lit(0)).cast("long").alias("sign_count"))


def spectrum_power(
    df: DataFrame,
    n_lon: int,
    scaling: str = "amplitude",
    per_row: bool = False,
    by: Sequence[str] = CIRCLE,
    value: str = "value",
    **options,
) -> DataFrame:
    """Spectrum of the positive half, ``(by..., k, power)``, k = 1..n/2-1.

    ``R2`` divides by the population variance of the whole block, or of each
    circle with ``per_row``.
    """
    ks = range(1, n_lon // 2)
    amp = 2.0 * F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / n_lon
    coefs = zonal_dft(df, ks, n_lon, by, value, **options).withColumn("_a", amp)
    if scaling == "amplitude":
        return coefs.select(*by, "k", F.col("_a").alias("power"))
    squared = F.col("_a") * F.col("_a")
    if scaling == "power":
        return coefs.select(*by, "k", squared.alias("power"))
    if scaling != "R2":
        raise ValueError("scaling is amplitude, power or R2")
    variance = df.groupBy(*(by if per_row else [])).agg(F.var_pop(value).alias("_var"))
    if per_row:
        scaled = coefs.join(variance, list(by), "inner")
    else:
        scaled = coefs.join(F.broadcast(variance), F.lit(True), "inner")  # one row
    share = F.lit(math.floor(n_lon / 2)) * squared / (F.lit(n_lon - 1) * F.col("_var"))
    return scaled.select(*by, "k", share.alias("power"))


def time_mean_spectrum(
    df: DataFrame, n_lon: int, scaling: str = "amplitude", labels: Sequence[str] = (), by: Sequence[str] = ("time",), **options
) -> DataFrame:
    """Mean spectrum per wavenumber and label: ``(labels..., k, power)``.

    With ``R2`` each label has its own block variance.
    """
    labels = list(labels)
    if scaling != "R2":
        spectra = spectrum_power(df, n_lon, scaling, by=[*labels, *by], **options)
        return spectra.groupBy(*labels, "k").agg(F.avg("power").alias("power"))
    value = options.get("value", "value")
    squares = spectrum_power(df, n_lon, "power", by=[*labels, *by], **options)
    means = squares.groupBy(*labels, "k").agg(F.avg("power").alias("power"))
    variance = df.groupBy(*labels).agg(F.var_pop(value).alias("_var"))
    joined = means.join(variance, labels, "inner") if labels else means.join(F.broadcast(variance), F.lit(True))  # one row
    share = F.lit(math.floor(n_lon / 2)) * F.col("power") / (F.lit(n_lon - 1) * F.col("_var"))
    return joined.select(*labels, "k", share.alias("power"))


def periodogram_day(
    df: DataFrame, ks: Sequence[int], n_lon: int, by: Sequence[str] = ("time",), value: str = "value", lon: str = "lon", start: float = 0.0
) -> DataFrame:
    """Largest value of each single-wavenumber signal with the positive half removed: ``(by..., k, peak)``."""
    ks = list(ks)
    wide = _wide_coefficients(df, ks, n_lon, by, value, lon, start)
    cells = wide.withColumn(lon, F.explode(_circle(n_lon, start)))
    peaks = cells.groupBy(*by).agg(
        *[F.max(_synthesis(F.col(lon), [k], n_lon, "positive", start)[0]).alias(f"_p{k}") for k in ks]
    )
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_p{k}").alias("peak")) for k in ks])
    return peaks.select(*by, F.inline(rows))


def fourier_components_day(
    df: DataFrame,
    ks: Sequence[int],
    bands: Sequence[tuple[int, int]],
    n_lon: int,
    by: Sequence[str] = ("time",),
    value: str = "value",
    lon: str = "lon",
    start: float = 0.0,
) -> DataFrame:
    """Curves along longitude: ``(by..., lon, series, value)``.

    Single-wavenumber components, the envelope and reconstruction of each band
    (twice the negative half), and the original.
    """
    needed = sorted({*ks, *[k for low, high in bands for k in _band(n_lon, low, high)]})
    wide = _wide_coefficients(df, needed, n_lon, by, value, lon, start)
    cells = wide.withColumn(lon, F.explode(_circle(n_lon, start)))

    def curve(name: str, c: Column) -> Column:
        return F.struct(F.lit(name).alias("series"), c.alias(value))

    curves = []
    for k in ks:
        curves.append(curve(f"component_{k}", 2.0 * _synthesis(F.col(lon), [k], n_lon, "positive", start)[0]))
    for low, high in bands:
        real, imag = _synthesis(F.col(lon), _band(n_lon, low, high), n_lon, "positive", start)
        curves.append(curve(f"reconstruction_{low}_{high}", 2.0 * real))
        curves.append(curve(f"envelope_{low}_{high}", 2.0 * F.sqrt(real * real + imag * imag)))
    derived = cells.select(*by, lon, F.inline(F.array(*curves)))
    return derived.unionByName(df.select(*by, lon, F.lit("original").alias("series"), value))


def _circular_neighbours(df: DataFrame, order: str, by: Sequence[str], value: str, wrap: bool) -> tuple[DataFrame, Column, Column]:
    if by:
        along = Window.partitionBy(*by).orderBy(order)
        whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before, after = F.lag(value).over(along), F.lead(value).over(along)
        first, last = F.first(value).over(whole), F.last(value).over(whole)
        rows = df.withColumns({"_before": before, "_after": after, "_first": first, "_last": last})
    else:  # one axis of any length: even pieces, with neighbours carried across their borders
        kind = df.schema[order].dataType.typeName()
        at = F.unix_micros(F.col(order).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(order).cast("double")
        rows = scan_in_order(even_buckets(df, at), order, bucket=F.col("_split"), lags={"_before": value}, leads={"_after": value}).drop("_split")
        ends = df.agg(F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"))
        rows = rows.join(F.broadcast(ends), F.lit(True), "inner")  # one row
    before, after = F.col("_before"), F.col("_after")
    return rows, F.coalesce(before, F.col("_last")) if wrap else before, F.coalesce(after, F.col("_first")) if wrap else after


def local_extrema(
    df: DataFrame, order: str = "lon", by: Sequence[str] = CIRCLE, value: str = "value", wrap: bool = True
) -> DataFrame:
    """Strict local maxima and minima along an axis, with ``kind`` 'max' or 'min'.

    A group is one axis, such as a latitude circle or the bins of a density;
    without ``by`` the whole table is one axis, which may be long. A missing
    neighbour (at an end without ``wrap``, or a NULL) is no bound that is exceeded.
    """
    rows, before, after = _circular_neighbours(df, order, by, value, wrap)
    v = F.col(value)
    kind = F.when((v > before) & (v > after), "max").when((v < before) & (v < after), "min")
    return rows.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(*df.columns, "kind")
