"""Running means, event detection and event statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.grouping import attach, group_stats
from fieldloom.operators.ordered import BUCKET, month_bucket, scan_in_order
from fieldloom.session import cut_lineage

BLOCK = 4096


def _blocked_mean(positioned: DataFrame, window: int, by: Sequence[str], value: str) -> DataFrame:
    """Centred mean over positions ``_i``, in blocks that share a halo of neighbouring rows."""
    before, after = window // 2, (window - 1) // 2
    size = max(BLOCK, 4 * window)
    block, offset = F.floor(F.col("_i") / size), F.pmod(F.col("_i"), F.lit(size))
    copies = F.array_compact(
        F.array(
            block,
            F.when(offset < after, block - 1),
            F.when(offset >= size - before, block + 1),
        )
    )
    spread = positioned.withColumn("_block", F.explode(copies))
    near = Window.partitionBy(*by, "_block").orderBy("_i").rangeBetween(-before, after)
    means = spread.withColumn("_mean", F.avg(value).over(near)).withColumn("_count", F.count(value).over(near))
    own = F.floor(F.col("_i") / size) == F.col("_block")
    return means.where(own & (F.col("_count") == window)).withColumn(value, F.col("_mean")).drop(
        "_block", "_mean", "_count", "_i"
    )


def _one_a_step(df: DataFrame, step, by: Sequence[str], value: str, time: str) -> DataFrame:
    """The mean and first time of what falls on one calendar step, so that a repeated day does not break the windows around it."""
    stepped = df.withColumn("_i", step.cast("long"))
    return stepped.groupBy(*by, "_i").agg(F.min(time).alias(time), F.avg(value).alias(value))


def running_mean(
    df: DataFrame,
    window: int,
    by: Sequence[str] = ("lat", "lon"),
    value: str = "value",
    time: str = "time",
    axis: str = "rows",
    blocked: bool | None = None,
) -> DataFrame:
    """Centred moving mean; times without a complete window are dropped.

    ``axis='rows'`` counts rows in time order; ``'day'`` and ``'month'`` count
    calendar steps, each with the mean of its rows, so a missing step makes its windows incomplete. One long
    series (no ``by``), calendar axes, and ``blocked=True`` cut the time axis into
    blocks; otherwise each cell, which holds one row per time, is one window group.
    """
    by = list(by)
    before, after = window // 2, (window - 1) // 2
    if axis == "day":
        return _blocked_mean(_one_a_step(df, F.unix_date(F.to_date(time)), by, value, time), window, by, value)
    if axis == "month":
        months = F.year(time) * 12 + F.month(time)
        return _blocked_mean(_one_a_step(df, months, by, value, time), window, by, value)
    if axis != "rows":
        raise ValueError("axis is rows, day or month")
    if blocked or (blocked is None and not by):
        return _blocked_mean(scan_in_order(df, time, by=by, ordinal="_i"), window, by, value)
    near = Window.partitionBy(*by).orderBy(time).rowsBetween(-before, after)
    means = df.withColumn("_mean", F.avg(value).over(near)).withColumn("_count", F.count(value).over(near))
    return means.where(F.col("_count") == window).withColumn(value, F.col("_mean")).drop("_mean", "_count")


def rank_across_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by its ascending rank within the row, ties averaged.

    A rank is one plus the number of smaller columns plus half the number of equal
    ones, so the row never leaves its task.
    """

    def rank(name: str) -> Column:
        total = F.lit(1.0)
        for other in columns:
            if other != name:
                total = total + F.when(F.col(other) < F.col(name), 1.0).when(F.col(other) == F.col(name), 0.5).otherwise(0.0)
        return F.when(F.col(name).isNotNull(), total)

    return df.withColumns({c: rank(c) for c in columns})


def topk_wave_rule(
    df: DataFrame, k_a: int = 5, k_b: int = 6, min_sum: float = 17, ks: Sequence[int] = tuple(range(1, 11))
) -> DataFrame:
    """Rows whose two wave amplitudes have ranks that sum to ``min_sum`` or more; amplitudes become ranks."""
    ranked = rank_across_columns(df, [f"wave{k}_amp" for k in ks])
    return ranked.where(F.col(f"wave{k_a}_amp") + F.col(f"wave{k_b}_amp") >= min_sum)


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def gap_sessionise(
    df: DataFrame,
    gap_days: float = 2.0,
    time: str = "time",
    by: Sequence[str] = (),
    bucket: Column | None = None,
    position: str | None = None,
    previous: Mapping[str, str] | None = None,
) -> DataFrame:
    """Number the events: a gap of ``gap_days`` or more to the previous row starts a new one.

    Adds ``time_delta`` (days), ``in_event`` and ``event_number`` from 0; on
    request the row's ``position`` in the series and ``previous`` values, a map of
    new names to columns. Rows are compared inside time buckets (months); a table
    with one row per bucket links the bucket edges and counts the events so far.
    """
    by, previous = list(by), dict(previous or {})
    limit = F.lit(gap_days * 86_400_000_000.0)
    rows = df.withColumn(BUCKET, month_bucket(time) if bucket is None else bucket)
    inside = Window.partitionBy(*by, BUCKET).orderBy(time)
    kept = sorted({time, *previous.values()})
    local = rows.withColumn("_pos", F.row_number().over(inside)).withColumns(
        {f"_lag_{c}": F.lag(c).over(inside) for c in kept}
    )
    local = local.withColumn("_gap", _micros(F.col(time)) - _micros(F.col(f"_lag_{time}")))
    local = local.withColumn("_begins", F.coalesce((F.col("_gap") >= limit).cast("long"), F.lit(0)))
    edges = local.groupBy(*by, BUCKET).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_begins").alias("_inner"),
        F.min(time).alias("_first"),
        F.max_by(F.struct(*kept), F.col(time)).alias("_last"),
    )
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy(BUCKET)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("_prev", F.lag("_last").over(across))
    edge_gap = _micros(F.col("_first")) - _micros(F.col("_prev").getField(time))
    edges = edges.withColumn("_opens", F.coalesce((edge_gap >= limit).cast("long"), F.lit(1)))
    edges = edges.select(
        *by,
        BUCKET,
        "_prev",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"),
        (F.coalesce(F.sum(F.col("_inner") + F.col("_opens")).over(before), F.lit(0)) + F.col("_opens")).alias("_events"),
    )
    counted = local.withColumn("_so_far", F.sum("_begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    joined = counted.join(edges, [*by, BUCKET], "inner")

    def earlier(c: str) -> Column:
        return F.when(F.col("_pos") == 1, F.col("_prev").getField(c)).otherwise(F.col(f"_lag_{c}"))

    delta = _micros(F.col(time)) - _micros(earlier(time))
    extra = [earlier(c).alias(name) for name, c in previous.items()]
    if position:
        extra.append((F.col("_n_before") + F.col("_pos") - 1).cast("long").alias(position))
    return joined.select(
        *df.columns,
        (delta / 86_400_000_000.0).alias("time_delta"),
        F.coalesce(delta < limit, F.lit(False)).alias("in_event"),
        (F.col("_events") + F.col("_so_far") - 1).cast("long").alias("event_number"),
        *extra,
    )


def phase_unwrap(phase: Column, jump: Column, freq: int = 6) -> Column:
    """Phase of an event whose largest step exceeds five sixths of a wavelength, with the low half raised by one wavelength."""
    period = 360.0 / freq
    return F.when((jump > period * 5 / 6) & (phase < period / 2), phase + period).otherwise(phase)


def with_event_statistics(
    df: DataFrame, freq: int = 6, by: Sequence[str] = (), position: str = "_position", before: str = "_phase_before"
) -> DataFrame:
    """Duration, unwrapped phase, gradient and first/last flags of every event.

    Takes the rows of ``gap_sessionise`` with their position and previous phase.
    One aggregation per event gives the duration, the largest phase step and the
    slopes of both the raw and the raised phase; the step then picks the slope.
    """
    period = 360.0 / freq
    phase = f"wave{freq}_phase"
    keys = [*by, "event_number"]
    step = F.when(F.col("in_event"), F.abs(F.col(phase) - F.col(before)))
    raised = F.when(F.col(phase) < period / 2, F.col(phase) + period).otherwise(F.col(phase))
    stats = group_stats(
        df,
        keys,
        F.count(F.lit(1)).alias("event_duration"),
        F.max(step).alias("_jump"),
        F.min(position).alias("_first"),
        F.regr_slope(phase, position).alias("_slope"),
        F.regr_slope(raised, position).alias("_slope_raised"),
    )
    joined = attach(df, stats, keys)
    wraps = F.col("_jump") > period * 5 / 6
    return joined.select(
        *[c for c in df.columns if c not in (position, before)],
        "event_duration",
        phase_unwrap(F.col(phase), F.col("_jump"), freq).alias("event_phase"),
        F.when(wraps, F.col("_slope_raised")).otherwise(F.col("_slope")).alias("event_gradient"),
        (F.col(position) == F.col("_first")).alias("event_start"),
        (F.col(position) == F.col("_first") + F.col("event_duration") - 1).alias("event_end"),
    )


def event_table(
    fourier: DataFrame,
    freq: int = 6,
    k_a: int = 5,
    k_b: int = 6,
    min_sum: float = 17,
    max_sign_change: int | None = None,
    ks: Sequence[int] = tuple(range(1, 11)),
    time: str = "time",
    by: Sequence[str] = (),
) -> DataFrame:
    """Selected days with their event columns; amplitude columns hold ranks.

    The selection (one row per day) is checkpointed, because numbering and
    statistics each read it more than once and it ends a long pipeline.
    """
    chosen = topk_wave_rule(fourier, k_a, k_b, min_sum, ks)
    if max_sign_change is not None:
        chosen = chosen.where(F.col("sign_count") <= max_sign_change)
    chosen = cut_lineage(chosen)
    numbered = gap_sessionise(
        chosen, time=time, by=by, position="_position", previous={"_phase_before": f"wave{freq}_phase"}
    )
    return with_event_statistics(numbered, freq, by)


def event_dates(
    events: DataFrame,
    freq: int = 6,
    duration: int | None = None,
    season: str | None = None,
    phase: tuple[float, float] | None = None,
    time: str = "time",
) -> DataFrame:
    """Dates of an event table after the optional duration, season and phase filters."""
    from fieldloom.operators.select import duration_filter, phase_filter, season_filter

    if duration is not None:
        events = duration_filter(events, duration)
    if season is not None:
        events = season_filter(events, season, time)
    if phase is not None:
        events = phase_filter(events, *phase, freq=freq)
    return events.select(F.to_date(time).alias("date"))


def duration_histogram(events: DataFrame, event: str = "event_number", by: Sequence[str] = ()) -> DataFrame:
    """Events per duration with the mean duration over all events: ``(by..., event_duration, n_events, mean_duration)``."""
    per_event = events.groupBy(*by, event).agg(F.count(F.lit(1)).alias("event_duration"))
    counts = per_event.groupBy(*by, "event_duration").agg(F.count(F.lit(1)).alias("n_events"))
    mean = counts.groupBy(*by).agg(
        (F.sum(F.col("event_duration") * F.col("n_events")) / F.sum("n_events")).alias("mean_duration")
    )
    return counts.join(mean, list(by), "inner") if by else counts.join(F.broadcast(mean), F.lit(True))  # one row


def gradient_stats(events: DataFrame, min_duration: int = 1, limit: float = 0.25, event: str = "event_number") -> DataFrame:
    """Mean and population deviation of event gradients, and how many events move which way."""
    lasting = events.where(F.col("event_duration") >= min_duration)
    per_event = lasting.groupBy(event).agg(F.max("event_gradient").alias("_g"))
    g = F.col("_g")
    return per_event.agg(
        F.avg(g).alias("gradient_mean"),
        F.stddev_pop(g).alias("gradient_std"),
        F.count_if(g > limit).alias("forward"),
        F.count_if(g < -limit).alias("backward"),
        F.count_if(g.between(-limit, limit)).alias("stationary"),
    )
