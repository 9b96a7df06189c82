"""Joins: date lists, series alignment, as-of, intervals, grids and regridding."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.grouping import GROUP_ROWS, attach, broadcast_if_small, group_stats
from fieldloom.operators.ordered import even_buckets, scan_in_order


def _dates(dates: DataFrame, date: str) -> DataFrame:
    """The distinct days of a date list, at most 366 rows per year of record, so always fit to broadcast."""
    return F.broadcast(dates.select(F.to_date(F.col(date)).alias("_day")).distinct())


def date_semi_join(df: DataFrame, dates: DataFrame, time: str = "time", date: str = "date") -> DataFrame:
    """Rows whose calendar day is in the date list. Row copies are kept, list copies ignored."""
    return df.join(_dates(dates, date), F.to_date(F.col(time)) == F.col("_day"), "left_semi")


def date_anti_join(df: DataFrame, dates: DataFrame, time: str = "time", date: str = "date") -> DataFrame:
    return df.join(_dates(dates, date), F.to_date(F.col(time)) == F.col("_day"), "left_anti")


def align_series(*series: DataFrame, on: str = "time") -> DataFrame:
    """Inner join of series on time, then only complete rows."""
    out = series[0]
    for other in series[1:]:
        out = out.join(other, on, "inner")
    return out.dropna()


def climatology_join(
    df: DataFrame,
    key: Column,
    by: Sequence[str] = (),
    value: str = "value",
    base: Column | None = None,
    subtract: bool = True,
    divide: bool = False,
    out: str | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """Subtract the mean and/or divide by the population deviation of each row's climatology group.

    ``base`` limits the rows that form the statistics; a key absent from the base
    period gives NULL. ``few_groups`` says that ``by`` names few groups, such as
    regions.
    """
    keyed = df.withColumn("_key", key)
    stats = group_stats(
        keyed,
        [*by, "_key"],
        F.avg(F.when(base, F.col(value)) if base is not None else value).alias("_mean"),
        F.stddev_pop(F.when(base, F.col(value)) if base is not None else value).alias("_std"),
    )
    # Calendar keys number at most 366; with no further keys, or few named ones, so do the groups.
    joined = attach(keyed, stats, [*by, "_key"], few_keys=not by or few_groups, reread=True)
    result = F.col(value)
    if subtract:
        result = result - F.col("_mean")
    if divide:
        result = F.when(F.col("_std") != 0, result / F.col("_std"))
    return joined.withColumn(out or value, result).drop("_key", "_mean", "_std").select(
        *[c for c in df.columns if c != (out or value)], out or value
    )


def wind_pair_join(
    u: DataFrame, v: DataFrame, on: Sequence[str] = ("time", "lat", "lon"), value: str = "value"
) -> DataFrame:
    """``u`` and ``v`` fields side by side."""
    return u.withColumnRenamed(value, "u").join(v.withColumnRenamed(value, "v"), list(on), "inner")


def asof_select(
    axis: DataFrame,
    targets: DataFrame,
    method: str = "nearest",
    time: str = "time",
    target: str = "target",
    value: str = "value",
    by: Sequence[str] = (),
) -> DataFrame:
    """Value at the label nearest to, at or before (``pad``), or at or after (``backfill``) each target.

    Labels and targets are merged into one ordered stream, cut at points that hold
    about equally many rows, so a crowded day is many pieces; the last and first
    labels of the pieces are carried across. On equal distance the earlier label
    wins. Labels that occur twice count once, with the lowest value.
    """
    if method not in ("nearest", "pad", "backfill"):
        raise ValueError("method is nearest, pad or backfill")
    by = list(by)
    labels = axis.groupBy(*by, time).agg(F.min(value).alias("_v"))
    labels = labels.select(*by, F.col(time).alias("_at"), F.struct(F.col(time).alias("t"), F.col("_v").alias("v")).alias("_label"))
    wanted = targets.select(*by, F.col(target).alias("_at")).distinct().withColumn("_target", F.lit(True))
    stream = labels.unionByName(wanted, allowMissingColumns=True)
    stream = even_buckets(stream, F.unix_micros(F.col("_at").cast("timestamp")))
    # Labels sort before targets at the same instant for pad and after them for backfill.
    earlier = stream.withColumn("_side", F.col("_target").isNotNull().cast("int"))
    scanned = scan_in_order(earlier, ["_at", "_side"], by=by, bucket=F.col("_split"), carried={"_pad": "_label"}, carried_back={"_next": "_label"})
    hits = scanned.where("_target")
    exact = F.col("_pad.t") == F.col("_at")
    back = F.when(exact, F.col("_pad")).otherwise(F.col("_next"))
    gap_before = F.unix_micros(F.col("_at").cast("timestamp")) - F.unix_micros(F.col("_pad.t").cast("timestamp"))
    gap_after = F.unix_micros(back.getField("t").cast("timestamp")) - F.unix_micros(F.col("_at").cast("timestamp"))
    nearest = F.when(back.isNull() | (gap_before <= gap_after), F.coalesce("_pad", back)).otherwise(back)
    pick = {"pad": F.col("_pad"), "backfill": back, "nearest": nearest}[method]
    return hits.withColumn("_pick", pick).select(
        *by, F.col("_at").alias(target), F.col("_pick.t").alias("label"), F.col("_pick.v").alias(value)
    )


#: Places of the sketch that ranks times, bins that an interval of mean length spans, and the least width of a bin in places.
RANKS, BINS, NARROWEST = 1000, 3, 1e-6
#: Tasks of an interval join for each shuffle partition: pairs are many times what a task reads, so its size on disk is no measure.
TASKS_PER_PARTITION = 4


def interval_join(
    df: DataFrame,
    intervals: DataFrame,
    time: str = "time",
    start: str = "start_ts",
    end: str = "end_ts",
    made: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Rows within ``start..end`` of each interval, at full time precision.

    Bins hold about equally many rows, a third of what a mean interval spans. A row is
    listed in one bin and an interval in those it touches, so whatever the lengths the
    lists have one row a row and about four an interval, and a third more pairs are met
    than lie within the intervals. The lists are sorted and merged: they are longer than
    their inputs, so a size guessed from these could have them broadcast. ``made`` maps
    names to columns that are made of a row after it has moved and before it is paired.

    Two small jobs run while the plan is made, for a sketch of the times and the mean length
    of an interval: both lists must be cut by the same numbers, and a sketch or a mean made
    twice can differ.
    """
    rows, pieces = _binned(df, intervals, time, start, end)
    tasks = TASKS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.drop("_width").repartition(tasks, "_bin").withColumns(dict(made or {}))
    pairs = rows.join(pieces.drop("_width").repartition(tasks, "_bin").hint("merge"), "_bin", "inner")
    after = F.col("_from").isNull() | (F.col(time) >= F.col("_from"))
    before = F.col("_to").isNull() | (F.col(time) <= F.col("_to"))
    return pairs.where(after & before).drop("_bin", "_from", "_to")


def _binned(df: DataFrame, intervals: DataFrame, time: str, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Rows and intervals with the keys ``_width`` (one for all) and ``_bin``; what lies within an interval shares exactly one key with it.

    Bins are cut by rank. A crowded instant has a span of ranks: its rows are dealt over
    the bins of this span by a hash of the row, and an interval that holds the instant is
    listed in all of them. ``_from`` and ``_to`` are the ends of an interval in the bins
    that these lie in; elsewhere they are NULL, as all rows of the bin are within it.
    """
    knots = F.broadcast(_knots(df, time))  # one row
    spans = intervals.where(F.col(end) >= F.col(start)).join(knots, F.lit(True), "inner")
    spans = _ranked(_ranked(spans, start, "_first", "_past"), end, "_before", "_last").drop("_past", "_before", *KNOTS)
    width = max((spans.agg(F.avg(F.col("_last") - F.col("_first"))).first()[0] or 0.0) / BINS, NARROWEST)
    widths = F.broadcast(df.sparkSession.createDataFrame([(width,)], "_width double"))  # one row

    def bin_of(rank: str) -> Column:
        return F.floor(F.col(rank) / F.col("_width"))

    pieces = spans.join(widths, F.lit(True), "inner").withColumn("_bin", F.explode(F.sequence(bin_of("_first"), bin_of("_last"))))
    pieces = pieces.withColumn("_from", F.when(F.col("_bin") == bin_of("_first"), F.col(start)))
    pieces = pieces.withColumn("_to", F.when(F.col("_bin") == bin_of("_last"), F.col(end)))
    # Maps have no hash: rows of one instant that differ in nothing else stay together.
    mixed = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])
    rows = _ranked(df.where(F.col(time).isNotNull()).join(knots, F.lit(True), "inner"), time, "_first", "_last").drop(*KNOTS)
    rows = rows.join(widths, F.lit(True), "inner")
    rows = rows.withColumn("_bin", bin_of("_first") + F.pmod(mixed, bin_of("_last") - bin_of("_first") + 1))
    return rows.drop("_first", "_last"), pieces.drop("_first", "_last")


KNOTS = ("_ats", "_lows", "_highs")


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _knots(df: DataFrame, time: str) -> DataFrame:
    """One row: the times at the places of a mergeable sketch, each once, in order, with the first and last place it holds."""
    shares = F.expr(f"array({', '.join(f'{i / RANKS}D' for i in range(RANKS + 1))})")
    places = df.agg(F.percentile_approx(_micros(time), shares, 10 * RANKS)).first()[0] or []
    ats = sorted(set(places))
    row = ats, [bisect_left(places, t) for t in ats], [bisect_right(places, t) - 1 for t in ats]
    return df.sparkSession.createDataFrame([row], ", ".join(f"{c} array<bigint>" for c in KNOTS))


def _ranked(df: DataFrame, time: str, low: str, high: str) -> DataFrame:
    """``df``, which has the knots, with the first and last rank of a time: neither falls as time grows, and they differ at crowded instants only."""
    at, steps = _micros(time), [1 << i for i in reversed(range((RANKS + 1).bit_length()))]
    out = df.withColumn("_n", F.lit(0))
    for few in (steps[:5], steps[5:]):  # binary search: how many knots lie at or before the time
        n = F.col("_n")
        for step in few:
            n = n + F.when(F.get("_ats", n + (step - 1)) <= at, step).otherwise(0)
        out = out.withColumn("_n", n)
    knot, first, last = (F.get(c, F.col("_n") - 1) for c in KNOTS)
    share = (at - knot) / (F.get("_ats", F.col("_n")) - knot)
    between = F.coalesce(last + share * (F.get("_lows", F.col("_n")) - last), last, F.lit(0))  # after the last knot its rank, before the first 0
    ranks = {low: F.when(at == knot, first).otherwise(between), high: F.when(at == knot, last).otherwise(between)}
    return out.withColumns({c: rank.cast("double") for c, rank in ranks.items()}).drop("_n")


def event_number_join(df: DataFrame, events: DataFrame, time: str = "time", event: str = "event_number") -> DataFrame:
    """Event number of each row's day, NULL outside events."""
    days = events.groupBy(F.to_date(F.col(time)).alias("_day")).agg(F.min(event).alias(event))
    at_day = F.to_date(F.col(time)) == F.col("_day")
    return df.join(F.broadcast(days), at_day, "left").drop("_day")  # one row per calendar day


def broadcast_dims(df: DataFrame, lower: DataFrame, on: Sequence[str]) -> DataFrame:
    """Repeat a lower-dimensional array along the dimensions it lacks.

    The array has one row per key; a key that comes twice fails the job. How many
    rows of ``df`` meet a key is counted, so that crowded keys do not move.
    """
    on = list(on)
    names = [c for c in lower.columns if c not in on]
    rows = lower.groupBy(*on).agg(*[F.min(c).alias(c) for c in names], F.count(F.lit(1)).alias("_copies"))
    once = F.when(F.assert_true(F.col("_copies") == 1, F.lit("a key of the lower array comes twice")).isNull(), True)
    meeting = df.groupBy(*on).agg(F.count(F.lit(1)).alias(GROUP_ROWS))
    sized = rows.where(once).drop("_copies").join(meeting, on, "inner")
    return attach(df, sized, on, how="inner", reread=True)


def grid_pairs(lat_axis: DataFrame, lon_axis: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """All latitude-longitude pairs, numbered in latitude-major order.

    The axes are the coordinate vectors of one grid. The longitude axis is
    folded into one array row, so pairing is a local expansion and no join of
    everything with everything.
    """
    lons = lon_axis.select(lon).distinct().agg(F.array_sort(F.collect_list(lon)).alias("_lons"))
    lats = scan_in_order(lat_axis.select(lat).distinct(), lat, bucket=F.floor(F.col(lat)), ordinal="_lat_idx")
    paired = lats.join(F.broadcast(lons), F.lit(True), "inner")  # one row
    cells = paired.select(lat, "_lat_idx", F.size("_lons").alias("_nlon"), F.posexplode("_lons").alias("_lon_idx", lon))
    return cells.select((F.col("_lat_idx") * F.col("_nlon") + F.col("_lon_idx")).alias("cell"), lat, lon)


def _neighbours(coord: Column, start: float, step: float, count: int, cyclic: bool) -> Column:
    """The two axis labels around a coordinate with their linear weights.

    Off a non-cyclic axis the outermost interval is extended.
    """
    at = (coord - F.lit(start)) / F.lit(step)
    if cyclic:
        at = F.pmod(at, F.lit(float(count)))
        low = F.floor(at)
        first, second = low % count, (low + 1) % count
    else:
        low = F.greatest(F.lit(0), F.least(F.floor(at), F.lit(count - 2)))
        first, second = low, low + 1
    w = at - low

    def entry(index, weight):
        return F.struct(index.cast("int").alias("i"), weight.alias("w"))

    return F.array(entry(first, F.lit(1.0) - w), entry(second, w))


def bilinear_weights(
    targets: DataFrame,
    lat_axis: tuple[float, float, int],
    lon_axis: tuple[float, float, int],
    at_lat: Column | None = None,
    at_lon: Column | None = None,
    cyclic: bool = True,
) -> DataFrame:
    """``(src_lat, src_lon, lat, lon, weight)`` for linear interpolation to target cells.

    An axis is ``(start, step, count)``. ``at_lat``/``at_lon`` give the place of a
    target cell on the source grid where it differs from its own label.
    """
    at_lat = F.col("lat") if at_lat is None else at_lat
    at_lon = F.col("lon") if at_lon is None else at_lon
    lat0, dlat, nlat = lat_axis
    lon0, dlon, nlon = lon_axis
    return (
        targets.withColumn("_a", F.explode(_neighbours(at_lat, lat0, dlat, nlat, False)))
        .withColumn("_b", F.explode(_neighbours(at_lon, lon0, dlon, nlon, cyclic)))
        .select(
            F.col("_a.i").alias("src_lat_idx"),
            F.col("_b.i").alias("src_lon_idx"),
            "lat",
            "lon",
            (F.col("_a.w") * F.col("_b.w")).alias("weight"),
        )
        .where("weight != 0")
        .groupBy("src_lat_idx", "src_lon_idx", "lat", "lon")
        .agg(F.sum("weight").alias("weight"))
    )


def conservative_weights(
    targets: DataFrame,
    lat_axis: tuple[float, float, int],
    lon_axis: tuple[float, float, int],
    target_dlat: float,
    target_dlon: float,
    order: int = 1,
) -> DataFrame:
    """Conservative weights: the share of a target cell's area under each source cell.

    With ``order`` 2 a source cell is not flat but sloped, by the central
    differences of its neighbours in sine of latitude (one-sided at the ends of
    the axis) and longitude (around the circle). The slope acts at the middle of
    each overlap, so that it adds nothing to the integral over a whole source cell:
    integrals are kept, and a field linear in sine of latitude is reproduced. As a
    slope is a difference of cells it only gives these cells more weight, and the
    result is a table of weights like any other.
    """
    if order not in (1, 2):
        raise ValueError("order is 1 or 2")
    lat0, dlat, nlat = lat_axis
    lon0, dlon, nlon = lon_axis

    def edges(coord, half):
        return coord - half, coord + half

    south, north = edges(F.col("lat"), target_dlat / 2)
    south, north = F.greatest(south, F.lit(-90.0)), F.least(north, F.lit(90.0))
    west, east = edges(F.col("lon"), target_dlon / 2)
    first_lat = F.greatest(F.lit(0), F.floor((south - (lat0 - dlat / 2)) / dlat))
    last_lat = F.least(F.lit(nlat - 1), F.ceil((north - (lat0 - dlat / 2)) / dlat) - 1)
    first_lon = F.floor((west - (lon0 - dlon / 2)) / dlon)
    last_lon = F.ceil((east - (lon0 - dlon / 2)) / dlon) - 1
    src_south = F.greatest(F.lit(lat0 - dlat / 2) + F.col("_i") * dlat, F.lit(-90.0))
    src_north = F.least(F.lit(lat0 + dlat / 2) + F.col("_i") * dlat, F.lit(90.0))
    src_west = F.lit(lon0 - dlon / 2) + F.col("_j") * dlon
    height = F.sin(F.radians(F.least(north, src_north))) - F.sin(F.radians(F.greatest(south, src_south)))
    width = F.least(east, src_west + dlon) - F.greatest(west, src_west)
    area = (F.sin(F.radians(north)) - F.sin(F.radians(south))) * (east - west)
    overlaps = (
        targets.where(first_lat <= last_lat)
        .withColumn("_i", F.explode(F.sequence(first_lat.cast("int"), last_lat.cast("int"))))
        .withColumn("_j", F.explode(F.sequence(first_lon.cast("int"), last_lon.cast("int"))))
        .withColumn("_w", height * width / area)
        .where("_w > 0")
    )
    if order == 2:
        overlaps = _with_slopes(overlaps, lat_axis, lon_axis, F.greatest(south, src_south), F.least(north, src_north), F.greatest(west, src_west), F.least(east, src_west + dlon))
    return (
        overlaps.select(F.col("_i").alias("src_lat_idx"), F.pmod(F.col("_j"), F.lit(nlon)).alias("src_lon_idx"), "lat", "lon", "_w")
        .groupBy("src_lat_idx", "src_lon_idx", "lat", "lon")
        .agg(F.sum("_w").alias("weight"))
    )


def _with_slopes(
    overlaps: DataFrame, lat_axis: tuple[float, float, int], lon_axis: tuple[float, float, int], south: Column, north: Column, west: Column, east: Column
) -> DataFrame:
    """Each overlap of a target with a source cell ``_i, _j`` also as weights of the neighbours whose difference is the slope of the source cell."""
    lat0, dlat, nlat = lat_axis
    lon0, dlon, _ = lon_axis

    def sine(lat: Column) -> Column:
        return F.sin(F.radians(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), lat))))

    def centre(i: Column) -> Column:
        """Mean sine of latitude over a source cell."""
        return (sine(F.lit(lat0 - dlat / 2) + i * dlat) + sine(F.lit(lat0 + dlat / 2) + i * dlat)) / 2

    i, j, w = F.col("_i"), F.col("_j"), F.col("_w")
    above, below = F.least(i + 1, F.lit(nlat - 1)), F.greatest(i - 1, F.lit(0))
    run = centre(above) - centre(below)
    north_share = F.when(run > 0, ((sine(south) + sine(north)) / 2 - centre(i)) / run).otherwise(0.0)
    east_share = ((west + east) / 2 - (F.lit(lon0) + j * dlon)) / F.lit(2.0 * dlon)

    def entry(lat_idx: Column, lon_idx: Column, weight: Column) -> Column:
        return F.struct(lat_idx.cast("int").alias("i"), lon_idx.cast("int").alias("j"), weight.alias("w"))

    entries = [
        entry(i, j, w),
        entry(above, j, w * north_share),
        entry(below, j, -w * north_share),
        entry(i, j + 1, w * east_share),
        entry(i, j - 1, -w * east_share),
    ]
    spread = overlaps.withColumn("_e", F.explode(F.array(*entries)))
    return spread.select("lat", "lon", F.col("_e.i").alias("_i"), F.col("_e.j").alias("_j"), F.col("_e.w").alias("_w"))


def sparse_weight_regrid(
    df: DataFrame,
    weights: DataFrame,
    lat_axis: tuple[float, float, int],
    lon_axis: tuple[float, float, int],
    others: Sequence[str] = ("time",),
    value: str = "value",
) -> DataFrame:
    """Weighted sum of source cells for every target cell.

    A target whose source cells are not all present is NULL. The weights have one
    grid's size and are broadcast if they count few enough, so the field itself is
    not shuffled by cell.
    """
    lat0, dlat, _ = lat_axis
    lon0, dlon, nlon = lon_axis
    indexed = df.withColumn("src_lat_idx", F.round((F.col("lat") - lat0) / dlat).cast("int")).withColumn(
        "src_lon_idx", F.pmod(F.round((F.col("lon") - lon0) / dlon).cast("int"), F.lit(nlon))
    )
    parts = indexed.select(*others, "src_lat_idx", "src_lon_idx", F.col(value).alias("_v")).join(
        broadcast_if_small(weights), ["src_lat_idx", "src_lon_idx"], "inner"
    )
    summed = parts.groupBy(*others, "lat", "lon").agg(
        F.sum(F.col("weight") * F.col("_v")).alias(value),
        F.sum(F.when(F.col("_v").isNotNull(), F.col("weight"))).alias("_w"),
    )
    full = F.abs(F.col("_w") - 1.0) < 1e-9
    return summed.select(*others, "lat", "lon", F.when(full, F.col(value)).alias(value))
