"""Distribution of wave phases: histograms, cyclic densities and their extrema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.scalars import season_of


def _season_rows(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn("season", season_of(time))


def _annual_too(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    both = counts.withColumn("season", F.explode(F.array(F.lit("annual"), F.col("season"))))
    return both.groupBy(*keys).agg(F.sum("n").alias("n"))


def split_by_epoch(time: str = "time", first: int = 1991, last: int = 2002) -> Column:
    year = F.year(time)
    return F.when(year < first, "early").when(year > last, "late").otherwise("middle")


def split_by_gradient(gradient: str = "event_gradient", limit: float = 0.2) -> Column:
    g = F.col(gradient)
    return F.when(g < -limit, "backwards").when(g > limit, "forward").otherwise("stationary")


def phase_histogram(
    df: DataFrame, res: float = 0.75, freq: int = 6, phase: str | None = None, time: str = "time", split: Column | None = None
) -> DataFrame:
    """Counts in bins centred on 0, res, 2 res, ... for the year and each season, empty bins included.

    ``(season, [split,] bin, n)``; ``split`` divides the days into groups.
    """
    phase = phase or f"wave{freq}_phase"
    nbins = round(360.0 / freq / res)
    extra = [] if split is None else ["split"]
    rows = _season_rows(df, time)
    if split is not None:
        rows = rows.withColumn("split", split)
    index = F.pmod(F.floor((F.col(phase) + res / 2) / res), F.lit(nbins)).cast("long")
    counted = rows.where(F.col(phase).isNotNull()).groupBy("season", *extra, index.alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    # One zero per bin of every group that occurs completes the axis before the sums.
    groups = counted.select("season", *extra).distinct()
    zeros = groups.select("season", *extra, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nbins - 1).cast("long"))).alias("_b"))
    filled = counted.unionByName(zeros.withColumn("n", F.lit(0).cast("long")))
    totals = _annual_too(filled, ["season", *extra, "_b"])
    return totals.select("season", *extra, (F.col("_b") * res).alias("bin"), "n")


def cyclic_kde(
    df: DataFrame,
    bandwidth: float | None = None,
    res: float = 0.75,
    freq: int = 6,
    phase: str | None = None,
    time: str = "time",
    split: Column | None = None,
    span: float | None = None,
) -> DataFrame:
    """Cyclic Gaussian density on the bin centres, scaled to counts per bin.

    ``(season, [split,] bin, density)``. The circle is ``span`` long (by default
    first to last centre); each point acts through itself and one image on either
    side. Without a bandwidth each group takes its sample deviation times
    ``n ** -0.2``. Equal phases are counted first, so the work is distinct phases
    times bins.
    """
    phase = phase or f"wave{freq}_phase"
    nbins = round(360.0 / freq / res)
    span = 360.0 / freq - res if span is None else span
    extra = [] if split is None else ["split"]
    rows = _season_rows(df, time)
    if split is not None:
        rows = rows.withColumn("split", split)
    counts = (
        rows.where(F.col(phase).isNotNull())
        .groupBy("season", *extra, F.col(phase).alias("_x"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    keys = ["season", *extra]
    points = _annual_too(counts, [*keys, "_x"])
    n, x = F.col("n"), F.col("_x")
    if bandwidth is None:
        total, s1, s2 = F.sum(n), F.sum(n * x), F.sum(n * x * x)
        deviation = F.sqrt((s2 - s1 * s1 / total) / (total - 1))
        widths = points.groupBy(*keys).agg((deviation * F.pow(total, F.lit(-0.2))).alias("_h"))
        points = points.join(widths, keys, "inner")
    else:
        points = points.withColumn("_h", F.lit(float(bandwidth)))
    spread = points.withColumn("bin", F.explode(F.transform(F.sequence(F.lit(0), F.lit(nbins - 1)), lambda i: i * F.lit(res))))
    kernel = F.lit(0.0)
    for image in (-1, 0, 1):
        d = (F.col("bin") - x + image * span) / F.col("_h")
        kernel = kernel + F.exp(-0.5 * d * d)
    height = n * kernel * res / (F.col("_h") * F.sqrt(F.lit(2.0) * F.pi()))
    return spread.groupBy(*keys, "bin").agg(F.sum(height).alias("density"))


def kde_extrema(density: DataFrame, width: int = 10, keys: Sequence[str] = ("season",)) -> DataFrame:
    """Strict interior extrema of each density and the ``width`` bins around each that stay highest or lowest.

    ``(keys..., kind, bin, left, right)``. The range grows one bin at a time to
    the better side (right on equality), around a circle of one bin less than the
    axis because the first and the last centre are the same place. A group is one
    axis of bins, kept as an array.
    """
    axis = density.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "density"))).alias("_axis"))
    bins, heights = F.transform("_axis", lambda p: p["bin"]), F.transform("_axis", lambda p: p["density"])
    axis = axis.select(*keys, bins.alias("_bins"), heights.alias("_d"), (F.size("_axis") - 1).alias("_circle"))
    inner = axis.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_circle") - 1)))

    def at(array: str, index: Column) -> Column:
        return F.element_at(F.col(array), (index + 1).cast("int"))

    here, before, after = at("_d", F.col("_i")), at("_d", F.col("_i") - 1), at("_d", F.col("_i") + 1)
    kind = F.when((here > before) & (here > after), "max").when((here < before) & (here < after), "min")
    peaks = inner.withColumn("kind", kind).where(F.col("kind").isNotNull())

    def grow(state: Column, _: Column) -> Column:
        circle = F.col("_circle")
        right = F.when(state["r"] + 1 >= circle, state["r"] + 1 - circle).otherwise(state["r"] + 1)
        left = F.when(state["l"] - 1 < 0, state["l"] - 1 + circle).otherwise(state["l"] - 1)
        gain = at("_d", right) - at("_d", left)
        go_right = F.when(F.col("kind") == "max", gain >= 0).otherwise(gain <= 0)
        return F.struct(
            F.when(go_right, state["l"]).otherwise(left).cast("int").alias("l"),
            F.when(go_right, right).otherwise(state["r"]).cast("int").alias("r"),
        )

    start = F.struct(F.col("_i").cast("int").alias("l"), F.col("_i").cast("int").alias("r"))
    grown = peaks.withColumn("_range", F.aggregate(F.sequence(F.lit(1), F.lit(width)), start, grow))
    return grown.select(
        *keys,
        "kind",
        at("_bins", F.col("_i")).alias("bin"),
        at("_bins", F.col("_range.l")).alias("left"),
        at("_bins", F.col("_range.r")).alias("right"),
    )
