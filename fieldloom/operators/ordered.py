"""Ordered computations over long series without a one-task window.

Each row falls in a coarse time bucket (a month unless told otherwise). Windows
run inside buckets, a small table with one row per bucket carries counts, sums
and edge values across buckets, and a join puts the two together. The results
equal those of one global window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"


def month_bucket(time: str = "time") -> Column:
    return F.date_trunc("MONTH", F.col(time))


#: Split points for each shuffle partition: tasks that get several even buckets by hash are nearly even.
SPLITS_PER_PARTITION = 32


def even_buckets(df: DataFrame, at: Column, out: str = "_split") -> DataFrame:
    """``df`` with a bucket number that grows with ``at`` (a number) and holds about equally many rows, wherever the rows crowd.

    The split points come from a mergeable sketch; rows of one instant share a bucket.
    """
    n = SPLITS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = df.agg(F.coalesce(F.percentile_approx(at, [i / n for i in range(1, n)], 10 * n), F.array()).alias("_points"))
    levels = (n - 1).bit_length()
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(levels))])
    # binary search: how many of the points lie at or before the row
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get("_points", low + step - 1) <= at, low + step).otherwise(low))
    return df.join(F.broadcast(points), F.lit(True), "inner").withColumn(out, found).drop("_points")  # one row


def scan_in_order(
    df: DataFrame,
    order: Sequence[str] | str,
    by: Sequence[str] = (),
    bucket: Column | None = None,
    ordinal: str | None = None,
    lags: Mapping[str, str] | None = None,
    leads: Mapping[str, str] | None = None,
    totals: Mapping[str, str] | None = None,
    carried: Mapping[str, str] | None = None,
    carried_back: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add order-dependent columns.

    ``ordinal`` names a 0-based position; ``lags``/``leads`` map an output to the
    column whose previous/next row is wanted; ``totals`` map to running sums
    including the row itself; ``carried``/``carried_back`` map to the latest
    (earliest) non-NULL value at or before (after) the row.
    ``bucket`` must never decrease along ``order``; the ``by`` columns must not
    be NULL.
    """
    order = [order] if isinstance(order, str) else list(order)
    by = list(by)
    lags, leads, totals = dict(lags or {}), dict(leads or {}), dict(totals or {})
    carried, carried_back = dict(carried or {}), dict(carried_back or {})
    rows = df.withColumn(BUCKET, month_bucket(order[0]) if bucket is None else bucket)
    key = F.struct(*order)
    inside = Window.partitionBy(*by, BUCKET).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    from_here = inside.rowsBetween(0, Window.unboundedFollowing)

    lag_cols, lead_cols = sorted(set(lags.values())), sorted(set(leads.values()))
    edges = rows.groupBy(*by, BUCKET).agg(
        F.count(F.lit(1)).alias("_n"),
        *([F.max_by(F.struct(*lag_cols), key).alias("_last")] if lags else []),
        *([F.min_by(F.struct(*lead_cols), key).alias("_first")] if leads else []),
        *[F.sum(c).alias(f"_sum_{o}") for o, c in totals.items()],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"_car_{o}") for o, c in carried.items()],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"_bak_{o}") for o, c in carried_back.items()],
    )
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy(BUCKET)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = across.rowsBetween(1, Window.unboundedFollowing)
    edges = edges.select(
        *by,
        BUCKET,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"),
        *([F.lag("_last").over(across).alias("_last_before")] if lags else []),
        *([F.lead("_first").over(across).alias("_first_after")] if leads else []),
        *[F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).alias(f"_tot_{o}") for o in totals],
        *[F.last(f"_car_{o}", ignorenulls=True).over(before).alias(f"_prev_{o}") for o in carried],
        *[F.first(f"_bak_{o}", ignorenulls=True).over(after).alias(f"_next_{o}") for o in carried_back],
    )

    local = rows
    position = F.row_number().over(inside)
    if ordinal or lags:
        local = local.withColumn("_pos", position)
    if leads:
        local = local.withColumn("_rev", F.lead(F.lit(1)).over(inside))
    for o, c in lags.items():
        local = local.withColumn(f"_lag_{o}", F.lag(c).over(inside))
    for o, c in leads.items():
        local = local.withColumn(f"_lead_{o}", F.lead(c).over(inside))
    for o, c in totals.items():
        local = local.withColumn(f"_run_{o}", F.sum(c).over(so_far))
    for o, c in carried.items():
        local = local.withColumn(f"_own_{o}", F.last(c, ignorenulls=True).over(so_far))
    for o, c in carried_back.items():
        local = local.withColumn(f"_ahead_{o}", F.first(c, ignorenulls=True).over(from_here))

    joined = local.join(edges, [*by, BUCKET], "inner")
    out = [F.col(c) for c in df.columns]
    if ordinal:
        out.append((F.col("_n_before") + F.col("_pos") - 1).cast("long").alias(ordinal))
    for o, c in lags.items():
        edge = F.col("_last_before").getField(c)
        out.append(F.when(F.col("_pos") == 1, edge).otherwise(F.col(f"_lag_{o}")).alias(o))
    for o, c in leads.items():
        edge = F.col("_first_after").getField(c)
        out.append(F.when(F.col("_rev").isNull(), edge).otherwise(F.col(f"_lead_{o}")).alias(o))
    for o in totals:
        out.append((F.coalesce(F.col(f"_run_{o}"), F.lit(0)) + F.col(f"_tot_{o}")).alias(o))
    for o in carried:
        out.append(F.coalesce(f"_own_{o}", f"_prev_{o}").alias(o))
    for o in carried_back:
        out.append(F.coalesce(f"_ahead_{o}", f"_next_{o}").alias(o))
    return joined.select(*out)
