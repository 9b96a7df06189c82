"""Joining group statistics back to rows without overloading one task.

A window over ``(key)`` would buffer a whole group in one task. Here the
statistic is an ordinary aggregation (combined before the shuffle) that is then
joined to the rows. The largest groups, a fixed number of them, have their
statistics broadcast; all others, each a small part of the table, meet theirs in
a shuffled join. Where the rows can be read again cheaply, the rows of the
largest groups get a branch of their own and stay where they are; where the rows
are the result of other work, which a second branch would repeat, they take part
in the shuffle, dealt evenly over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP_ROWS = "_group_rows"
STATS = "_stats"
SALT = "_salt"

# Tables over a grid or an axis are broadcast up to this many rows.
BROADCAST_ROWS = 2_000_000

# So many of the largest groups are met by broadcast; any other group has at most this share of the rows.
HOT_GROUPS = 1_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a table that counts at most ``most`` rows; otherwise the join is left to shuffle.

    Meant for tables that are cheap to make and as large as one grid.
    """
    return F.broadcast(df) if df.count() <= most else df


def group_stats(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregate by ``keys`` and keep the row count that ``attach`` needs."""
    return df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias(GROUP_ROWS))


def _known(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def parted(df: DataFrame, held: DataFrame, keys: Sequence[str], how: str, hot_groups: int) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, already with their statistics in ``_stats``, and rows that are to be shuffled, without.

    Rows with a NULL key belong to no group and stay as well.
    """
    keys = list(keys)
    known, found = _known(keys), F.col(STATS).isNotNull()
    largest = held.orderBy(F.desc(F.col(STATS)[0][GROUP_ROWS])).limit(hot_groups)
    met = df.join(F.broadcast(largest), keys, "left")  # at most hot_groups rows
    return met.where(found | ~known if how == "left" else found), met.where(~found & known).drop(STATS)


def attach(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    hot_groups: int = HOT_GROUPS,
    few_keys: bool = False,
    reread: bool = False,
) -> DataFrame:
    """Join ``stats`` (one row per key, with ``GROUP_ROWS``) to ``df``, ``how`` left or inner.

    ``few_keys`` says that the keys have a small fixed range, such as days of the
    year, so all statistics are broadcast and no row moves. ``reread`` says that
    ``df`` is cheap to read twice, such as a scan.
    """
    keys = list(keys)
    if few_keys:
        return df.join(F.broadcast(stats.drop(GROUP_ROWS)), keys, how)
    names = [c for c in stats.columns if c not in keys and c != GROUP_ROWS]
    # One value that no branch can prune, so that all of them read the same aggregation.
    held = stats.where(_known(keys)).select(*keys, F.array(F.struct(*names, GROUP_ROWS)).alias(STATS))
    if reread:
        near, far = parted(df, held, keys, how, hot_groups)
        both = near.unionByName(far.join(held, keys, how))
    else:
        both = _salted(df, held, keys, how, hot_groups)
    return both.select(*df.columns, *[F.col(STATS)[0][c].alias(c) for c in names])


def _salted(df: DataFrame, held: DataFrame, keys: Sequence[str], how: str, hot_groups: int) -> DataFrame:
    """One reading of the rows: those of the largest groups and those without a key have a salt beside the key, so no task gets many of them.

    The salt mixes a row's content with its partition, so identical copies spread
    as well and a retried task repeats the same salts.
    """
    salts = 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    largest = held.orderBy(F.desc(F.col(STATS)[0][GROUP_ROWS])).limit(hot_groups).withColumnRenamed(STATS, "_hot")
    content = F.xxhash64(*[F.col(c) for c in df.columns if c not in keys] or [F.lit(0)])
    spread = (F.pmod(content + F.spark_partition_id(), F.lit(salts)) + 1).cast("int")
    rows = df.join(F.broadcast(largest), keys, "left")  # at most hot_groups rows
    rows = rows.withColumn(SALT, F.when(F.col("_hot").isNotNull() | ~_known(keys), spread).otherwise(F.lit(0)))
    joined = rows.join(held.withColumn(SALT, F.lit(0)), [*keys, SALT], "left")
    joined = joined.withColumn(STATS, F.coalesce("_hot", STATS))
    return joined.where(F.col(STATS).isNotNull()) if how == "inner" else joined
