"""Sinks: partitioned fields, date lists, event tables and the lineage table.

A sink that is given a ``Lineage`` also notes what its output was made from. The
notes of all outputs are a graph, and ``ancestors`` closes it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lineage:
    """Where the lineage table lies, the name of an output, and its inputs with how each was used."""

    table: str
    output: str
    inputs: Mapping[str, str]

    def note(self, spark: SparkSession) -> None:
        append_lineage(spark, self.table, self.output, self.inputs)


def sink_field(df: DataFrame, path: str, time: str = "time", lineage: Lineage | None = None) -> None:
    """Write a field as Parquet by year, replacing only the years it holds.

    The rebalance hint lets Spark size the files and split a year that holds most
    of the rows.
    """
    by_year = df.withColumn("year", F.year(time)).hint("rebalance", "year")
    by_year.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
    if lineage:
        lineage.note(df.sparkSession)


def sink_table(df: DataFrame, path: str, lineage: Lineage | None = None) -> None:
    """A series or any other result as Parquet."""
    df.write.mode("overwrite").parquet(path)
    if lineage:
        lineage.note(df.sparkSession)


def sink_date_list(dates: DataFrame, path: str, date: str = "date", lineage: Lineage | None = None) -> None:
    """One date per line, in order over the part files."""
    dates.select(F.col(date).cast("string").alias("value")).orderBy("value").write.mode("overwrite").text(path)
    if lineage:
        lineage.note(dates.sparkSession)


def sink_event_stats(events: DataFrame, path: str, lineage: Lineage | None = None) -> None:
    events.write.mode("overwrite").option("header", True).csv(path)
    if lineage:
        lineage.note(events.sparkSession)


def lineage_rows(spark: SparkSession, output: str, inputs: Mapping[str, str]) -> DataFrame:
    """``(output, input, history, written_at)``, one row per input of an output."""
    rows = [(output, name, history) for name, history in inputs.items()]
    table = spark.createDataFrame(rows, "output string, input string, history string")
    return table.withColumn("written_at", F.current_timestamp())


def append_lineage(spark: SparkSession, path: str, output: str, inputs: Mapping[str, str]) -> None:
    lineage_rows(spark, output, inputs).write.mode("append").parquet(path)


def ancestors(lineage: DataFrame) -> DataFrame:
    """``(output, ancestor, steps, history)`` for everything an output was made from, at any distance.

    ``steps`` is the shortest way, ``history`` how the ancestor was used where it
    entered. Outputs noted again count once; an output that is its own ancestor
    fails the job.
    """
    edges = lineage.groupBy("output", "input").agg(F.max_by("history", "written_at").alias("history"))
    closed = lineage.sparkSession.sql(
        """WITH RECURSIVE up(output, ancestor, steps, history) AS (
             SELECT output, input, 1, history FROM {edges}
             UNION ALL SELECT up.output, e.input, steps + 1, e.history FROM up JOIN {edges} e ON up.ancestor = e.output)
           SELECT output, ancestor, min(steps) AS steps, min_by(history, steps) AS history FROM up GROUP BY output, ancestor""",
        edges=edges,
    )
    return closed
