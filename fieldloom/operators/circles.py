"""Latitude circles as rows: the cells of a circle gathered into one list, and transforms of many circles at once in numpy.

A circle has as many cells as the axis has longitudes, so a list is bounded by the grid. Gathering is the only shuffle; map tasks already send lists. A circle
is complete if every longitude of the axis has exactly one row with a value; incomplete circles give nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = "_cells"

#: Numbers of a transform that are held at once, beside the batch of lists itself.
TOGETHER = 1 << 20


def gather(df: DataFrame, by: Sequence[str | Column], values: Sequence[str], lon: str = "lon") -> DataFrame:
    """``(by..., _cells)``, a row per circle."""
    cell = F.struct(F.col(lon).cast("double").alias("lon"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    return df.groupBy(*by).agg(F.collect_list(cell).alias(CELLS))


def grids(lists: pa.ListArray, n_values: int, n_lon: int, start: float) -> tuple[list[np.ndarray], np.ndarray]:
    """One matrix (circle, longitude) per value, zero where a circle is incomplete, and the marks of complete circles."""
    cells = lists.flatten()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    circle = np.repeat(np.arange(len(sizes)), sizes)
    place = (_numbers(cells.field("lon")) - start) * (n_lon / 360.0)
    with np.errstate(invalid="ignore"):
        at = np.rint(place)
        on = np.abs(place - at) < 1e-6
    at = np.where(on, at, 0).astype(np.int64) % n_lon
    given, known = [], on.copy()
    for i in range(n_values):
        column = cells.field(f"v{i}")
        known &= column.is_valid().to_numpy(zero_copy_only=False)
        given.append(_numbers(column))
    cell = circle * n_lon + at
    once = np.bincount(cell[known], minlength=len(sizes) * n_lon).reshape(len(sizes), n_lon) == 1
    full = once.all(1) & (sizes == n_lon)
    out = []
    for values in given:
        matrix = np.zeros(len(sizes) * n_lon)
        matrix[cell] = values
        matrix = matrix.reshape(len(sizes), n_lon)
        matrix[~full] = 0
        out.append(matrix)
    return out, full


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float, copy=False)


def lists_of(matrix: np.ndarray, full: np.ndarray | None = None) -> pa.ListArray:
    """Rows of a matrix as lists; rows that are not ``full`` hold nulls."""
    rows, width = matrix.shape
    gone = None if full is None or full.all() else np.repeat(~full, width)
    flat = pa.array(np.ascontiguousarray(matrix).ravel(), mask=gone)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), flat)


def transform(
    circles: DataFrame,
    n_values: int,
    n_lon: int,
    start: float,
    names: Sequence[str],
    func: Callable[[list[np.ndarray]], Sequence[np.ndarray]],
) -> DataFrame:
    """``circles`` with ``_cells`` replaced by array columns ``names``: rows of the matrices that ``func`` makes of those of the values."""
    kept = [f for f in circles.schema if f.name != CELLS]
    schema = T.StructType([*kept, *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]])
    step = max(1, TOGETHER // n_lon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                matrices, full = grids(part.column(CELLS), n_values, n_lon, start)
                lists = [lists_of(m, full) for m in func(matrices)]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *lists], schema.names)

    return circles.mapInArrow(run, schema)
