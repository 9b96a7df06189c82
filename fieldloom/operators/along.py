"""Applying a one-dimensional function along one dimension of a field."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_along_dim(
    df: DataFrame,
    func: Callable[[np.ndarray], np.ndarray],
    dim: str,
    others: Sequence[str],
    value: str = "value",
) -> DataFrame:
    """Replace each 1-D slice along ``dim`` by ``func(slice)``, an array of the same length.

    A slice has one value per axis label: a repeated label within one slice is an
    error, which keeps every group as small as the axis.
    """
    others = list(others)
    schema = df.select(*others, dim, F.col(value).cast("double").alias(value)).schema

    def apply(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(dim)
        if group[dim].duplicated().any():
            raise ValueError(f"two values at one {dim} in a slice")
        group[value] = np.asarray(func(group[value].to_numpy(dtype=float)), dtype=float)
        return group

    return df.select(*others, dim, value).groupBy(*others).applyInPandas(apply, schema)
