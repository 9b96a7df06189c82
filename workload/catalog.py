"""Importing this module registers every check query."""

from workload import (  # noqa: F401
    dynamics_queries,
    event_queries,
    index_queries,
    io_queries,
    join_queries,
    select_queries,
    spectral_queries,
    stats_queries,
)
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
