"""The registered queries and the SQL each one is checked against."""

from tabletrust.workload import (  # noqa: F401
    copies,
    drifting,
    mappings,
    profiling,
    quality,
    scans,
    shapes,
    streams,
)
from tabletrust.workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
