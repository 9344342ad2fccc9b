"""Broadcast only what has a checked size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.session import cut_lineage

# Rows above which a "small" side is left to the planner (sort-merge join, or
# AQE's runtime broadcast when the measured size turns out small).
MAX_BROADCAST_ROWS = 1_000_000


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                      known_rows: int | None = None) -> DataFrame:
    """Hint a broadcast only when the row count is proven to be within bounds.

    ``known_rows`` is a structural bound (e.g. one row for a global aggregate,
    at most 24 rows for a per-hour table).  Without one we materialise the
    frame once (it is meant to be a small fitted state), count it, and only
    broadcast under ``max_rows``; otherwise the join stays a shuffle join.
    """
    if known_rows is not None and known_rows <= max_rows:
        return F.broadcast(df)
    kept = cut_lineage(df)  # small fitted state, in the shared checkpoint folder
    return F.broadcast(kept) if kept.count() <= max_rows else kept
