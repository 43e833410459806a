"""Joins against a side that is small by design, with its size checked.

Position tables (one row per hub partition), ledger slices and expected
partition lists are small in practice, but "small in practice" is not a proof.
``join_small`` materialises the small side once into the shared checkpoint
folder (which also cuts its lineage), counts it, and broadcasts it only when it
is within ``max_rows``. Beyond that bound the join is left to the planner as a
shuffle join, where adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlog.session import materialize

# Upper bound for a broadcast side (rows). A position row is ~60 bytes, so the
# largest broadcast table is ~12 MB.
MAX_BROADCAST_ROWS = 200_000


def materialize_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Checkpoint ``df`` and report whether it has at most ``max_rows`` rows."""
    saved = materialize(df)
    fits = saved.limit(max_rows + 1).count() <= max_rows
    return saved, fits


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``big.join(small, on, how)``, broadcasting ``small`` only if it fits."""
    saved, fits = materialize_small(small, max_rows)
    return big.join(F.broadcast(saved) if fits else saved, on, how)
