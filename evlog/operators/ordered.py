"""Per-key ordered computations in bounded pieces.

A window partitioned by hub partition and ordered by batch would keep a
partition's whole history in one task. These helpers cut each key's rows into
blocks of ``block`` consecutive batches (``step`` apart): inside a block the
window runs as usual, many blocks in parallel; across blocks only one row per
block moves, carried by a window over block rows (a key's history divided by
the block size). The input rows are repartitioned once by key and block, and
both the per-block summary and the in-block window reuse that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Batches per block.
ORDER_BLOCK = 4096


def _blocked(df: DataFrame, keys: Sequence[str], order: str, step: int, block: int | None) -> DataFrame:
    span = int(step) * int(block or ORDER_BLOCK)
    if span <= 0:
        raise ValueError("step and block must be positive")
    out = df.withColumn("_blk", F.floor(F.col(order) / F.lit(span)).cast("long"))
    return out.repartition(*keys, "_blk")


def with_previous(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], step: int = 1,
                  block: int | None = None, prefix: str = "prev_") -> DataFrame:
    """Add ``<prefix><c>``: the value of ``c`` in the previous row of the same
    key by ``order`` (null for a key's first row); the same as
    ``lag(c) over (partition by keys order by order)``."""
    keys = list(keys)
    d = _blocked(df, keys, order, step, block)
    last = d.groupBy(*keys, "_blk").agg(F.max_by(F.struct(*cols), order).alias("_last"))
    carry = last.select(*keys, "_blk", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_blk")).alias("_carry"))
    inner = Window.partitionBy(*keys, "_blk").orderBy(order)
    lagged = d.select("*", F.row_number().over(inner).alias("_rn"),
                      *[F.lag(c).over(inner).alias(f"_lag_{c}") for c in cols])
    joined = lagged.join(carry, [*keys, "_blk"], "left")
    return joined.select(*df.columns, *[
        F.when(F.col("_rn") == 1, F.col(f"_carry.{c}")).otherwise(F.col(f"_lag_{c}")).alias(prefix + c)
        for c in cols])


def with_next(df: DataFrame, keys: Sequence[str], order: str, step: int | Column = 1, block: int | None = None) -> DataFrame:
    """Add ``next_<order>``: ``order`` of the next row of the same key (null for its last one); the same as
    ``lead(order) over (partition by keys order by order)``. ``step`` may differ by key. ``df`` is read twice: materialise it."""
    keys = list(keys)
    span = (step if isinstance(step, Column) else F.lit(int(step))) * F.lit(int(block or ORDER_BLOCK))
    blocked = df.withColumn("_blk", F.floor(F.col(order) / span).cast("long"))
    first = blocked.groupBy(*keys, "_blk").agg(F.min(order).alias("_first"))
    after = first.select(*keys, "_blk", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_blk")).alias("_after"))
    inner = Window.partitionBy(*keys, "_blk").orderBy(order)
    led = blocked.select("*", F.lead(order).over(inner).alias("_next")).join(after, [*keys, "_blk"], "left")
    return led.select(*df.columns, F.coalesce("_next", "_after").alias(f"next_{order}"))


def fill_forward(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], step: int = 1,
                 block: int | None = None) -> DataFrame:
    """Replace nulls in ``cols`` (null together, as a position is) with the
    values of the key's last earlier-or-same row where they are set; the same
    as ``last(c, ignorenulls) over (... rows unbounded preceding)``."""
    keys = list(keys)
    d = _blocked(df, keys, order, step, block)
    present = F.col(cols[0]).isNotNull()
    last = (d.filter(present).groupBy(*keys, "_blk")
            .agg(F.max_by(F.struct(*cols), order).alias("_last")))
    blocks = d.select(*keys, "_blk").distinct().join(last, [*keys, "_blk"], "left")
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(*keys, "_blk", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    upto = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = d.select(*df.columns, "_blk", *[F.last(c, ignorenulls=True).over(upto).alias(f"_fill_{c}") for c in cols])
    joined = filled.join(carry, [*keys, "_blk"], "left")
    rest = [c for c in df.columns if c not in cols]
    return joined.select(*rest, *[F.coalesce(F.col(f"_fill_{c}"), F.col(f"_carry.{c}")).alias(c) for c in cols])
