"""Counting operators: events per interval, running totals, sequence gaps and
end positions.

All of them aggregate before any data moves: Spark's partial (map-side)
aggregation collapses the raw events of each task to one row per key, so a hot
partition or a busy interval never ships its raw events to a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evlog.functions.payload import count_non_empty
from evlog.operators.ordered import with_previous
from evlog.plans.joins import join_small
from evlog.schema import PARTITION_KEY
from evlog.session import materialize

SECONDS_PER_DAY = 86400
# Windows generated per spine block; keeps every generated array small.
SPINE_BLOCK = 4096


def interval_start(time_col: str | Column, interval_seconds: int) -> Column:
    """Epoch-second time -> start of its tumbling interval (epoch aligned)."""
    t = F.col(time_col) if isinstance(time_col, str) else time_col
    return t - F.pmod(t, F.lit(int(interval_seconds)))


def _check_interval(interval_seconds: int) -> int:
    iv = int(interval_seconds)
    if iv <= 0:
        raise ValueError("interval must be a positive number of seconds")
    return iv


def spread_range(source: DataFrame, lo: Column, hi: Column, step: int, name: str,
                 keys: list[str] | None = None, spread: bool = True) -> DataFrame:
    """For every row of ``source``: one row per value ``lo, lo+step, .. <= hi``
    in column ``name`` (plus the ``keys`` columns of the row).

    Generated in two levels: first one row per block of ``SPINE_BLOCK`` values,
    spread over the cluster by a fixed-count repartition (adaptive execution
    does not merge those), then the values of each block. No array ever holds
    more than one block, and no single task generates the whole range. Without
    ``spread`` (for few rows) the values are made where the rows are.
    """
    keys = keys or []
    span = int(step) * SPINE_BLOCK
    blocks = source.select(*keys, F.explode(F.sequence(lo, hi, F.lit(span).cast("long"))).alias("_b"),
                           hi.alias("_hi"))
    if spread:
        width = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = blocks.repartition(width, *keys, "_b")
    return blocks.select(*keys, F.explode(F.sequence(
        F.col("_b"), F.least(F.col("_b") + F.lit(span - int(step)), F.col("_hi")),
        F.lit(int(step)).cast("long"))).alias(name))


def window_spine(lo: Column, hi: Column, source: DataFrame, interval_seconds: int) -> DataFrame:
    """Every interval start from ``lo`` to ``hi`` (inclusive), one row each."""
    return spread_range(source, lo, hi, _check_interval(interval_seconds), "window_start")


def window_counts(df: DataFrame, interval_seconds: int, time_col: str = "enqueuedTime",
                  fill_empty: bool = True, start: int | None = None, end: int | None = None) -> DataFrame:
    """Events per tumbling interval: ``(window_start BIGINT, n BIGINT)``.

    With ``fill_empty`` every interval between the first and the last event (or
    ``start``/``end`` when given) is present, idle ones with ``n = 0``. The
    events are counted per interval once and checkpointed; bounds and zero
    rows are made from those rows.
    """
    iv = _check_interval(interval_seconds)
    hits = df.select(interval_start(time_col, iv).alias("window_start"), F.lit(1).cast("long").alias("n"))
    counted = hits.groupBy("window_start").agg(F.count(F.lit(1)).alias("n"))
    return fill_idle(materialize(counted), iv, start, end) if fill_empty else counted


def fill_idle(counts: DataFrame, interval_seconds: int, start: int | None = None,
              end: int | None = None) -> DataFrame:
    """Add ``n = 0`` rows for the intervals missing from ``(window_start, n)``
    rows, e.g. the output of ``stream_window_counts``, between the first and
    the last interval (or ``start``/``end``), and sum ``n`` per interval."""
    iv = _check_interval(interval_seconds)
    rows = counts.select(F.col("window_start").cast("long").alias("window_start"), F.col("n").cast("long").alias("n"))
    lo_v = None if start is None else int(start) - int(start) % iv
    hi_v = None if end is None else int(end) - int(end) % iv
    if lo_v is not None and hi_v is not None:
        bounds = counts.sparkSession.range(1)             # no pass over the data for the bounds
    else:
        bounds = rows.agg(F.min("window_start").alias("_lo"), F.max("window_start").alias("_hi"))
    lo = F.col("_lo") if lo_v is None else F.lit(lo_v).cast("long")
    hi = F.col("_hi") if hi_v is None else F.lit(hi_v).cast("long")
    zeros = window_spine(lo, hi, bounds, iv).select("window_start", F.lit(0).cast("long").alias("n"))
    if lo_v is not None:
        rows = rows.filter(F.col("window_start") >= lo_v)
    if hi_v is not None:
        rows = rows.filter(F.col("window_start") <= hi_v)
    return rows.unionByName(zeros).groupBy("window_start").agg(F.sum("n").alias("n"))


def running_total(counts: DataFrame, interval_seconds: int | None = None,
                  block_seconds: int = SECONDS_PER_DAY) -> DataFrame:
    """Add ``total``, the number of events up to and including each interval.

    ``counts`` is ``window_counts`` output (``window_start, n``), or events,
    which are first counted per ``interval_seconds`` (idle intervals as 0).

    Two levels instead of one global ordered window (which would run on a
    single task): per-block totals get a prefix sum (one row per block, e.g.
    per day), then each block computes its own running sum in parallel and adds
    the block's starting offset. The per-interval input is checkpointed first,
    so the events are aggregated once.
    """
    blk = _check_interval(block_seconds)
    if not {"window_start", "n"} <= set(counts.columns):
        if interval_seconds is None:
            raise ValueError("events need interval_seconds to be counted first")
        counts = window_counts(counts, interval_seconds)
    base = materialize(counts.select("window_start", "n"))
    base = base.withColumn("_blk", interval_start("window_start", blk))
    per_block = base.groupBy("_blk").agg(F.sum("n").alias("_blk_n"))
    before = per_block.select(
        "_blk",
        F.coalesce(F.sum("_blk_n").over(Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).cast("long").alias("_before"))
    inside = Window.partitionBy("_blk").orderBy("window_start").rowsBetween(Window.unboundedPreceding,
                                                                            Window.currentRow)
    joined = join_small(base, before, "_blk")
    return joined.select("window_start", "n", (F.col("_before") + F.sum("n").over(inside)).cast("long").alias("total"))


def sequence_gaps(df: DataFrame, batch_col: str | Column, batch_name: str = "batch_ts",
                  batch_step: int = 1) -> DataFrame:
    """Per partition and batch: events with a body, min/max sequence number,
    ``missing = max - min - n + 1`` and ``discontinuity = min - (previous max + 1)``
    (the previous max of a partition's first batch is 0). Empty bodies count
    as missing, and a log that starts at sequence 0 shows discontinuity -1.

    The previous batch of a partition is found in blocks of batches
    (``batch_step`` apart), so no task holds a partition's whole history."""
    batch = F.col(batch_col) if isinstance(batch_col, str) else batch_col
    per_batch = df.groupBy(*PARTITION_KEY, batch.cast("long").alias(batch_name)).agg(
        count_non_empty("body").alias("n"),
        F.min("seqNumber").alias("min_seq"),
        F.max("seqNumber").alias("max_seq"),
    )
    return gaps_of(materialize(per_batch), batch_name, batch_step)


def gaps_of(per_batch: DataFrame, batch_name: str = "batch_ts", batch_step: int = 1) -> DataFrame:
    """``sequence_gaps`` from rows that have ``n, min_seq, max_seq`` per partition and batch."""
    per_batch = with_previous(per_batch, PARTITION_KEY, batch_name, ["max_seq"], step=batch_step)
    prev_max = F.coalesce(F.col("prev_max_seq"), F.lit(0))
    return per_batch.select(
        *PARTITION_KEY, batch_name, "n", "min_seq", "max_seq",
        (F.col("max_seq") - F.col("min_seq") - F.col("n") + 1).alias("missing"),
        (F.col("min_seq") - (prev_max + 1)).alias("discontinuity"),
    )


def end_positions(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per partition: highest sequence number, the offset of that event, and
    the event count."""
    keys = by or PARTITION_KEY
    return df.groupBy(*keys).agg(
        F.max_by("offset", "seqNumber").alias("end_offset"),
        F.max("seqNumber").alias("end_seq"),
        F.count(F.lit(1)).alias("n"),
    )
