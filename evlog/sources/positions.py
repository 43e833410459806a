"""Reading from a position: start points, bounded ranges and lag.

A *position table* has one row per hub partition (``hub, partition_id`` plus
``end_offset``/``end_seq``, the last event already read, exclusive). It is small
by design, and joined to the events through ``join_small``, which checks its
size before broadcasting it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlog.operators.counts import end_positions
from evlog.plans.joins import join_small, materialize_small
from evlog.schema import DEFAULT_MAX_RATE, PARTITION_KEY, START_OF_LOG


def within(df: DataFrame, bounds: DataFrame, low: str, high: str | None = None) -> DataFrame:
    """``df`` without the events outside all of the small ``bounds``: one row of bounds is read and stated as
    literals, which Parquet scans use to skip row groups. No bounds, no events."""
    names = [F.min(low)] + ([F.max(high)] if high else [])
    found = bounds.agg(*names).first()
    if found[0] is None:
        return df.filter(F.lit(False))
    out = df.filter(F.col("seqNumber") > int(found[0]))
    return out.filter(F.col("seqNumber") <= int(found[1])) if high else out


def start_from(df: DataFrame, checkpoint: DataFrame | None = None, offset: int | None = None,
               enqueued: int | None = None, complete: bool = False) -> DataFrame:
    """Events after the start position of their partition.

    Per partition the start is, in this order: the saved checkpoint offset
    (unless null or -1), else ``offset``, else ``enqueued`` (epoch seconds),
    else the start of the log. All bounds are exclusive. ``complete`` says that
    the checkpoint (with ``end_seq``) has every partition that is to be read;
    its lowest position is then pushed into the scan and other partitions are left out.
    """
    fallback: Column = F.lit(True)
    if enqueued is not None:
        fallback = F.col("enqueuedTime") > int(enqueued)
    if offset is not None:
        fallback = F.col("offset") > int(offset)
    if checkpoint is None:
        return df.filter(fallback)
    saved, fits = materialize_small(checkpoint.select(*PARTITION_KEY, F.col("end_offset").alias("_cp_offset"),
                                                      *(["end_seq"] if complete else [])))
    if complete:
        low = F.when(F.col("_cp_offset").isNull() | (F.col("_cp_offset") == START_OF_LOG), START_OF_LOG).otherwise(F.col("end_seq"))
        df = within(df, saved.withColumn("_low", low), "_low")
        saved = saved.drop("end_seq")
    joined = df.join(F.broadcast(saved) if fits else saved, PARTITION_KEY, "inner" if complete else "left")
    has_cp = F.col("_cp_offset").isNotNull() & (F.col("_cp_offset") != START_OF_LOG)
    return joined.filter(F.when(has_cp, F.col("offset") > F.col("_cp_offset")).otherwise(fallback)).drop("_cp_offset")


def _rate(max_rate: int | Mapping[str, int]) -> Column:
    if isinstance(max_rate, Mapping):
        if not max_rate or any(int(v) <= 0 for v in max_rate.values()):
            raise ValueError("max_rate has to be larger than zero for every hub")
        pairs = [x for k, v in max_rate.items() for x in (F.lit(k), F.lit(int(v)))]
        return F.coalesce(F.element_at(F.create_map(*pairs), F.col("hub")), F.lit(DEFAULT_MAX_RATE))
    if int(max_rate) <= 0:
        raise ValueError("max_rate has to be larger than zero")
    return F.lit(int(max_rate))


def range_bounds(positions: DataFrame, latest: DataFrame, max_rate: int | Mapping[str, int] = DEFAULT_MAX_RATE,
                 seq_col: str = "end_seq") -> DataFrame:
    """Per partition: ``from_seq`` (exclusive) and
    ``until_seq = min(latest_seq, from_seq + max_rate)`` (inclusive). A
    partition without a position starts at the start of the log."""
    rate = _rate(max_rate)
    pos = positions.select(*PARTITION_KEY, F.col(seq_col).cast("long").alias("from_seq"))
    top = latest.select(*PARTITION_KEY, F.col("end_seq").alias("latest_seq"))
    pos = top.join(pos, PARTITION_KEY, "left").withColumn("from_seq", F.coalesce("from_seq", F.lit(START_OF_LOG).cast("long")))
    return pos.select(
        *PARTITION_KEY, "from_seq", F.least(F.col("latest_seq"), F.col("from_seq") + rate).alias("until_seq"))


def slice_ranges(df: DataFrame, positions: DataFrame, max_rate: int | Mapping[str, int] = DEFAULT_MAX_RATE,
                 latest: DataFrame | None = None, seq_col: str = "end_seq") -> DataFrame:
    """The events one batch reads: per partition ``from_seq < seqNumber <=
    min(latest, from_seq + max_rate)``. ``max_rate`` may differ per hub;
    ``latest`` defaults to the highest sequence number in ``df``."""
    bounds = range_bounds(positions, latest if latest is not None else end_positions(df), max_rate, seq_col)
    bounds, fits = materialize_small(bounds)
    joined = within(df, bounds, "from_seq", "until_seq").join(F.broadcast(bounds) if fits else bounds, PARTITION_KEY, "inner")
    return joined.filter((F.col("seqNumber") > F.col("from_seq")) & (F.col("seqNumber") <= F.col("until_seq")))


def partition_lag(df: DataFrame, positions: DataFrame, latest: DataFrame | None = None,
                  seq_col: str = "end_seq") -> DataFrame:
    """Per partition: current and latest sequence number,
    ``lag = max(latest - current, 0)`` and ``caught_up = current >= latest``.
    A partition without a position starts at -1."""
    top = (latest if latest is not None else end_positions(df)).select(*PARTITION_KEY, F.col("end_seq").alias("latest_seq"))
    cur = positions.select(*PARTITION_KEY, F.col(seq_col).cast("long").alias("current_seq"))
    joined = join_small(top, cur, PARTITION_KEY, "left")
    current = F.coalesce(F.col("current_seq"), F.lit(START_OF_LOG).cast("long"))
    return joined.select(
        *PARTITION_KEY, current.alias("current_seq"), "latest_seq",
        F.greatest(F.col("latest_seq") - current, F.lit(0).cast("long")).alias("lag"),
        (current >= F.col("latest_seq")).alias("caught_up"),
    )


def total_lag(lag: DataFrame) -> DataFrame:
    """Sum of the per-partition lag, and how many partitions are caught up."""
    return lag.agg(F.sum("lag").cast("long").alias("total_lag"),
                   F.count_if("caught_up").alias("caught_up_partitions"),
                   F.count(F.lit(1)).alias("partitions"))
