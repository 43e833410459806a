"""Counts, gaps and batch reports in the live output of a stream: idle intervals as zeros, a partition's gaps from one interval to
the next, and what each batch read.

Spark's windowed aggregation (state store, watermark) gives each interval of a
key once, when the watermark has passed it. The batch writer puts these rows in
order: what it needs from the batches before, a row per key, is carried from
batch to batch beside the output. A batch that is run again after a failure reads
the same carried rows and replaces its own output, so the rows are exactly
those of an uninterrupted run. An interval is written once and never changed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evlog.functions.payload import count_non_empty
from evlog.operators.counts import end_positions, gaps_of, spread_range
from evlog.operators.ledger import batch_report
from evlog.schema import PARTITION_KEY, START_OF_LOG
from evlog.session import materialize, remove_folder
from evlog.streaming.compaction import read_batches
from evlog.streaming.sinks import BatchWriter, batch_folder, start_query
from evlog.streaming.stream import EVENT_TIME, stream_window_counts, with_event_time


def _carry_path(path: str, batch_id: int) -> str:
    return f"{path}/_carry/{int(batch_id)}"  # readers of ``path`` ignore names with an underscore


def _carried(batch: DataFrame, path: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """What the batch before left; none before the first one."""
    spark = batch.sparkSession
    return spark.read.schema(schema).parquet(_carry_path(path, batch_id - 1)) if batch_id > 0 else spark.createDataFrame([], schema)


def _finish(carry: DataFrame, path: str, batch_id: int) -> None:
    """Stores what the next batch needs. Only the newest batch can run again, so the carried rows before the last ones aren't needed any more."""
    carry.write.mode("overwrite").parquet(_carry_path(path, batch_id))
    remove_folder(carry.sparkSession, _carry_path(path, batch_id - 2))


# --- A1 ---------------------------------------------------------------------------------------------
def live_counts_writer(path: str, interval_seconds: int, by: Sequence[str] = ()) -> BatchWriter:
    """Per batch of closed intervals: these and the idle ones up to the newest closed one, in the batch's folder."""
    iv, keys = int(interval_seconds), list(by)

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = materialize(batch.select(*keys, F.col("window_start").cast("long").alias("window_start"), "n"))
        schema = T.StructType([*(counts.schema[k] for k in keys), T.StructField("next_start", T.LongType())])
        before = _carried(batch, path, batch_id, schema)
        newest = counts.agg(F.max("window_start")).first()[0]
        if newest is None:  # the watermark moved, but no interval with events was closed
            counts.write.mode("overwrite").parquet(batch_folder(path, batch_id))
            _finish(before, path, batch_id)
            return
        # The intervals before next_start are written; a key that's new begins with its first interval.
        lows = before.unionByName(counts.withColumnRenamed("window_start", "next_start").drop("n")).groupBy(*keys).agg(F.min("next_start").alias("next_start"))
        lows = materialize(lows)
        idle = spread_range(lows, F.col("next_start"), F.lit(newest), iv, "window_start", keys=keys, spread=False)
        rows = counts.unionByName(idle.withColumn("n", F.lit(0).cast("long"))).groupBy(*keys, "window_start").agg(F.sum("n").alias("n"))
        rows.write.mode("overwrite").parquet(batch_folder(path, batch_id))
        _finish(lows.withColumn("next_start", F.lit(newest + iv).cast("long")), path, batch_id)

    return write


def sink_live_counts(stream: DataFrame, path: str, checkpoint: str, interval_seconds: int, watermark_seconds: int, by: Sequence[str] = (),
                     trigger_seconds: int | None = None, available_now: bool = False) -> StreamingQuery:
    """Events per interval with idle intervals as ``n = 0``, written as the stream runs: ``(*by, window_start, n)``.

    An interval is closed when the watermark (newest event time less ``watermark_seconds``) has reached its end; events that
    are later than that are dropped. The rows written so far are those of ``fill_idle`` over the closed intervals: from the first one
    with events to the newest one with events. With ``by`` each of its values has rows of its own from its first
    interval on, and goes on with zeros while others have events. Null is a value.
    """
    counts = stream_window_counts(stream, interval_seconds, watermark_seconds, by=by)
    return start_query(counts.writeStream.outputMode("append").foreachBatch(live_counts_writer(path, interval_seconds, by)), checkpoint,
                       trigger_seconds, available_now)


# --- A3 ---------------------------------------------------------------------------------------------
def live_gaps_writer(path: str) -> BatchWriter:
    """Per batch of closed intervals: what is missing in each, and before it since the partition's interval before."""

    def write(batch: DataFrame, batch_id: int) -> None:
        closed = materialize(batch.select(*PARTITION_KEY, "batch_ts", "n", "min_seq", "max_seq"))
        kept = [*PARTITION_KEY, "batch_ts", "max_seq"]
        before = _carried(batch, path, batch_id, T.StructType([closed.schema[c] for c in kept]))
        none = F.lit(None).cast("long")
        # The carried row of a partition stands before its closed intervals, and isn't an interval itself.
        together = materialize(closed.unionByName(before.withColumn("n", none).withColumn("min_seq", none)))
        gaps_of(together).filter("n IS NOT NULL").write.mode("overwrite").parquet(batch_folder(path, batch_id))
        last = together.groupBy(*PARTITION_KEY).agg(F.max("batch_ts").alias("batch_ts"), F.max_by("max_seq", "batch_ts").alias("max_seq"))
        _finish(last.select(*kept), path, batch_id)

    return write


def sink_live_gaps(stream: DataFrame, path: str, checkpoint: str, interval_seconds: int, watermark_seconds: int, trigger_seconds: int | None = None,
                   available_now: bool = False, time_col: str = "enqueuedTime") -> StreamingQuery:
    """``sequence_gaps`` written as the stream runs: a batch is an interval with events, ``batch_ts`` its number since the epoch,
    and its row comes when the watermark has reached its end. Events that are later than that are dropped, so they count as missing."""
    iv = int(interval_seconds)
    if iv <= 0:
        raise ValueError("interval must be a positive number of seconds")
    per = with_event_time(stream, time_col, int(watermark_seconds)).groupBy(*PARTITION_KEY, F.window(EVENT_TIME, f"{iv} seconds")).agg(
        count_non_empty("body").alias("n"), F.min("seqNumber").alias("min_seq"), F.max("seqNumber").alias("max_seq"))
    rows = per.select(*PARTITION_KEY, F.floor(F.unix_seconds("window.start") / iv).cast("long").alias("batch_ts"), "n", "min_seq", "max_seq")
    return start_query(rows.writeStream.outputMode("append").foreachBatch(live_gaps_writer(path)), checkpoint, trigger_seconds, available_now)


# --- L8 ---------------------------------------------------------------------------------------------
def live_report_writer(path: str, uid: str, expected: DataFrame | None = None) -> BatchWriter:
    """Per batch: its ``batch_report`` row, with what each partition's batch before it ended at. ``expected`` (``hub, partition_id``) names partitions
    that are reported from the first batch on, whether or not they have events yet; others are from their first event on."""

    def write(batch: DataFrame, batch_id: int) -> None:
        now = end_positions(batch).select(*PARTITION_KEY, "end_offset", "end_seq")
        schema = now.schema
        start = F.lit(START_OF_LOG).cast("long")
        if batch_id == 0 and expected is not None:
            before = expected.select(*PARTITION_KEY).distinct().withColumns({"end_offset": start, "end_seq": start})
        else:
            before = _carried(batch, path, batch_id, schema)
        ranked = before.withColumn("_r", F.lit(0)).unionByName(now.withColumn("_r", F.lit(1)))
        # Idle partitions stay where they were.
        ends = materialize(ranked.groupBy(*PARTITION_KEY).agg(F.max_by(F.struct("end_offset", "end_seq"), "_r").alias("_e")).select(*PARTITION_KEY, "_e.*"))
        two = ends.withColumn("batch_ts", F.lit(int(batch_id)).cast("long")).unionByName(before.withColumn("batch_ts", F.lit(int(batch_id) - 1).cast("long")))
        report = batch_report(materialize(two.withColumn("uid", F.lit(uid)))).filter(F.col("batch_ts") == int(batch_id))
        report.write.mode("overwrite").parquet(batch_folder(path, batch_id))
        _finish(ends, path, batch_id)

    return write


def sink_live_report(stream: DataFrame, path: str, checkpoint: str, uid: str, expected: DataFrame | None = None, trigger_seconds: int | None = None,
                     available_now: bool = False) -> StreamingQuery:
    """``batch_report`` of a reader, written batch by batch as the stream runs."""
    return start_query(stream.writeStream.foreachBatch(live_report_writer(path, uid, expected)), checkpoint, trigger_seconds, available_now)


def read_live(spark, path: str) -> DataFrame:
    """The rows of all batches."""
    return read_batches(spark, path).drop("batch_id")
