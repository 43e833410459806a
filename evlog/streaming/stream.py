"""Streaming forms of the counting operators.

Event time is ``timestamp_seconds(enqueuedTime)``: a TIMESTAMP (watermarks
reject TIMESTAMP_NTZ) built from epoch seconds, so windows are epoch aligned
and independent of the session time zone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlog.functions.payload import key_by_constant

EVENT_TIME = "_event_time"


def with_event_time(df: DataFrame, time_col: str = "enqueuedTime", watermark_seconds: int | None = None) -> DataFrame:
    out = df.withColumn(EVENT_TIME, F.timestamp_seconds(F.col(time_col)))
    if watermark_seconds is not None:
        if int(watermark_seconds) < 0:
            raise ValueError("watermark must not be negative")
        out = out.withWatermark(EVENT_TIME, f"{int(watermark_seconds)} seconds")
    return out


def stream_window_counts(df: DataFrame, interval_seconds: int, watermark_seconds: int | None = None,
                         time_col: str = "enqueuedTime", by: Sequence[str] = ()) -> DataFrame:
    """Events per tumbling interval of event time, ``(*by, window_start, n)``.

    Without a watermark every event counts, however late, and the state keeps
    one row per interval. ``watermark_seconds`` bounds the state: a window's count
    is final once the watermark passes its end, its state is dropped, and **later
    events of it are lost**. ``sinks.sink_counts`` needs neither state nor watermark.
    Idle intervals produce no row; ``live.sink_live_counts`` writes them as
    zeros, and so does the batch ``window_counts``.
    """
    iv = int(interval_seconds)
    if iv <= 0:
        raise ValueError("interval must be a positive number of seconds")
    timed = with_event_time(df, time_col, watermark_seconds)
    return (timed.groupBy(*by, F.window(EVENT_TIME, f"{iv} seconds"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(*by, F.unix_seconds(F.col("window.start")).alias("window_start"), "n"))


def stream_running_total(df: DataFrame) -> DataFrame:
    """Events so far, under the single key ``StreamLength`` (complete mode).
    The state is one row whatever the volume, and restarts continue it."""
    return key_by_constant(df).groupBy("key").agg(F.count("value").alias("total"))
