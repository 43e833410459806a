"""Scalar functions on the event envelope: payload text, JSON rows, time, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlog.schema import PAYLOAD_COLUMN, STREAM_LENGTH_KEY


def payload_text(body: str | Column = "body") -> Column:
    """Bytes -> string. A plain cast, which is lenient about invalid UTF-8
    (bad bytes become U+FFFD); ``decode(.., 'UTF-8')`` would raise instead."""
    col = F.col(body) if isinstance(body, str) else body
    return col.cast("string")


def decode_payload(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Envelope -> payload row ``EventDetails`` (plus any ``keep`` columns)."""
    return df.select(*keep, payload_text("body").alias(PAYLOAD_COLUMN))


def encode_json(df: DataFrame) -> DataFrame:
    """Each row -> one JSON object string in column ``value``."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))


def enqueued_seconds(ts: str | Column = "ts") -> Column:
    """Event time -> epoch seconds (BIGINT). Independent of the session time
    zone for TIMESTAMP_NTZ input, which is read as UTC wall time."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_timestamp(col)


def is_non_empty(body: str | Column = "body") -> Column:
    col = F.col(body) if isinstance(body, str) else body
    return F.coalesce(F.length(col) > 0, F.lit(False))


def non_empty(df: DataFrame) -> DataFrame:
    """Events whose body holds at least one byte."""
    return df.filter(is_non_empty())


def count_non_empty(body: str | Column = "body") -> Column:
    """Aggregate: number of events with a non-empty body."""
    return F.count_if(is_non_empty(body))


def key_by_constant(df: DataFrame) -> DataFrame:
    """Event -> ``(StreamLength, 1)``, the input of the running total."""
    return df.select(F.lit(STREAM_LENGTH_KEY).alias("key"), F.lit(1).cast("long").alias("value"))
