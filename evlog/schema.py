"""Schemas, column names and fixed values shared by every operator.

The event envelope is the row shape every source produces and every operator
consumes: one row per event, keyed by ``(hub, partition_id, seqNumber)``.
Time is carried as epoch seconds (``enqueuedTime`` BIGINT) so that results do
not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: these must equal the reference's for the same results. ---
# Position of a partition before its first event (offset and sequence number).
START_OF_LOG = -1
# Default and lower bound of the per-partition read cap (events per batch).
DEFAULT_MAX_RATE = 10000
# Key of the running event total and its text form "(StreamLength,N)".
STREAM_LENGTH_KEY = "StreamLength"
# Payload row column, and the column name of the catalog target table.
PAYLOAD_COLUMN = "EventDetails"
TABLE_COLUMN = "EventContent"
# Rows per JDBC insert group and the target column type (NVARCHAR(128) NOT NULL
# on SQL Server; VARCHAR(128) on databases without NVARCHAR).
JDBC_BATCH_SIZE = 1000
JDBC_PAYLOAD_TYPE = "VARCHAR(128)"
# Rows printed per batch by the console sink.
CONSOLE_ROWS = 10
# Text form of a hub partition: "<hub>-partition-<id>".
PARTITION_NAME_FORMAT = "%s-partition-%d"
# One line of the batch report per partition.
RANGE_DESCRIPTION_FORMAT = "eventhub: %s\tstarting offsets: %dsequenceNumbers: %d to %d"
# Text form of the running total.
TOTAL_TEXT_FORMAT = "(%s,%d)"
# Text form of a ledger record: batch, reader id, hub, partition, offset, sequence number.
LEDGER_TEXT_FORMAT = "%d %s %s %d %d %d"
# --- end of fixed values ---

# Layout of the landed event table the sources read (the driver's ``events``).
EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

# Event envelope: hub and partition first, then the six event fields.
ENVELOPE_SCHEMA = T.StructType(
    [
        T.StructField("hub", T.StringType()),
        T.StructField("partition_id", T.IntegerType()),
        T.StructField("body", T.BinaryType()),
        T.StructField("offset", T.LongType()),
        T.StructField("seqNumber", T.LongType()),
        T.StructField("enqueuedTime", T.LongType()),
        T.StructField("publisher", T.StringType()),
        T.StructField("partitionKey", T.StringType()),
    ]
)
ENVELOPE_COLUMNS = [f.name for f in ENVELOPE_SCHEMA.fields]
PARTITION_KEY = ["hub", "partition_id"]

# Read ledger: how far each reader (uid) got in each partition at each batch.
LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("batch_ts", T.LongType()),
        T.StructField("uid", T.StringType()),
        T.StructField("hub", T.StringType()),
        T.StructField("partition_id", T.IntegerType()),
        T.StructField("end_offset", T.LongType()),
        T.StructField("end_seq", T.LongType()),
        T.StructField("n", T.LongType()),
    ]
)
LEDGER_COLUMNS = [f.name for f in LEDGER_SCHEMA.fields]
