"""Sinks: JSON rows, partitioned Parquet, catalog table, JDBC, running-total
text and console.

Writers used from ``foreachBatch`` key their output by batch id, so a batch
replayed after a failure overwrites its own output instead of adding to it
(exactly-once for files and tables). Many batches are made few folders by
``compaction``, whose ``read_batches`` reads either. JDBC stays at-least-once; its
rows carry no batch key unless the caller adds one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evlog.functions.payload import count_non_empty, decode_payload, encode_json
from evlog.operators.counts import end_positions, gaps_of, interval_start
from evlog.operators.ledger import fill_cells
from evlog.schema import (CONSOLE_ROWS, JDBC_BATCH_SIZE, JDBC_PAYLOAD_TYPE, PARTITION_KEY, PAYLOAD_COLUMN,
                          STREAM_LENGTH_KEY, TABLE_COLUMN, TOTAL_TEXT_FORMAT)
from evlog.session import materialize
from evlog.streaming.compaction import read_batches
from evlog.streaming.stream import stream_running_total

BatchWriter = Callable[[DataFrame, int], None]


def trigger_args(trigger_seconds: int | None = None, available_now: bool = False) -> dict:
    """Keyword arguments for ``DataStreamWriter.trigger``."""
    if available_now:
        return {"availableNow": True}
    if trigger_seconds is None:
        return {}
    if int(trigger_seconds) <= 0:
        raise ValueError("batch interval must be a positive number of seconds")
    return {"processingTime": f"{int(trigger_seconds)} seconds"}


# Batches to a folder of batch folders, so that no folder gets very many.
BATCH_GROUP = 1000


def batch_folder(path: str, batch_id: int) -> str:
    """A batch's own folder: rewriting it replaces the batch's output and nothing else."""
    return f"{path}/batch_group={int(batch_id) // BATCH_GROUP}/batch_id={int(batch_id)}"


def start_query(writer, checkpoint: str, trigger_seconds: int | None, available_now: bool,
                name: str | None = None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    targs = trigger_args(trigger_seconds, available_now)
    if targs:
        writer = writer.trigger(**targs)
    if name:
        writer = writer.queryName(name)
    return writer.start()


# --- K1: JSON rows ------------------------------------------------------------------------------
def json_writer(path: str, mode: str = "latest") -> BatchWriter:
    """Payload -> ``{"EventDetails": ...}`` string rows, stored as Parquet.

    ``latest``: every batch replaces the previous one (only the last batch is
    kept). ``append``: one folder per batch, read by ``compaction.read_batches``.
    """
    if mode not in ("latest", "append"):
        raise ValueError("mode is 'latest' or 'append'")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = encode_json(decode_payload(batch))
        rows.write.mode("overwrite").parquet(path if mode == "latest" else batch_folder(path, batch_id))

    return write


def sink_json(stream: DataFrame, path: str, checkpoint: str, mode: str = "latest",
              trigger_seconds: int | None = None, available_now: bool = False) -> StreamingQuery:
    return start_query(stream.writeStream.foreachBatch(json_writer(path, mode)), checkpoint, trigger_seconds,
                       available_now)


# --- K2: partitioned Parquet ----------------------------------------------------------------------
def with_enqueued_date(df: DataFrame, time_col: str = "enqueuedTime") -> DataFrame:
    """Adds ``enqueued_date`` (UTC date of the epoch-second time)."""
    return df.withColumn("enqueued_date", F.date_from_unix_date(F.floor(F.col(time_col) / 86400).cast("int")))


def sink_parquet(stream: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = ("enqueued_date",),
                 trigger_seconds: int | None = None, available_now: bool = False) -> StreamingQuery:
    """Append to Parquet, partitioned by the event date (one folder per day,
    not per second). The file sink's own log makes it exactly-once."""
    out = with_enqueued_date(stream) if "enqueued_date" in partition_by else stream
    writer = out.writeStream.format("parquet").outputMode("append").option("path", path).partitionBy(*partition_by)
    return start_query(writer, checkpoint, trigger_seconds, available_now)


# --- K3: catalog table --------------------------------------------------------------------------
def ensure_table(spark: SparkSession, table: str, location: str | None = None, idempotent: bool = True) -> None:
    """``CREATE TABLE IF NOT EXISTS`` with one string column ``EventContent``
    (plus the ``batch_id`` partition column when ``idempotent``)."""
    cols = f"{TABLE_COLUMN} STRING" + (", batch_id BIGINT" if idempotent else "")
    ddl = f"CREATE TABLE IF NOT EXISTS {table} ({cols}) USING parquet"
    if idempotent:
        ddl += " PARTITIONED BY (batch_id)"
    if location:
        ddl += f" LOCATION '{location}'"
    spark.sql(ddl)


def table_writer(table: str, idempotent: bool = True) -> BatchWriter:
    """Inserts the payload rows by position (``EventDetails`` lands in
    ``EventContent``). ``idempotent`` overwrites the batch's own partition."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = decode_payload(batch).select(PAYLOAD_COLUMN)
        if not idempotent:
            rows.write.insertInto(table)
            return
        # A static partition overwrite replaces this batch's partition and
        # nothing else, whatever the session's partitionOverwriteMode says.
        view = f"evlog_batch_{uuid.uuid4().hex[:12]}"
        rows.createOrReplaceTempView(view)
        try:
            batch.sparkSession.sql(
                f"INSERT OVERWRITE TABLE {table} PARTITION (batch_id = {int(batch_id)}) SELECT * FROM {view}")
        finally:
            batch.sparkSession.catalog.dropTempView(view)

    return write


def sink_table(stream: DataFrame, table: str, checkpoint: str, location: str | None = None, idempotent: bool = True,
               trigger_seconds: int | None = None, available_now: bool = False) -> StreamingQuery:
    ensure_table(stream.sparkSession, table, location, idempotent)
    return start_query(stream.writeStream.foreachBatch(table_writer(table, idempotent)), checkpoint, trigger_seconds,
                       available_now)


# --- K4: JDBC -----------------------------------------------------------------------------------
def jdbc_options(url: str, table: str, properties: Mapping[str, str] | None = None,
                 payload_type: str = JDBC_PAYLOAD_TYPE) -> dict[str, str]:
    """Options of Spark's JDBC writer. ``payload_type`` is the payload column's type when the table is created; a
    payload that doesn't fit it fails its batch, so name a wide enough one (``VARCHAR(4000)``, ``TEXT``)."""
    opts = {
        "url": url,
        "dbtable": table,
        "batchsize": str(JDBC_BATCH_SIZE),
        "createTableColumnTypes": f"{PAYLOAD_COLUMN} {payload_type}",
    }
    opts.update(properties or {})
    return opts


def jdbc_writer(url: str, table: str, properties: Mapping[str, str] | None = None,
                dedupe_key: bool = False, payload_type: str = JDBC_PAYLOAD_TYPE) -> BatchWriter:
    """Appends the payload rows with bound parameters, ``batchsize`` rows per
    round trip; the table is created on first write. At-least-once: with
    ``dedupe_key`` every row also carries ``hub, partition_id, seqNumber``,
    which identify an event, so the target can drop replayed rows."""
    opts = jdbc_options(url, table, properties, payload_type)
    keep = PARTITION_KEY + ["seqNumber"] if dedupe_key else []

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = decode_payload(batch, keep=keep)
        rows.write.format("jdbc").options(**opts).mode("append").save()

    return write


def sink_jdbc(stream: DataFrame, url: str, table: str, checkpoint: str, properties: Mapping[str, str] | None = None,
              trigger_seconds: int | None = None, available_now: bool = False,
              dedupe_key: bool = False, payload_type: str = JDBC_PAYLOAD_TYPE) -> StreamingQuery:
    return start_query(stream.writeStream.foreachBatch(jdbc_writer(url, table, properties, dedupe_key, payload_type)), checkpoint,
                       trigger_seconds, available_now)


# --- K5: running total as text ------------------------------------------------------------------
def total_text(totals: DataFrame) -> DataFrame:
    """``(key, total)`` rows -> text ``(StreamLength,N)``."""
    return totals.select(F.format_string(TOTAL_TEXT_FORMAT, "key", "total").alias("value"))


def total_text_writer(prefix: str) -> BatchWriter:
    def write(batch: DataFrame, batch_id: int) -> None:
        total_text(batch).repartition(1).write.mode("overwrite").text(f"{prefix}-{int(batch_id)}")

    return write


def sink_total_text(totals: DataFrame, prefix: str, checkpoint: str, trigger_seconds: int | None = None,
                    available_now: bool = False) -> StreamingQuery:
    """Writes the running total after every batch under ``<prefix>-<batch id>``.
    ``totals`` is ``stream_running_total(...)`` (complete mode), or the event
    stream itself, which is then totalled."""
    if not {"key", "total"} <= set(totals.columns):
        totals = stream_running_total(totals)
    writer = totals.writeStream.outputMode("complete").foreachBatch(total_text_writer(prefix))
    return start_query(writer, checkpoint, trigger_seconds, available_now)


# --- K6: console ----------------------------------------------------------------------------------
def sink_console(stream: DataFrame, checkpoint: str, output_mode: str = "append", trigger_seconds: int | None = None,
                 available_now: bool = False) -> StreamingQuery:
    """Prints the first rows of each batch."""
    writer = (stream.writeStream.format("console").outputMode(output_mode)
              .option("numRows", CONSOLE_ROWS).option("truncate", "false"))
    return start_query(writer, checkpoint, trigger_seconds, available_now)


# --- A1 in a stream: counts per interval -----------------------------------------------------------
def counts_writer(path: str, interval_seconds: int, show: bool = False, time_col: str = "enqueuedTime") -> BatchWriter:
    """Per batch: its events per interval, in the batch's folder. No state and no watermark, so an event counts
    whenever it arrives; ``read_counts`` adds the batches up. ``show`` prints the batch's first intervals."""

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(interval_start(time_col, interval_seconds).alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(batch_folder(path, batch_id))
        if show:
            written = batch.sparkSession.read.parquet(batch_folder(path, batch_id))
            written.orderBy("window_start").show(CONSOLE_ROWS, truncate=False)

    return write


def sink_counts(stream: DataFrame, path: str, checkpoint: str, interval_seconds: int, trigger_seconds: int | None = None,
                available_now: bool = False) -> StreamingQuery:
    return start_query(stream.writeStream.foreachBatch(counts_writer(path, interval_seconds)), checkpoint, trigger_seconds, available_now)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(window_start, n)`` over all batches written by ``counts_writer``."""
    return read_batches(spark, path).groupBy("window_start").agg(F.sum("n").alias("n"))


def sink_all(stream: DataFrame, writers: list[BatchWriter], checkpoint: str, trigger_seconds: int | None = None,
             available_now: bool = False) -> StreamingQuery:
    """Several writers on one query: each batch is read once and written by all of them, so their outputs agree."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if len(writers) > 1:
            batch = batch.persist()
        try:
            for writer in writers:
                writer(batch, batch_id)
        finally:
            if len(writers) > 1:
                batch.unpersist()

    return start_query(stream.writeStream.foreachBatch(write), checkpoint, trigger_seconds, available_now)


# --- L1 in a stream: the read ledger ---------------------------------------------------------------
def ledger_writer(path: str) -> BatchWriter:
    """Per batch: the end offset and sequence number of each partition with events, and their number, in the batch's
    folder. ``read_ledger`` repeats the positions of idle partitions."""

    def write(batch: DataFrame, batch_id: int) -> None:
        end_positions(batch).write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return write


def sink_ledger(stream: DataFrame, path: str, checkpoint: str, trigger_seconds: int | None = None,
                available_now: bool = False) -> StreamingQuery:
    return start_query(stream.writeStream.foreachBatch(ledger_writer(path)), checkpoint, trigger_seconds, available_now)


def _cells(spark: SparkSession, path: str) -> DataFrame:
    return materialize(read_batches(spark, path).withColumnRenamed("batch_id", "batch_ts"))


def read_ledger(spark: SparkSession, path: str, uid: str, expected: DataFrame | None = None) -> DataFrame:
    """The ledger of reader ``uid`` from what ``sink_ledger`` wrote, in ``LEDGER_SCHEMA`` column order: a row for every
    batch and partition (``expected``, or every partition seen). A partition without events in a batch has its last
    position with ``n = 0``, and ``(-1, -1)`` before its first event."""
    return fill_cells(_cells(spark, path), uid, expected=expected)


# --- A3 in a stream: sequence gaps per batch ------------------------------------------------------
def gaps_writer(path: str) -> BatchWriter:
    """Per batch and partition: events with a body and min/max sequence number, in the batch's folder.
    ``read_gaps`` compares each with the partition's last batch before it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*PARTITION_KEY).agg(
            count_non_empty("body").alias("n"), F.min("seqNumber").alias("min_seq"),
            F.max("seqNumber").alias("max_seq")).write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return write


def sink_gaps(stream: DataFrame, path: str, checkpoint: str, trigger_seconds: int | None = None,
              available_now: bool = False) -> StreamingQuery:
    return start_query(stream.writeStream.foreachBatch(gaps_writer(path)), checkpoint, trigger_seconds, available_now)


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    return gaps_of(_cells(spark, path))


# --- keyed results of update-mode aggregations ------------------------------------------------------
def upsert_writer(path: str) -> BatchWriter:
    """Each batch's updated rows in the batch's folder (idempotent)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return write


def sink_upserts(stream: DataFrame, path: str, checkpoint: str, output_mode: str = "update",
                 trigger_seconds: int | None = None, available_now: bool = False) -> StreamingQuery:
    writer = stream.writeStream.outputMode(output_mode).foreachBatch(upsert_writer(path))
    return start_query(writer, checkpoint, trigger_seconds, available_now)


def read_upserts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of every key written by ``sink_upserts``."""
    rows = read_batches(spark, path)
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
    return latest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def read_total_text(spark: SparkSession, prefix: str) -> DataFrame:
    """Parse ``(StreamLength,N)`` lines back into ``(key, total)``."""
    lines = spark.read.text(f"{prefix}-*")
    m = r"^\((.*),(-?[0-9]+)\)$"
    return lines.select(F.regexp_extract("value", m, 1).alias("key"),
                        F.regexp_extract("value", m, 2).cast("long").alias("total"))


__all__ = ["STREAM_LENGTH_KEY", "sink_json", "sink_parquet", "sink_table", "sink_jdbc", "sink_total_text",
           "sink_console", "sink_counts", "read_counts", "sink_all", "sink_ledger", "read_ledger", "sink_gaps", "read_gaps", "sink_upserts", "read_upserts", "read_total_text"]
