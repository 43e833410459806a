"""The registered batch queries: one per operator of the inventory.

Every query reads the driver's ``events`` table in full and derives anything
else it needs (positions, the ledger, its text form) from it with Spark, so
its work grows with the data. Parameters are fixed here and mirrored in
``evlog.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evlog.functions.payload import count_non_empty, decode_payload, encode_json, non_empty, payload_text
from evlog.operators.counts import end_positions, running_total, sequence_gaps, window_counts
from evlog.operators.ledger import (batch_report, format_ledger, ledger_as_of, ledger_as_of_many, ledger_audit, ledger_batch,
                                    ledger_merge, ledger_retain, ledger_rows, load_ledger, lost_partitions,
                                    parse_ledger, read_ledger_files, readers_ledger, save_ledger, save_ledger_files)
from evlog.operators.ledger_table import clean_ledger, load_ledger_table, save_ledger_table
from evlog.session import materialize, work_path
from evlog.sources.events import load_log, read_events, read_partition, save_log, union_hubs, union_partitions
from evlog.sources.positions import partition_lag, slice_ranges, start_from, total_lag
from evlog.sources.zones import index_log, stored_slices

# Parameters shared with the oracle SQL.
HUB = "hub1"
PARTITIONS = 4
UID = "ns1"
UID2 = "ns2"                         # a second reader with batches of its own
UID2_STEP, UID2_PHASE = 5, 4         # its batches are the hours that are 4 modulo 5; each covers the five hours up to it
WINDOW_SECONDS = 60
LEDGER_BATCH_SECONDS = 3600          # ledger batches are hours of enqueuedTime
AS_OF_BATCH = 473552                 # hour number of 2024-01-09 08:00 UTC
START_OFFSET = 64 * 5000
START_TIME = 1705276800              # 2024-01-15 00:00:00 UTC
RANGE_FROM_STRIDE = 100              # from_seq = partition_id * 100
RANGE_MAX_RATE = 200
INDEXED_FILE_ROWS = 1_000_000        # events in a file of the indexed log, at most
PROPERTY_KEYS = ["k", "missing"]
HUB_PARTITIONS = {"click": 2, "view": 3, "purchase": 4, "signup": 1, "error": 2}
HUB_MAX_RATE = {"click": 50, "view": 120, "purchase": 10, "signup": 300}   # "error" keeps the default
LOST_BATCH_SECONDS = 60              # lost_partitions: batches of a minute, of which the newest lacks partitions
MANY_STEP = 7                        # hours between the times of ledger_as_of_many
BOTH_BATCH = 473549                  # an hour in which both readers have a batch
LAST_BATCH_SECONDS = 600             # the update batch of ledger_merge: the final 10 minutes
STORED_BATCH_SECONDS = 86400         # the stored ledger has daily batches
STORED_AS_OF_BATCH = 19731           # day number of 2024-01-09


def events(spark: SparkSession, sf_dir: str, **envelope) -> DataFrame:
    envelope.setdefault("hub", HUB)
    envelope.setdefault("num_partitions", PARTITIONS)
    return read_events(spark, f"{sf_dir}/events.parquet", **envelope)


def hour(col: str = "enqueuedTime"):
    return F.floor(F.col(col) / LEDGER_BATCH_SECONDS).cast("long")


def ledger(spark: SparkSession, sf_dir: str, fill: bool = True) -> DataFrame:
    """The read ledger of the events: one reader with hourly batches, one with
    batches of five hours. A ledger is a stored table, one
    row per reader, partition and batch; it is materialised once in the shared
    checkpoint folder, so the lookups below do not rebuild it from events."""
    env = events(spark, sf_dir)
    second = F.floor(hour() / UID2_STEP) * UID2_STEP + UID2_PHASE
    return materialize(readers_ledger(env, {UID: (hour(), 1), UID2: (second, UID2_STEP)}, fill=fill))


def _expected(rows: DataFrame) -> DataFrame:
    """The partitions that the readers of a (materialised) ledger read."""
    return rows.select("uid", "hub", "partition_id").distinct()


def ledger_lines(df: DataFrame) -> DataFrame:
    """Ledger lines in files: lines of every fifth batch are in the file of the batch before it, and some lack their last field."""
    file_ts = F.when(F.col("batch_ts") % 5 == 0, F.col("batch_ts") - 1).otherwise(F.col("batch_ts"))
    lines = format_ledger(df.withColumn("file_ts", file_ts), keep=["file_ts", "end_seq"])
    cut = F.when(F.col("end_seq") % 7 == 0, F.regexp_replace("value", " [^ ]+$", "")).otherwise(F.col("value"))
    return lines.select("file_ts", cut.alias("value"))


def _positions_view(df: DataFrame) -> DataFrame:
    return df.select("hub", "partition_id", payload_text("body").alias("body_text"), "offset", "seqNumber",
                     "enqueuedTime", "publisher", "partitionKey")


# --- 2.1 sources ---------------------------------------------------------------------------------
def q_envelope(spark, sf_dir):
    return _positions_view(events(spark, sf_dir))


def q_properties(spark, sf_dir):
    df = events(spark, sf_dir, properties=True)
    return df.select("seqNumber", F.size("properties").alias("n_props"), F.col("properties")["k"].alias("prop_k"))


def q_property_keys(spark, sf_dir):
    return events(spark, sf_dir, properties=PROPERTY_KEYS).select("seqNumber", *PROPERTY_KEYS)


def q_one_partition(spark, sf_dir):
    return read_partition(events(spark, sf_dir), 2).select("partition_id", "seqNumber", "offset", "enqueuedTime")


def stored_log(spark: SparkSession, sf_dir: str, **envelope) -> DataFrame:
    """The events stored in hub and partition folders, so that each input of a union reads only its own."""
    path = work_path(spark, "log")
    save_log(events(spark, sf_dir, **envelope), path)
    return load_log(spark, path)


def q_union_partitions(spark, sf_dir):
    log = stored_log(spark, sf_dir)
    return union_partitions([read_partition(log, p, HUB) for p in range(PARTITIONS)]).select(
        "hub", "partition_id", "seqNumber", "offset")


def q_union_hubs(spark, sf_dir):
    log = stored_log(spark, sf_dir, hub_col="event_type", num_partitions=HUB_PARTITIONS)
    hubs = {name: log.filter(F.col("hub") == name) for name in HUB_PARTITIONS}
    return union_hubs(hubs).select("hub", "partition_id", "seqNumber", "partitionKey")


def q_start_from_checkpoint(spark, sf_dir):
    saved = ledger_as_of(ledger(spark, sf_dir), UID, AS_OF_BATCH)
    return start_from(events(spark, sf_dir), checkpoint=saved, complete=True).select("hub", "partition_id", "seqNumber", "offset")


def q_start_from_offset(spark, sf_dir):
    env = events(spark, sf_dir, after_offset=START_OFFSET)      # bound pushed into the scan
    return start_from(env, offset=START_OFFSET).select("hub", "partition_id", "seqNumber", "offset")


def q_start_from_time(spark, sf_dir):
    env = events(spark, sf_dir, after_time=START_TIME)          # bound pushed into the scan
    return start_from(env, enqueued=START_TIME).select("hub", "partition_id", "seqNumber", "enqueuedTime")


def q_slice_ranges(spark, sf_dir):
    """Partition 3 has no saved position: it starts at the start of the log."""
    env = events(spark, sf_dir)
    positions = env.select("hub", "partition_id").distinct().filter("partition_id < 3").withColumn(
        "end_seq", (F.col("partition_id") * RANGE_FROM_STRIDE).cast("long"))
    return slice_ranges(env, positions, max_rate=RANGE_MAX_RATE).select(
        "hub", "partition_id", "seqNumber", "offset", "from_seq", "until_seq")


def q_slice_ranges_indexed(spark, sf_dir):
    """``slice_ranges`` of a stored log, of which two thirds are in its zone map and the rest came later."""
    path = work_path(spark, "indexed-log")
    env = events(spark, sf_dir)
    early = F.col("seqNumber") * 3 < 2 * env.select(F.max("seqNumber")).scalar()
    save_log(env.filter(early), path, max_records_per_file=INDEXED_FILE_ROWS)
    index_log(spark, path)
    save_log(env.filter(~early), path, append=True, max_records_per_file=INDEXED_FILE_ROWS)
    positions = env.select("hub", "partition_id").distinct().filter("partition_id < 3").withColumn(
        "end_seq", (F.col("partition_id") * RANGE_FROM_STRIDE).cast("long"))
    return stored_slices(spark, path, positions, max_rate=RANGE_MAX_RATE).select(
        "hub", "partition_id", "seqNumber", "offset", "from_seq", "until_seq")


def q_slice_ranges_per_hub(spark, sf_dir):
    env = events(spark, sf_dir, hub_col="event_type", num_partitions=HUB_PARTITIONS)
    positions = env.select("hub", "partition_id").distinct().withColumn(
        "end_seq", (F.col("partition_id") * RANGE_FROM_STRIDE).cast("long"))
    return slice_ranges(env, positions, max_rate=HUB_MAX_RATE).select(
        "hub", "partition_id", "seqNumber", "from_seq", "until_seq")


def q_partition_lag(spark, sf_dir):
    saved = ledger_as_of(ledger(spark, sf_dir), UID, AS_OF_BATCH)
    return partition_lag(events(spark, sf_dir), saved)


def q_total_lag(spark, sf_dir):
    return total_lag(q_partition_lag(spark, sf_dir))


# --- 2.2 projections -----------------------------------------------------------------------------
def q_payload_text(spark, sf_dir):
    return decode_payload(events(spark, sf_dir))


def q_payload_json(spark, sf_dir):
    return encode_json(decode_payload(events(spark, sf_dir)))


def q_non_empty(spark, sf_dir):
    """Every tenth body is empty, and every tenth null."""
    bodies = events(spark, sf_dir).withColumn("body", F.when(F.col("seqNumber") % 10 == 0, F.lit(b"")).when(
        F.col("seqNumber") % 10 != 1, F.col("body")))
    kept = non_empty(bodies).groupBy("hub", "partition_id").agg(F.count("*").alias("n_kept"))
    counts = bodies.groupBy("hub", "partition_id").agg(F.count(F.lit(1)).alias("n_events"), count_non_empty("body").alias("n_non_empty"))
    return counts.join(kept, ["hub", "partition_id"])


# --- 2.3 aggregates ------------------------------------------------------------------------------
def q_window_counts(spark, sf_dir):
    return window_counts(events(spark, sf_dir), WINDOW_SECONDS)


def q_running_total(spark, sf_dir):
    return running_total(window_counts(events(spark, sf_dir), WINDOW_SECONDS))


def q_sequence_gaps(spark, sf_dir):
    return sequence_gaps(events(spark, sf_dir), hour())


def q_end_positions(spark, sf_dir):
    return end_positions(events(spark, sf_dir))


# --- 2.5 ledger ----------------------------------------------------------------------------------
def q_ledger_rows(spark, sf_dir):
    return ledger(spark, sf_dir)


def q_parse_ledger(spark, sf_dir):
    return parse_ledger(ledger_lines(ledger(spark, sf_dir)))


def q_ledger_as_of(spark, sf_dir):
    """Each reader's own newest batch: the second one's is older."""
    both = ledger(spark, sf_dir)
    return ledger_as_of(both, UID, AS_OF_BATCH).unionByName(ledger_as_of(both, UID2, AS_OF_BATCH))


def q_ledger_as_of_exact(spark, sf_dir):
    raw = ledger(spark, sf_dir, fill=False)
    return ledger_as_of(raw, UID, AS_OF_BATCH, exact=True, expected=_expected(raw).filter(F.col("uid") == UID))


def q_ledger_as_of_many(spark, sf_dir):
    """Both readers' positions at every seventh hour, from before their first batch to after their last."""
    both = ledger(spark, sf_dir)
    ends = both.agg(F.min("batch_ts").alias("lo"), F.max("batch_ts").alias("hi"))
    hours = ends.select(F.explode(F.sequence(F.col("lo") - 10, F.col("hi") + 10, F.lit(MANY_STEP).cast("long"))).alias("ts"))
    requests = hours.select(F.explode(F.array(F.lit(UID), F.lit(UID2))).alias("uid"), "ts")
    return ledger_as_of_many(both, requests)


def q_ledger_audit_files(spark, sf_dir):
    """The ledger's lines written as text files, read back and audited file by file."""
    path = work_path(spark, "ledger-files")
    raw = ledger(spark, sf_dir, fill=False).filter(F.col("uid") == UID)
    save_ledger_files(ledger_lines(raw), path)
    audit = ledger_audit(read_ledger_files(spark, path), _expected(raw), file_col="file")
    return audit.withColumn("file_ts", F.regexp_extract("file", "file_ts=([0-9]+)", 1).cast("long")).drop("file")


def q_ledger_merge(spark, sf_dir):
    current = ledger_as_of(ledger(spark, sf_dir), UID, AS_OF_BATCH)
    env = events(spark, sf_dir)
    newest = env.select(F.max("enqueuedTime")).scalar()
    last = env.filter(F.col("enqueuedTime") > newest - LAST_BATCH_SECONDS)
    update = end_positions(last).select(F.lit(UID).alias("uid"), "hub", "partition_id",
                                        F.lit(AS_OF_BATCH + 1).cast("long").alias("batch_ts"),
                                        "end_offset", "end_seq")
    return ledger_merge(current, update)


def q_ledger_audit(spark, sf_dir):
    raw = ledger(spark, sf_dir, fill=False).filter(F.col("uid") == UID)
    return ledger_audit(parse_ledger(ledger_lines(raw), keep=["file_ts"]), _expected(raw), file_col="file_ts")


def q_ledger_audit_readers(spark, sf_dir):
    """Both readers' batches, each held against its own partitions: the second one doesn't read partition 0."""
    raw = ledger(spark, sf_dir, fill=False).filter((F.col("uid") == UID) | (F.col("partition_id") != 0))
    return ledger_audit(raw, _expected(raw))


def q_lost_partitions(spark, sf_dir):
    minute = F.floor(F.col("enqueuedTime") / LOST_BATCH_SECONDS).cast("long")
    both = ledger(spark, sf_dir)
    recent = ledger_rows(events(spark, sf_dir), minute, UID, fill=False).unionByName(both.filter(F.col("uid") == UID2))
    return lost_partitions(recent, _expected(both))


def q_ledger_batch(spark, sf_dir):
    return ledger_batch(ledger(spark, sf_dir), BOTH_BATCH)


def daily_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readers' daily ledgers; the second one doesn't read partition 0."""
    day = F.floor(F.col("enqueuedTime") / STORED_BATCH_SECONDS).cast("long")
    env = events(spark, sf_dir)
    return ledger_rows(env, day, UID).unionByName(ledger_rows(env.filter(F.col("partition_id") != 0), day, UID2))


def q_ledger_stored_batch(spark, sf_dir):
    """Two readers' daily ledgers stored one after the other, then one batch looked up:
    the lookup reads that batch's folders, and the second reader's rows have not replaced the first one's."""
    path = work_path(spark, "ledger")
    both = daily_ledger(spark, sf_dir)
    for uid in (UID, UID2):
        save_ledger(both.filter(F.col("uid") == uid), path)
    return ledger_batch(load_ledger(spark, path), STORED_AS_OF_BATCH)


def q_ledger_retain(spark, sf_dir):
    return ledger_retain(ledger(spark, sf_dir), AS_OF_BATCH)


def q_ledger_cleaned(spark, sf_dir):
    """The daily ledgers as a catalog table, cleaned twice."""
    path = work_path(spark, "ledger-table")
    database = "evlog_" + path.rsplit("-", 1)[-1]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{path}'")
    save_ledger_table(daily_ledger(spark, sf_dir), f"{database}.ledger")
    clean_ledger(spark, f"{database}.ledger", STORED_AS_OF_BATCH - 3)
    clean_ledger(spark, f"{database}.ledger", STORED_AS_OF_BATCH)
    return load_ledger_table(spark, f"{database}.ledger")


def q_batch_report(spark, sf_dir):
    return batch_report(ledger(spark, sf_dir))


BATCH_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "envelope": q_envelope,
    "properties": q_properties,
    "property_keys": q_property_keys,
    "payload_text": q_payload_text,
    "payload_json": q_payload_json,
    "one_partition": q_one_partition,
    "union_partitions": q_union_partitions,
    "union_hubs": q_union_hubs,
    "start_from_checkpoint": q_start_from_checkpoint,
    "start_from_offset": q_start_from_offset,
    "start_from_time": q_start_from_time,
    "slice_ranges": q_slice_ranges,
    "slice_ranges_per_hub": q_slice_ranges_per_hub,
    "slice_ranges_indexed": q_slice_ranges_indexed,
    "partition_lag": q_partition_lag,
    "total_lag": q_total_lag,
    "non_empty": q_non_empty,
    "window_counts": q_window_counts,
    "running_total": q_running_total,
    "sequence_gaps": q_sequence_gaps,
    "end_positions": q_end_positions,
    "ledger_rows": q_ledger_rows,
    "parse_ledger": q_parse_ledger,
    "ledger_as_of": q_ledger_as_of,
    "ledger_as_of_exact": q_ledger_as_of_exact,
    "ledger_as_of_many": q_ledger_as_of_many,
    "ledger_audit_files": q_ledger_audit_files,
    "ledger_merge": q_ledger_merge,
    "ledger_audit": q_ledger_audit,
    "ledger_audit_readers": q_ledger_audit_readers,
    "lost_partitions": q_lost_partitions,
    "ledger_batch": q_ledger_batch,
    "ledger_stored_batch": q_ledger_stored_batch,
    "ledger_retain": q_ledger_retain,
    "ledger_cleaned": q_ledger_cleaned,
    "batch_report": q_batch_report,
}
