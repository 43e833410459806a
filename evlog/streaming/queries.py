"""Registered streaming and sink round-trip queries.

Each one streams the whole ``events`` table (``availableNow``) through a
streaming operator and a sink into a fresh folder under the session's
checkpoint folder, then returns a batch read of what the sink wrote. The
oracle SQL states the rows the sink must hold.

The stream has four batches, the oldest events last: the table is first stored
as four slices of ``event_id``, newest first, each of ``SLICE_FILES`` files, and
a batch takes as many files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evlog.plans import queries as Q
from evlog.plans.oracle import ENV, REPORT, SQL, _with
from evlog.operators.counts import fill_idle
from evlog.operators.ledger import save_ledger
from evlog.session import materialize, path_exists, work_path
from evlog.sources.events import ENVELOPE, read_events, save_log, union_hubs
from evlog.streaming import live, sinks
from evlog.streaming.compaction import compact_batches, compact_table
from evlog.streaming.jobs import JobConfig, parquet_job, read_stream
from evlog.streaming.stream import stream_running_total, stream_window_counts

SLICES = 4
SLICE_FILES = 2
LIVE_WATERMARK_SECONDS = 3600
RATE_SLICES = 6
HUB_FILES = {"click": 1, "view": 2}  # read caps: files of a slice for each batch


#: Folders staged by this application.
_STAGED: dict[tuple, str] = {}


def _staged(spark: SparkSession, sf_dir: str, oldest_first: bool = False, slices: int = SLICES, files: int = SLICE_FILES,
            event_type: str | None = None) -> str:
    """A folder with the events in slices; a stream reads them in the order in which they're written. It's written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, oldest_first, slices, files, event_type)
    if key in _STAGED and path_exists(spark, f"{_STAGED[key]}/_SUCCESS"):
        return _STAGED[key]
    path = work_path(spark, "staged")
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = raw.agg(F.max("event_id")).first()[0]
    rows = 0 if n is None else n + 1
    for i in range(slices) if oldest_first else reversed(range(slices)):
        part = raw.filter((F.col("event_id") * slices >= i * rows) & (F.col("event_id") * slices < (i + 1) * rows))
        part = part if event_type is None else part.filter(F.col("event_type") == event_type)
        part.repartition(files).write.mode("append").parquet(path)
    _STAGED[key] = path
    return path


def _stream(spark: SparkSession, sf_dir: str, oldest_first: bool = False, **envelope) -> DataFrame:
    envelope.setdefault("hub", Q.HUB)
    envelope.setdefault("num_partitions", Q.PARTITIONS)
    return read_events(spark, _staged(spark, sf_dir, oldest_first), streaming=True, max_files_per_trigger=SLICE_FILES, **envelope)


def _run(query) -> None:
    query.awaitTermination()
    err = query.exception()
    if err is not None:
        raise RuntimeError(f"streaming query failed: {err}")


def q_stream_window_counts(spark, sf_dir):
    base = work_path(spark, "stream-window-counts")
    _run(sinks.sink_counts(_stream(spark, sf_dir), f"{base}/out", f"{base}/cp", Q.WINDOW_SECONDS, available_now=True))
    return sinks.read_counts(spark, f"{base}/out")


def q_stream_window_state(spark, sf_dir):
    """The same counts kept in the state store, without a watermark."""
    base = work_path(spark, "stream-window-state")
    counts = stream_window_counts(_stream(spark, sf_dir), Q.WINDOW_SECONDS)
    _run(sinks.sink_upserts(counts, f"{base}/out", f"{base}/cp", available_now=True))
    return sinks.read_upserts(spark, f"{base}/out", ["window_start"])


def q_stream_window_counts_filled(spark, sf_dir):
    """Streamed per-interval counts with idle intervals filled in afterwards:
    equal to the batch ``window_counts``."""
    return fill_idle(q_stream_window_counts(spark, sf_dir), Q.WINDOW_SECONDS)


def q_stream_running_total(spark, sf_dir):
    base = work_path(spark, "stream-total")
    totals = stream_running_total(_stream(spark, sf_dir))
    _run(sinks.sink_upserts(totals, f"{base}/out", f"{base}/cp", output_mode="complete", available_now=True))
    return sinks.read_upserts(spark, f"{base}/out", ["key"])


def q_stream_union_hubs(spark, sf_dir):
    """Five hubs, each a stream of its own folder of a stored log."""
    base = work_path(spark, "stream-hubs")
    save_log(Q.events(spark, sf_dir, hub_col="event_type", num_partitions=Q.HUB_PARTITIONS), f"{base}/log")
    hubs = {name: read_events(spark, f"{base}/log/hub={name}", streaming=True, layout=ENVELOPE) for name in Q.HUB_PARTITIONS}
    _run(sinks.sink_parquet(union_hubs(hubs), f"{base}/out", f"{base}/cp", available_now=True))
    return spark.read.parquet(f"{base}/out").select("hub", "partition_id", "seqNumber", "partitionKey")


def q_stream_envelope_log(spark, sf_dir):
    """What the Parquet sink wrote, streamed back: no column is lost."""
    base = work_path(spark, "stream-log")
    _run(sinks.sink_parquet(_stream(spark, sf_dir), f"{base}/log", f"{base}/cp", available_now=True))
    again = read_events(spark, f"{base}/log", streaming=True, layout=ENVELOPE)
    _run(sinks.sink_parquet(again, f"{base}/out", f"{base}/cp2", available_now=True))
    back = spark.read.parquet(f"{base}/out")
    return back.select("hub", "partition_id", F.col("body").cast("string").alias("body_text"), "offset", "seqNumber", "enqueuedTime",
                       "publisher", "partitionKey")


def q_sink_json_latest(spark, sf_dir):
    base = work_path(spark, "sink-json-latest")
    _run(sinks.sink_json(_stream(spark, sf_dir), f"{base}/out", f"{base}/cp", mode="latest", available_now=True))
    return spark.read.parquet(f"{base}/out")


def q_sink_json_append(spark, sf_dir):
    base = work_path(spark, "sink-json-append")
    _run(sinks.sink_json(_stream(spark, sf_dir), f"{base}/out", f"{base}/cp", mode="append", available_now=True))
    return spark.read.parquet(f"{base}/out").select("value")


def q_sink_parquet(spark, sf_dir):
    base = work_path(spark, "sink-parquet")
    _run(sinks.sink_parquet(_stream(spark, sf_dir), f"{base}/out", f"{base}/cp", available_now=True))
    return spark.read.parquet(f"{base}/out").select(
        "partition_id", "seqNumber", "enqueuedTime", F.col("enqueued_date").cast("string").alias("enqueued_date"))


def q_sink_table(spark, sf_dir):
    base = work_path(spark, "sink-table")
    table = "evlog_events_" + base.rsplit("-", 1)[-1]
    _run(sinks.sink_table(_stream(spark, sf_dir), table, f"{base}/cp", location=f"{base}/table",
                          available_now=True))
    return spark.table(table).select("EventContent")


def q_stream_ledger(spark, sf_dir):
    """Partition 3 has events in the first two batches only."""
    base = work_path(spark, "stream-ledger")
    half = Q.events(spark, sf_dir).agg(F.max("seqNumber")).first()[0] or 0
    stream = _stream(spark, sf_dir).filter((F.col("partition_id") != 3) | (F.col("seqNumber") * 2 > half))
    _run(sinks.sink_ledger(stream, f"{base}/ledger", f"{base}/cp", available_now=True))
    return sinks.read_ledger(spark, f"{base}/ledger", Q.UID)


def q_stream_sequence_gaps(spark, sf_dir):
    base = work_path(spark, "stream-gaps")
    _run(sinks.sink_gaps(_stream(spark, sf_dir), f"{base}/gaps", f"{base}/cp", available_now=True))
    return sinks.read_gaps(spark, f"{base}/gaps")


def q_sink_total_text(spark, sf_dir):
    base = work_path(spark, "sink-total-text")
    totals = stream_running_total(_stream(spark, sf_dir))
    _run(sinks.sink_total_text(totals, f"{base}/total", f"{base}/cp", available_now=True))
    return spark.read.text(f"{base}/total-*")  # a line for each batch


def q_stream_live_counts(spark, sf_dir):
    """Counts per interval written while the stream runs, zeros included: what the sink holds of the closed intervals."""
    base = work_path(spark, "stream-live-counts")
    _run(live.sink_live_counts(_stream(spark, sf_dir, oldest_first=True), f"{base}/out", f"{base}/cp", Q.WINDOW_SECONDS, LIVE_WATERMARK_SECONDS,
                               available_now=True))
    return live.read_live(spark, f"{base}/out")


def q_stream_live_partition_counts(spark, sf_dir):
    """The same for each partition; partition 3 has events in the first two slices only, and goes on with zeros."""
    base = work_path(spark, "stream-live-partitions")
    half = Q.events(spark, sf_dir).agg(F.max("seqNumber")).first()[0] or 0
    stream = _stream(spark, sf_dir, oldest_first=True).filter((F.col("partition_id") != 3) | (F.col("seqNumber") * 2 < half))
    _run(live.sink_live_counts(stream, f"{base}/out", f"{base}/cp", Q.LEDGER_BATCH_SECONDS, LIVE_WATERMARK_SECONDS, by=["hub", "partition_id"],
                               available_now=True))
    return live.read_live(spark, f"{base}/out")


def q_stream_live_gaps(spark, sf_dir):
    """Every 50th event never comes, and partition 2 has none in the second slice."""
    base = work_path(spark, "stream-live-gaps")
    top = (Q.events(spark, sf_dir).agg(F.max("seqNumber")).first()[0] or 0) + 1
    slice_ = F.floor(F.col("seqNumber") * SLICES / F.lit(top))
    stream = _stream(spark, sf_dir, oldest_first=True).filter((F.col("seqNumber") % 50 != 0) & ((F.col("partition_id") != 2) | (slice_ != 1)))
    _run(live.sink_live_gaps(stream, f"{base}/out", f"{base}/cp", Q.LEDGER_BATCH_SECONDS, LIVE_WATERMARK_SECONDS, available_now=True))
    return live.read_live(spark, f"{base}/out")


def q_stream_batch_report(spark, sf_dir):
    """The report of ``stream_ledger``'s batches, written while the stream runs."""
    base = work_path(spark, "stream-report")
    env = Q.events(spark, sf_dir)
    half = env.agg(F.max("seqNumber")).first()[0] or 0
    stream = _stream(spark, sf_dir).filter((F.col("partition_id") != 3) | (F.col("seqNumber") * 2 > half))
    expected = materialize(env.select("hub", "partition_id").distinct())
    _run(live.sink_live_report(stream, f"{base}/out", f"{base}/cp", Q.UID, expected, available_now=True))
    return live.read_live(spark, f"{base}/out")


def q_stream_from_ledger(spark, sf_dir):
    """A job that starts where a stored ledger says a reader was."""
    base = work_path(spark, "stream-from-ledger")
    save_ledger(Q.daily_ledger(spark, sf_dir), f"{base}/ledger")
    cfg = JobConfig(source=_staged(spark, sf_dir), checkpoint=f"{base}/job", available_now=True, max_files_per_trigger=SLICE_FILES,
                    ledger=f"{base}/ledger", uid=Q.UID, ledger_ts=Q.STORED_AS_OF_BATCH, envelope={"hub": Q.HUB, "num_partitions": Q.PARTITIONS})
    parquet_job(spark, cfg, f"{base}/out")
    return spark.read.parquet(f"{base}/out").select("hub", "partition_id", "seqNumber", "offset")


def q_stream_hub_rates(spark, sf_dir):
    """Events per batch and hub of a stream over two hubs, each with a read cap of its own."""
    base = work_path(spark, "stream-hub-rates")
    hubs = {name: {"source": _staged(spark, sf_dir, True, RATE_SLICES, 1, name), "num_partitions": Q.HUB_PARTITIONS[name], "max_files_per_trigger": cap}
            for name, cap in HUB_FILES.items()}
    stream = read_stream(spark, JobConfig(hubs=hubs, checkpoint=f"{base}/job"))
    _run(sinks.sink_ledger(stream, f"{base}/ledger", f"{base}/cp", available_now=True))
    cells = spark.read.parquet(f"{base}/ledger")
    return cells.groupBy(F.col("batch_id").cast("long").alias("batch_id"), "hub").agg(F.sum("n").alias("n"))


def q_stream_compacted_ledger(spark, sf_dir):
    """``stream_ledger`` read from batch folders that were compacted twice while the stream ran."""
    base = work_path(spark, "stream-compacted")
    half = Q.events(spark, sf_dir).agg(F.max("seqNumber")).first()[0] or 0
    stream = _stream(spark, sf_dir).filter((F.col("partition_id") != 3) | (F.col("seqNumber") * 2 > half))

    def compact(batch, batch_id):
        if batch_id in (1, 3):
            compact_batches(spark, f"{base}/ledger", fan_in=2)

    _run(sinks.sink_all(stream, [sinks.ledger_writer(f"{base}/ledger"), compact], f"{base}/cp", available_now=True))
    return sinks.read_ledger(spark, f"{base}/ledger", Q.UID)


def q_sink_table_compacted(spark, sf_dir):
    """``sink_table`` with its old batches moved into segments, read through the view."""
    base = work_path(spark, "sink-table-compacted")
    table = "evlog_events_" + base.rsplit("-", 1)[-1]
    _run(sinks.sink_table(_stream(spark, sf_dir), table, f"{base}/cp", location=f"{base}/table", available_now=True))
    compact_table(spark, table, f"{table}_view")
    compact_table(spark, table, f"{table}_view")
    return spark.table(f"{table}_view")


STREAM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stream_window_counts": q_stream_window_counts,
    "stream_window_counts_filled": q_stream_window_counts_filled,
    "stream_running_total": q_stream_running_total,
    "stream_union_hubs": q_stream_union_hubs,
    "sink_json_latest": q_sink_json_latest,
    "sink_json_append": q_sink_json_append,
    "sink_parquet": q_sink_parquet,
    "sink_table": q_sink_table,
    "sink_total_text": q_sink_total_text,
    "stream_ledger": q_stream_ledger,
    "stream_sequence_gaps": q_stream_sequence_gaps,
    "stream_window_state": q_stream_window_state,
    "stream_envelope_log": q_stream_envelope_log,
    "stream_live_counts": q_stream_live_counts,
    "stream_live_partition_counts": q_stream_live_partition_counts,
    "stream_live_gaps": q_stream_live_gaps,
    "stream_batch_report": q_stream_batch_report,
    "stream_from_ledger": q_stream_from_ledger,
    "stream_hub_rates": q_stream_hub_rates,
    "stream_compacted_ledger": q_stream_compacted_ledger,
    "sink_table_compacted": q_sink_table_compacted,
}

# Slice and batch of each event.
_BATCHED = f"""batched AS (
  SELECT *, CAST({SLICES - 1} - least({SLICES - 1}, seqNumber * {SLICES} // (SELECT max(seqNumber) + 1 FROM env)) AS BIGINT) AS batch_ts FROM env)"""

# Intervals that the watermark has passed at the end, and the newest of them with events.
_CLOSED = """closed AS (
  SELECT *, enqueuedTime - enqueuedTime % {step} AS window_start FROM ({rows})
  WHERE enqueuedTime - enqueuedTime % {step} + {step} <= (SELECT max(enqueuedTime) FROM ({rows})) - {late})"""


def _closed(step: int, where: str = "true") -> str:
    return _CLOSED.format(step=step, rows=f"SELECT * FROM env WHERE {where}", late=LIVE_WATERMARK_SECONDS)


STREAM_SQL: dict[str, str] = {
    "stream_live_counts": _with(ENV, _closed(Q.WINDOW_SECONDS)) + f"""
        SELECT s.window_start, count(c.window_start) AS n
        FROM (SELECT unnest(generate_series(min(window_start), max(window_start), {Q.WINDOW_SECONDS})) AS window_start FROM closed) s
        LEFT JOIN closed c ON c.window_start = s.window_start GROUP BY 1""",
    "stream_live_partition_counts": _with(ENV, _closed(
        Q.LEDGER_BATCH_SECONDS, "partition_id <> 3 OR seqNumber * 2 < (SELECT max(seqNumber) FROM env)")) + f""", s AS (
        SELECT hub, partition_id, unnest(generate_series(min(window_start), (SELECT max(window_start) FROM closed), {Q.LEDGER_BATCH_SECONDS})) AS window_start
        FROM closed GROUP BY hub, partition_id)
        SELECT s.hub, s.partition_id, s.window_start, count(c.window_start) AS n
        FROM s LEFT JOIN closed c ON c.window_start = s.window_start AND c.partition_id = s.partition_id GROUP BY ALL""",
    "stream_live_gaps": _with(ENV, _closed(Q.LEDGER_BATCH_SECONDS, f"""seqNumber % 50 <> 0 AND (partition_id <> 2
        OR seqNumber * {SLICES} // (SELECT max(seqNumber) + 1 FROM env) <> 1)""")) + f""", g AS (
        SELECT hub, partition_id, window_start // {Q.LEDGER_BATCH_SECONDS} AS batch_ts, count(*) FILTER (WHERE length(body_text) > 0) AS n,
               min(seqNumber) AS min_seq, max(seqNumber) AS max_seq FROM closed GROUP BY ALL)
        SELECT hub, partition_id, batch_ts, n, min_seq, max_seq, max_seq - min_seq - n + 1 AS missing,
               min_seq - (coalesce(lag(max_seq) OVER (PARTITION BY hub, partition_id ORDER BY batch_ts), 0) + 1) AS discontinuity FROM g""",
    "stream_from_ledger": _with(ENV) + f"""SELECT hub, partition_id, seqNumber, "offset"
        FROM env LEFT JOIN (SELECT partition_id AS p, arg_max("offset", seqNumber) AS saved FROM env
                            WHERE enqueuedTime // {Q.STORED_BATCH_SECONDS} <= {Q.STORED_AS_OF_BATCH} GROUP BY ALL) ON p = partition_id
        WHERE saved IS NULL OR "offset" > saved""",
    "stream_hub_rates": _with(ENV) + f"""SELECT seqNumber * {RATE_SLICES} // (SELECT max(seqNumber) + 1 FROM env)
               // CASE partitionKey {" ".join(f"WHEN '{k}' THEN {v}" for k, v in HUB_FILES.items())} END AS batch_id,
               partitionKey AS hub, CAST(count(*) AS BIGINT) AS n
        FROM env WHERE partitionKey IN ({", ".join(f"'{k}'" for k in HUB_FILES)}) GROUP BY ALL""",
    "stream_window_counts": _with(ENV) + f"""SELECT enqueuedTime - enqueuedTime % {Q.WINDOW_SECONDS} AS window_start,
        CAST(count(*) AS BIGINT) AS n FROM env GROUP BY 1""",
    "stream_window_state": _with(ENV) + f"""SELECT enqueuedTime - enqueuedTime % {Q.WINDOW_SECONDS} AS window_start,
        CAST(count(*) AS BIGINT) AS n FROM env GROUP BY 1""",
    "stream_window_counts_filled": SQL["window_counts"],
    "stream_running_total": "SELECT 'StreamLength' AS key, count(*) AS total FROM events",
    "stream_union_hubs": SQL["union_hubs"],
    "stream_envelope_log": SQL["envelope"],
    "sink_json_latest": _with(ENV, _BATCHED) + f"""SELECT to_json({{'EventDetails': body_text}})::VARCHAR AS value
        FROM batched WHERE batch_ts = {SLICES - 1}""",
    "sink_json_append": _with(ENV) + "SELECT to_json({'EventDetails': body_text})::VARCHAR AS value FROM env",
    "sink_parquet": _with(ENV) + """SELECT partition_id, seqNumber, enqueuedTime,
        CAST(DATE '1970-01-01' + CAST(enqueuedTime // 86400 AS INTEGER) AS VARCHAR) AS enqueued_date FROM env""",
    "sink_table": _with(ENV) + "SELECT body_text AS EventContent FROM env",
    "sink_total_text": _with(ENV, _BATCHED) + """SELECT '(StreamLength,' || CAST(sum(count(*)) OVER (ORDER BY batch_ts) AS VARCHAR) || ')' AS value
        FROM batched GROUP BY batch_ts""",
    "stream_ledger": _with(ENV, _BATCHED) + f""", c AS (
        SELECT batch_ts, hub, partition_id, arg_max("offset", seqNumber) AS end_offset, max(seqNumber) AS end_seq, count(*) AS n FROM batched
        WHERE partition_id <> 3 OR seqNumber * 2 > (SELECT max(seqNumber) FROM env) GROUP BY ALL),
        g AS (SELECT hub, partition_id, batch_ts FROM (SELECT DISTINCT hub, partition_id FROM c), (SELECT DISTINCT batch_ts FROM c))
        SELECT g.batch_ts, '{Q.UID}' AS uid, hub, partition_id, coalesce(last_value(end_offset IGNORE NULLS) OVER w, -1) AS end_offset,
               coalesce(last_value(end_seq IGNORE NULLS) OVER w, -1) AS end_seq, coalesce(n, 0) AS n
        FROM g LEFT JOIN c USING (hub, partition_id, batch_ts)
        WINDOW w AS (PARTITION BY hub, partition_id ORDER BY batch_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "stream_sequence_gaps": _with(ENV, _BATCHED) + """, g AS (
        SELECT hub, partition_id, batch_ts, count(*) FILTER (WHERE length(body_text) > 0) AS n, min(seqNumber) AS min_seq,
               max(seqNumber) AS max_seq FROM batched GROUP BY ALL)
        SELECT hub, partition_id, batch_ts, n, min_seq, max_seq, max_seq - min_seq - n + 1 AS missing,
               min_seq - (coalesce(lag(max_seq) OVER (PARTITION BY hub, partition_id ORDER BY batch_ts), 0) + 1) AS discontinuity FROM g""",
}
STREAM_SQL["stream_compacted_ledger"] = STREAM_SQL["stream_ledger"]
STREAM_SQL["sink_table_compacted"] = STREAM_SQL["sink_table"]
STREAM_SQL["stream_batch_report"] = f"WITH ledger AS ({STREAM_SQL['stream_ledger']})" + REPORT
