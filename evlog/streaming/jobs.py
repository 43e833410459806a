"""Job controls (batch interval, checkpoint, timeout, graceful stop) and the
event jobs: count, JSON rows, catalog table, JDBC table and Parquet.

Every job reads the event log as a stream, counts events per interval and in
total, and (except the count job) persists the events. Receiver and direct
reading are the same thing in Structured Streaming, so there is one count job;
its read cap is the source's own option (``maxFilesPerTrigger`` or
``maxBytesPerTrigger`` for files, ``maxOffsetsPerTrigger`` for Kafka), one for
each hub where several are read. State and progress live in the
checkpoint folder, so a restarted job resumes where it stopped.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evlog.operators.ledger import ledger_as_of, load_ledger
from evlog.schema import JDBC_PAYLOAD_TYPE, PARTITION_KEY, START_OF_LOG
from evlog.session import path_exists
from evlog.sources.events import DEFAULT_HUB, DEFAULT_PARTITIONS, ENVELOPE, kafka_start, read_events, read_kafka, union_hubs
from evlog.sources.positions import start_from
from evlog.streaming import live, sinks
from evlog.streaming.stream import stream_running_total, stream_window_counts


#: What an entry of ``JobConfig.hubs`` may say.
HUB_OPTIONS = {"source", "num_partitions", "max_files_per_trigger", "max_bytes_per_trigger", "kafka", "max_offsets_per_trigger"}


@dataclass
class JobConfig:
    """A job's source, start, read caps and outputs. An option that the source can't honour is an error."""

    checkpoint: str                          # job folder: one sub-folder per query
    source: str | None = None                # folder of the stored event log
    # or several: hub name -> {"source": folder, "num_partitions": count, "max_files_per_trigger" or "max_bytes_per_trigger": the hub's own
    # read cap}, or {"kafka": options of Spark's Kafka source, "max_offsets_per_trigger": cap}
    hubs: dict | None = None
    kafka: dict | None = None                # or options of Spark's Kafka source
    interval_seconds: int = 10               # batch interval and count window
    timeout_minutes: float | None = None     # None or negative: run until stopped
    available_now: bool = False              # process what is there, then stop
    max_files_per_trigger: int | None = None     # read cap of a stored log; with hubs, of those without a cap
    max_bytes_per_trigger: int | None = None
    max_offsets_per_trigger: int | None = None   # Kafka: events per batch
    file_glob: str | None = None
    layout: str | None = None                # of the stored log: "landed" (default) or "envelope"
    after_offset: int | None = None          # start after this offset ...
    after_time: int | None = None            # ... or after this epoch second
    # Start each partition after its position in a stored ledger (``save_ledger``): of reader uid, in its newest batch or that of ledger_ts.
    # A partition without a position starts as the options above say. The positions hold for the life of the job folder.
    ledger: str | None = None
    uid: str | None = None
    ledger_ts: int | None = None
    properties: bool | list = False          # True: map of properties; list: a column per key
    # None: every event counts, however late. Seconds: interval counts are kept in state and events that are later
    # than this behind the newest one may be lost.
    watermark_seconds: int | None = None
    # With a watermark: write idle intervals as zeros too, and each interval once, when the watermark has passed it.
    idle_zeros: bool = False
    envelope: dict = field(default_factory=dict)
    console: bool = False

    def __post_init__(self):
        if int(self.interval_seconds) <= 0:
            raise ValueError("batch interval must be a positive number of seconds")
        if sum(x is not None for x in (self.source, self.hubs, self.kafka)) != 1:
            raise ValueError("give one of source, hubs and kafka")
        if self.ledger is None and (self.uid is not None or self.ledger_ts is not None):
            raise ValueError("uid and ledger_ts need a ledger")
        if self.ledger is not None and not self.uid:
            raise ValueError("a ledger needs the uid of the reader whose positions are meant")
        if self.idle_zeros and self.watermark_seconds is None:
            raise ValueError("idle_zeros needs watermark_seconds")
        for name, hub in (self.hubs or {}).items():
            if set(hub) - HUB_OPTIONS:
                raise ValueError(f"hub {name}: unknown options {sorted(set(hub) - HUB_OPTIONS)}")
            if ("source" in hub) == ("kafka" in hub):
                raise ValueError(f"hub {name}: give one of source and kafka")
            wrong = {"max_offsets_per_trigger"} if "source" in hub else {"num_partitions", "max_files_per_trigger", "max_bytes_per_trigger"}
            if wrong & set(hub):
                raise ValueError(f"hub {name}: no effect of {sorted(wrong & set(hub))}")
            if "kafka" in hub and self.ledger is not None and "," in hub["kafka"].get("subscribe", ","):
                raise ValueError(f"hub {name}: saved positions need the hub's one topic as subscribe")
        stored, kafka = self.reads_stored(), self.reads_kafka()
        if stored and kafka and self.ledger is not None:
            raise ValueError("saved positions are for stored logs or for Kafka, not for both in one job")
        for option in ("max_files_per_trigger", "max_bytes_per_trigger", "file_glob", "layout", "after_offset"):
            if getattr(self, option) is not None and kafka:
                raise ValueError(f"{option} has no effect on Kafka" + (": state it in the hub" if stored else ""))
        if self.envelope and kafka:
            raise ValueError("envelope has no effect on Kafka, whose topics and partitions name the hub and partition")
        if self.max_offsets_per_trigger is not None and stored:
            raise ValueError("max_offsets_per_trigger has no effect on a stored log")
        if set(self.envelope) & {"properties"}:
            raise ValueError("properties is an option of its own")

    def reads_stored(self) -> bool:
        return self.source is not None or any("source" in h for h in (self.hubs or {}).values())

    def reads_kafka(self) -> bool:
        return self.kafka is not None or any("kafka" in h for h in (self.hubs or {}).values())


def start_positions(spark: SparkSession, cfg: JobConfig) -> DataFrame | None:
    """The positions that the job starts from, or None without a ledger.

    They are taken from the ledger once and kept in the job folder: a restart
    that took newer ones would skip the events that the job itself hasn't read yet.
    """
    if cfg.ledger is None:
        return None
    path = f"{cfg.checkpoint.rstrip('/')}/_start_positions"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        saved, known = load_ledger(spark, cfg.ledger), _expected(cfg)
        # With the partitions known, only the folders of one batch are read.
        expected = None if known is None else spark.createDataFrame(sorted(known), "hub string, partition_id int")
        at = (1 << 63) - 1 if cfg.ledger_ts is None else cfg.ledger_ts
        ledger_as_of(saved, cfg.uid, at, expected=expected).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _expected(cfg: JobConfig) -> set | None:
    """The partitions of a stored log, where the configuration gives their number."""
    if cfg.layout == ENVELOPE or cfg.reads_kafka():
        return None
    count, hub_col = cfg.envelope.get("num_partitions", DEFAULT_PARTITIONS), cfg.envelope.get("hub_col")
    if cfg.hubs is not None:
        counts = {name: hub.get("num_partitions", count) for name, hub in cfg.hubs.items()}
        return None if any(not isinstance(n, int) for n in counts.values()) else {(name, i) for name, n in counts.items() for i in range(n)}
    if hub_col is not None or not isinstance(count, int):
        return None
    return {(cfg.envelope.get("hub", DEFAULT_HUB), i) for i in range(count)}


def read_stream(spark: SparkSession, cfg: JobConfig) -> DataFrame:
    """The job's events as a stream. Each hub is a source of its own with its own read cap, all in one query."""
    positions = start_positions(spark, cfg)

    def kafka(options: dict, cap: int | None, hub: str | None = None) -> DataFrame:
        options, saved = dict(options), positions
        if saved is not None and hub is not None:
            saved = saved.filter(F.col("hub") == hub).withColumn("hub", F.lit(options.get("subscribe")))
        if positions is not None or cfg.after_time is not None:
            if any(k.lower() in ("startingoffsets", "startingtimestamp", "startingoffsetsbytimestamp") for k in options):
                raise ValueError("the Kafka options name a start already")
            # An event's time is floored to seconds: the first one after T is at (T + 1) s or later.
            options.update(kafka_start(saved) if saved is not None else {"startingTimestamp": str((int(cfg.after_time) + 1) * 1000)})
        return read_kafka(spark, options, cap, cfg.properties)

    def stored(folder: str, **own) -> DataFrame:
        caps = {k: own.pop(k) for k in ("max_files_per_trigger", "max_bytes_per_trigger") if k in own}
        caps = caps or {"max_files_per_trigger": cfg.max_files_per_trigger, "max_bytes_per_trigger": cfg.max_bytes_per_trigger}
        # With saved positions the start options hold for the partitions without one only, so they can't be pushed into the scan.
        bounds = {} if positions is not None else {"after_offset": cfg.after_offset, "after_time": cfg.after_time}
        return read_events(spark, folder, streaming=True, file_glob=cfg.file_glob, layout=cfg.layout, **caps, **bounds,
                           **{"properties": cfg.properties, **cfg.envelope, **own})

    if cfg.kafka is not None:
        return kafka(cfg.kafka, cfg.max_offsets_per_trigger)
    if cfg.hubs is not None:
        def one(name: str, hub: dict) -> DataFrame:
            if "kafka" in hub:
                return kafka(hub["kafka"], hub.get("max_offsets_per_trigger", cfg.max_offsets_per_trigger), name)
            return stored(hub["source"], hub=name, **{k: v for k, v in hub.items() if k != "source"})

        events = union_hubs({name: one(name, hub) for name, hub in cfg.hubs.items()})
    else:
        events = stored(cfg.source)
    if positions is None or cfg.reads_kafka():
        return events
    expected = _expected(cfg)
    # Where every partition has a position the lowest one is pushed into the scan.
    known = positions.filter(F.col("end_offset") != START_OF_LOG).select(*PARTITION_KEY).distinct()
    complete = expected is not None and known.count() <= len(expected) and {tuple(r) for r in known.collect()} == expected
    return start_from(events, checkpoint=positions, offset=cfg.after_offset, enqueued=cfg.after_time, complete=complete)


def graceful_stop(query: StreamingQuery, poll_seconds: float = 0.2, max_wait_seconds: float | None = None) -> None:
    """Stop between batches: wait until no trigger is running, then stop. ``max_wait_seconds`` cuts a longer batch off.
    A batch that starts in the moment before the stop is repeated by the next run, like any other unfinished one."""
    deadline = None if max_wait_seconds is None else time.monotonic() + max_wait_seconds
    while query.isActive and query.status.get("isTriggerActive") and (deadline is None or time.monotonic() < deadline):
        time.sleep(poll_seconds)
    query.stop()


def await_queries(queries: list[StreamingQuery], timeout_minutes: float | None = None, poll_seconds: float = 0.2,
                  max_wait_seconds: float | None = None) -> None:
    """Wait until all queries end, or until ``timeout_minutes`` (None or negative: no limit) are over, then stop the rest
    gracefully. If a query fails the others are stopped and its error is raised."""
    deadline = None if timeout_minutes is None or timeout_minutes < 0 else time.monotonic() + timeout_minutes * 60
    try:
        while any(q.isActive for q in queries) and (deadline is None or time.monotonic() < deadline):
            if any(q.exception() is not None for q in queries):
                break
            time.sleep(poll_seconds)
    finally:
        for q in queries:
            if q.isActive:
                graceful_stop(q, poll_seconds, max_wait_seconds)
    for q in queries:
        if q.exception() is not None:
            raise q.exception()


def _run(spark: SparkSession, cfg: JobConfig, rows: list[sinks.BatchWriter], total_prefix: str) -> list[StreamingQuery]:
    """One query writes the rows and the counts per interval of each batch; a second one, which reads no payload, keeps the
    running total in the state store and writes it as text."""
    stream = read_stream(spark, cfg)
    base = cfg.checkpoint.rstrip("/")
    common = dict(trigger_seconds=cfg.interval_seconds, available_now=cfg.available_now)
    queries = []
    if cfg.watermark_seconds is None:
        rows = [*rows, sinks.counts_writer(f"{base}/window_counts", cfg.interval_seconds, show=cfg.console)]
    elif cfg.idle_zeros:
        queries.append(live.sink_live_counts(stream, f"{base}/window_counts", f"{base}/_cp/window_counts", cfg.interval_seconds, cfg.watermark_seconds,
                                             **common))
    else:
        windows = stream_window_counts(stream, cfg.interval_seconds, cfg.watermark_seconds)
        queries.append(sinks.sink_upserts(windows, f"{base}/window_counts", f"{base}/_cp/window_counts", **common))
    if rows:
        queries.append(sinks.sink_all(stream, rows, f"{base}/_cp/rows", **common))
    queries.append(sinks.sink_total_text(stream_running_total(stream), total_prefix, f"{base}/_cp/total", **common))
    if cfg.console:
        queries.append(sinks.sink_console(stream_running_total(stream), f"{base}/_cp/console", output_mode="complete", **common))
    await_queries(queries, cfg.timeout_minutes)
    return queries


def job_counts(spark: SparkSession, cfg: JobConfig) -> DataFrame:
    """``(window_start, n)`` as the job has counted so far."""
    path = f"{cfg.checkpoint.rstrip('/')}/window_counts"
    if cfg.idle_zeros:
        return live.read_live(spark, path)
    return sinks.read_counts(spark, path) if cfg.watermark_seconds is None else sinks.read_upserts(spark, path, ["window_start"])


def count_job(spark: SparkSession, cfg: JobConfig, total_prefix: str) -> list[StreamingQuery]:
    """Events per interval and in total."""
    return _run(spark, cfg, [], total_prefix)


def json_job(spark: SparkSession, cfg: JobConfig, out_path: str, total_prefix: str,
             mode: str = "latest") -> list[StreamingQuery]:
    """Payload rows as JSON strings (Parquet files) plus counts."""
    return _run(spark, cfg, [sinks.json_writer(out_path, mode)], total_prefix)


def table_job(spark: SparkSession, cfg: JobConfig, table: str, total_prefix: str, location: str | None = None,
              idempotent: bool = True) -> list[StreamingQuery]:
    """Payload rows appended to a catalog table plus counts."""
    sinks.ensure_table(spark, table, location, idempotent)
    return _run(spark, cfg, [sinks.table_writer(table, idempotent)], total_prefix)


def jdbc_job(spark: SparkSession, cfg: JobConfig, url: str, table: str, total_prefix: str,
             properties: dict | None = None, dedupe_key: bool = False, payload_type: str = JDBC_PAYLOAD_TYPE) -> list[StreamingQuery]:
    """Payload rows inserted into a JDBC table plus counts."""
    return _run(spark, cfg, [sinks.jdbc_writer(url, table, properties, dedupe_key, payload_type)], total_prefix)


def parquet_job(spark: SparkSession, cfg: JobConfig, out_path: str) -> list[StreamingQuery]:
    """Envelope rows appended to Parquet, partitioned by event date."""
    queries = [sinks.sink_parquet(read_stream(spark, cfg), out_path, f"{cfg.checkpoint.rstrip('/')}/_cp/parquet",
                                  trigger_seconds=cfg.interval_seconds, available_now=cfg.available_now)]
    await_queries(queries, cfg.timeout_minutes)
    return queries
