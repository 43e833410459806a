from __future__ import annotations

import os

import pytest
from conftest import MEDIUM
from pyspark.sql import functions as F

from evlog.functions.payload import decode_payload, encode_json
from evlog.operators.counts import window_counts
from evlog.sources.events import read_events, union_hubs
from evlog.streaming import sinks
from evlog.streaming.jobs import JobConfig, await_queries, count_job, job_counts, json_job, parquet_job, read_stream, table_job
from evlog.streaming.stream import stream_running_total, stream_window_counts

FILES = 4


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """The sf0.01 events split into FILES parquet files, ordered by event id,
    written one at a time so that file times follow the event order."""
    root = str(tmp_path_factory.mktemp("staged"))
    work = str(tmp_path_factory.mktemp("staging-work"))
    raw = spark.read.parquet(f"{MEDIUM}/events.parquet")
    n = raw.count()
    step = -(-n // FILES)
    for i in range(FILES):
        part = raw.filter((F.col("event_id") >= i * step) & (F.col("event_id") < (i + 1) * step))
        part.coalesce(1).write.parquet(f"{work}/tmp{i}")
        (src,) = [f for f in os.listdir(f"{work}/tmp{i}") if f.endswith(".parquet")]
        os.link(f"{work}/tmp{i}/{src}", f"{root}/part-{i:03d}.parquet")
        os.utime(f"{root}/part-{i:03d}.parquet", (1_000_000 + i, 1_000_000 + i))
    return root


def stream_of(spark, staged, **kw):
    return read_events(spark, staged, streaming=True, file_glob="part-*.parquet", max_files_per_trigger=1, **kw)


def run(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


def test_stream_window_counts_equal_batch(spark, staged, scratch):
    q = run(sinks.sink_upserts(stream_window_counts(stream_of(spark, staged), 60), f"{scratch}/out",
                               f"{scratch}/cp", available_now=True))
    assert len(q.recentProgress) >= FILES
    got = {r.window_start: r.n for r in sinks.read_upserts(spark, f"{scratch}/out", ["window_start"]).collect()}
    batch = read_events(spark, f"{MEDIUM}/events.parquet")
    want = {r.window_start: r.n for r in window_counts(batch, 60, fill_empty=False).collect()}
    assert got == want


def test_running_total_survives_restart(spark, staged, scratch):
    first = stream_running_total(stream_of(spark, staged))
    q = sinks.sink_total_text(first, f"{scratch}/total", f"{scratch}/cp", available_now=True)
    run(q)
    total1 = max(r.total for r in sinks.read_total_text(spark, f"{scratch}/total").collect())
    assert total1 == 10_000
    # Restart on the same checkpoint (passing the event stream itself): nothing new, no double count.
    run(sinks.sink_total_text(stream_of(spark, staged), f"{scratch}/total", f"{scratch}/cp", available_now=True))
    totals = sinks.read_total_text(spark, f"{scratch}/total").collect()
    assert max(r.total for r in totals) == 10_000
    assert all(r.key == "StreamLength" for r in totals)


def test_json_sink_latest_and_append(spark, staged, scratch):
    run(sinks.sink_json(stream_of(spark, staged), f"{scratch}/latest", f"{scratch}/cp1", mode="latest",
                        available_now=True))
    latest = spark.read.parquet(f"{scratch}/latest")
    assert latest.columns == ["value"] and 0 < latest.count() < 10_000   # only the last batch is kept
    run(sinks.sink_json(stream_of(spark, staged), f"{scratch}/append", f"{scratch}/cp2", mode="append",
                        available_now=True))
    appended = spark.read.parquet(f"{scratch}/append")
    assert appended.count() == 10_000 and appended.select("batch_id").distinct().count() >= FILES
    # Replaying a batch id rewrites that batch only.
    one = spark.read.parquet(f"{staged}/part-000.parquet")
    writer = sinks.json_writer(f"{scratch}/append", "append")
    writer(read_events(spark, f"{staged}/part-000.parquet"), 0)
    assert spark.read.parquet(f"{scratch}/append").filter("batch_id = 0").count() == one.count()
    sample = encode_json(decode_payload(read_events(spark, f"{staged}/part-000.parquet"))).first().value
    assert sample.startswith('{"EventDetails":"{')


def test_parquet_sink_partitions_by_date(spark, staged, scratch):
    run(sinks.sink_parquet(stream_of(spark, staged), f"{scratch}/out", f"{scratch}/cp", available_now=True))
    back = spark.read.parquet(f"{scratch}/out")
    assert back.count() == 10_000
    assert back.select("enqueued_date").distinct().count() == 30
    dirs = [d for d in os.listdir(f"{scratch}/out") if d.startswith("enqueued_date=")]
    assert len(dirs) == 30
    # Restarting on the same checkpoint adds nothing: the file sink's log makes it exactly-once.
    run(sinks.sink_parquet(stream_of(spark, staged), f"{scratch}/out", f"{scratch}/cp", available_now=True))
    assert spark.read.parquet(f"{scratch}/out").count() == 10_000


def test_table_sink_is_idempotent(spark, staged, scratch):
    table = "evlog_test_table"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    run(sinks.sink_table(stream_of(spark, staged), table, f"{scratch}/cp", location=f"{scratch}/t",
                         available_now=True))
    assert spark.table(table).count() == 10_000
    writer = sinks.table_writer(table)
    writer(read_events(spark, f"{staged}/part-000.parquet"), 0)     # replay of batch 0
    assert spark.table(table).count() == 10_000
    assert spark.table(table).columns == ["EventContent", "batch_id"]
    plain = "evlog_test_plain"
    spark.sql(f"DROP TABLE IF EXISTS {plain}")
    sinks.ensure_table(spark, plain, f"{scratch}/p", idempotent=False)
    sinks.table_writer(plain, idempotent=False)(read_events(spark, f"{staged}/part-000.parquet"), 0)
    assert spark.table(plain).columns == ["EventContent"]


def test_stream_union_of_hubs(spark, staged, scratch):
    hubs = {t: stream_of(spark, staged, hub=t).filter(F.col("partitionKey") == t) for t in ("click", "view")}
    run(sinks.sink_parquet(union_hubs(hubs), f"{scratch}/out", f"{scratch}/cp", available_now=True))
    got = {r.hub: r.c for r in spark.read.parquet(f"{scratch}/out").groupBy("hub").agg(F.count("*").alias("c")).collect()}
    raw = {r.event_type: r.c for r in spark.read.parquet(f"{MEDIUM}/events.parquet").groupBy("event_type")
           .agg(F.count("*").alias("c")).collect()}
    assert got == {"click": raw["click"], "view": raw["view"]}


def test_jobs_run_to_completion(spark, staged, scratch):
    cfg = JobConfig(source=staged, checkpoint=f"{scratch}/count", interval_seconds=60, available_now=True,
                    max_files_per_trigger=1, file_glob="part-*.parquet")
    count_job(spark, cfg, f"{scratch}/count-total")
    assert max(r.total for r in sinks.read_total_text(spark, f"{scratch}/count-total").collect()) == 10_000
    counts = job_counts(spark, cfg)
    assert counts.agg(F.sum("n")).first()[0] == 10_000
    cfg2 = JobConfig(source=staged, checkpoint=f"{scratch}/json", interval_seconds=60, available_now=True,
                     file_glob="part-*.parquet")
    json_job(spark, cfg2, f"{scratch}/json-out", f"{scratch}/json-total", mode="append")
    assert spark.read.parquet(f"{scratch}/json-out").count() == 10_000
    cfg3 = JobConfig(source=staged, checkpoint=f"{scratch}/pq", interval_seconds=60, available_now=True,
                     file_glob="part-*.parquet")
    parquet_job(spark, cfg3, f"{scratch}/pq-out")
    assert spark.read.parquet(f"{scratch}/pq-out").count() == 10_000
    spark.sql("DROP TABLE IF EXISTS evlog_job_table")
    cfg4 = JobConfig(source=staged, checkpoint=f"{scratch}/tb", interval_seconds=60, available_now=True,
                     file_glob="part-*.parquet")
    table_job(spark, cfg4, "evlog_job_table", f"{scratch}/tb-total", location=f"{scratch}/tb-data")
    assert spark.table("evlog_job_table").count() == 10_000
    with pytest.raises(ValueError):
        JobConfig(source=staged, checkpoint=scratch, interval_seconds=0)


def test_jdbc_options():
    assert callable(sinks.jdbc_writer("jdbc:x://h/db", "events", dedupe_key=True))
    opts = sinks.jdbc_options("jdbc:x://h/db", "events", {"user": "u"})
    assert opts["batchsize"] == "1000" and opts["createTableColumnTypes"] == "EventDetails VARCHAR(128)"
    assert opts["dbtable"] == "events" and opts["user"] == "u"
    assert sinks.trigger_args(15) == {"processingTime": "15 seconds"}
    assert sinks.trigger_args(available_now=True) == {"availableNow": True}
    with pytest.raises(ValueError):
        sinks.trigger_args(0)


def test_console_sink_and_timeout_stop(spark, staged, scratch):
    q = sinks.sink_console(stream_running_total(stream_of(spark, staged)), f"{scratch}/cp", output_mode="complete",
                           trigger_seconds=1)
    await_queries([q], timeout_minutes=0.1)       # runs ~6 s, then stops between batches
    assert not q.isActive and q.exception() is None
    assert q.lastProgress["sink"]["description"].startswith("org.apache.spark.sql.execution.streaming")
    assert sum(p["numInputRows"] for p in q.recentProgress) == 10_000


def test_stream_ledger_repeats_idle_partitions(spark, staged, scratch):
    # Partition 3 only has events in the first file (batch 0); partition 7 is expected but never seen.
    stream = stream_of(spark, staged).filter((F.col("partition_id") != 3) | (F.col("seqNumber") < 2500))
    expected = spark.createDataFrame([("hub1", p) for p in (0, 1, 2, 3, 7)], "hub string, partition_id int")
    run(sinks.sink_ledger(stream, f"{scratch}/ledger", f"{scratch}/cp", available_now=True))
    led = sinks.read_ledger(spark, f"{scratch}/ledger", "ns1", expected)
    rows = {(r.batch_ts, r.partition_id): r for r in led.collect()}
    assert sorted({b for b, _ in rows}) == [0, 1, 2, 3]
    assert all((b, p) in rows for b in range(4) for p in (0, 1, 2, 3, 7))
    p3 = [rows[(b, 3)] for b in range(4)]
    assert p3[0].n > 0 and all(r.n == 0 and r.end_seq == p3[0].end_seq for r in p3[1:])
    assert rows[(3, 7)].end_seq == -1 and rows[(3, 7)].end_offset == -1
    # Final positions equal the batch end positions; batch counts add up to the events read.
    from evlog.operators.counts import end_positions
    batch = end_positions(read_events(spark, f"{MEDIUM}/events.parquet").filter(
        (F.col("partition_id") != 3) | (F.col("seqNumber") < 2500)))
    want = {r.partition_id: (r.end_offset, r.end_seq) for r in batch.collect()}
    assert {p: (rows[(3, p)].end_offset, rows[(3, p)].end_seq) for p in want} == want
    assert led.agg(F.sum("n")).first()[0] == batch.agg(F.sum("n")).first()[0]
    # Replaying batch 2 rewrites its folder with the same rows.
    before = sorted(led.filter("batch_ts = 2").collect())
    sinks.ledger_writer(f"{scratch}/ledger")(
        read_events(spark, f"{staged}/part-002.parquet").filter((F.col("partition_id") != 3)), 2)
    assert sorted(sinks.read_ledger(spark, f"{scratch}/ledger", "ns1", expected).filter("batch_ts = 2").collect()) == before


def test_stream_gaps_equal_batch_gaps(spark, staged, scratch):
    from evlog.operators.counts import sequence_gaps

    # Partition 3 is idle in batches 1 and 2, so batch 3 compares with its batch-0 maximum.
    keep = (F.col("partition_id") != 3) | (F.col("seqNumber") < 2500) | (F.col("seqNumber") >= 7500)
    run(sinks.sink_gaps(stream_of(spark, staged).filter(keep), f"{scratch}/g", f"{scratch}/cp", available_now=True))
    got = sorted(tuple(r) for r in sinks.read_gaps(spark, f"{scratch}/g").collect())
    env = read_events(spark, f"{MEDIUM}/events.parquet").filter(keep)
    want = sorted(tuple(r) for r in sequence_gaps(env, F.floor(F.col("seqNumber") / 2500).cast("long")).collect())
    assert got == want
    p3 = [r for r in got if r[1] == 3]
    assert [r[2] for r in p3] == [0, 3]


def test_counts_survive_a_mid_stream_restart(spark, staged, scratch):
    import time

    def start(**trigger):
        return sinks.sink_upserts(stream_window_counts(stream_of(spark, staged), 60), f"{scratch}/out",
                                  f"{scratch}/cp", **trigger)

    q = start(trigger_seconds=1)
    deadline = time.monotonic() + 120
    while (q.lastProgress is None or q.lastProgress["batchId"] < 1) and time.monotonic() < deadline:
        time.sleep(0.2)
    q.stop()                                     # stopped part-way: some files are still unread
    run(start(available_now=True))               # restart from the checkpoint
    got = {r.window_start: r.n for r in sinks.read_upserts(spark, f"{scratch}/out", ["window_start"]).collect()}
    batch = read_events(spark, f"{MEDIUM}/events.parquet")
    assert got == {r.window_start: r.n for r in window_counts(batch, 60, fill_empty=False).collect()}


def test_cli_runs_jobs(spark, staged, scratch):
    from evlog.cli import main, parser

    common = ["--source", staged, "--file-glob", "part-*.parquet", "--available-now", "--interval", "60"]
    main(["count", "--checkpoint", f"{scratch}/c", "--total-prefix", f"{scratch}/total", *common], spark)
    assert max(r.total for r in sinks.read_total_text(spark, f"{scratch}/total").collect()) == 10_000
    main(["parquet", "--checkpoint", f"{scratch}/p", "--out", f"{scratch}/pq", *common], spark)
    assert spark.read.parquet(f"{scratch}/pq").count() == 10_000
    args = parser().parse_args(["jdbc", "--source", "s", "--checkpoint", "c", "--total-prefix", "t",
                                "--url", "jdbc:x://h/db", "--jdbc-table", "events", "--dedupe-key"])
    assert args.dedupe_key and args.jdbc_table == "events" and args.interval == 10
    with pytest.raises(SystemExit):
        parser().parse_args(["count", "--source", "s"])


def test_stream_counts_and_lateness(spark, scratch, tmp_path):
    import datetime

    from evlog.schema import EVENTS_SCHEMA

    def land(name, seconds, first_id, mtime):
        rows = [(first_id + i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s), 1, "click", 1.0, "{}")
                for i, s in enumerate(seconds)]
        spark.createDataFrame(rows, EVENTS_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/w-{name}")
        (src,) = [f for f in os.listdir(f"{tmp_path}/w-{name}") if f.endswith(".parquet")]
        os.makedirs(f"{tmp_path}/log", exist_ok=True)
        os.link(f"{tmp_path}/w-{name}/{src}", f"{tmp_path}/log/{name}.parquet")
        os.utime(f"{tmp_path}/log/{name}.parquet", (mtime, mtime))

    land("a", [7200, 7210, 7270], 0, 1_000_000)      # 02:00 - 02:01
    land("b", [10, 20], 10, 1_000_001)               # two hours late
    results = {}
    for wm in (60, 86400):
        base = f"{scratch}/wm{wm}"
        stream = read_events(spark, f"{tmp_path}/log", streaming=True, file_glob="*.parquet", max_files_per_trigger=1)
        q = run(sinks.sink_upserts(stream_window_counts(stream, 60, watermark_seconds=wm), f"{base}/out",
                                   f"{base}/cp", available_now=True))
        results[wm] = (q, {r.window_start - 1704067200: r.n
                           for r in sinks.read_upserts(spark, f"{base}/out", ["window_start"]).collect()})
    # Within the watermark, late events are always counted.
    assert results[86400][1] == {0: 2, 7200: 2, 7260: 1}
    # Beyond it Spark may or may not count them; on-time windows are exact either way.
    late_q, late = results[60]
    assert {k: v for k, v in late.items() if k >= 7200} == {7200: 2, 7260: 1} and late.get(0) in (None, 2)
    # The short watermark keeps the state small: finished windows are dropped.
    assert late_q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def land(spark, folder, name, rows, mtime):
    """rows: (event_id, seconds)."""
    import datetime

    from evlog.schema import EVENTS_SCHEMA

    data = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s), 1, "click", 1.0, "{}") for i, s in rows]
    spark.createDataFrame(data, EVENTS_SCHEMA).coalesce(1).write.parquet(f"{folder}/w-{name}")
    (src,) = [f for f in os.listdir(f"{folder}/w-{name}") if f.endswith(".parquet")]
    os.makedirs(f"{folder}/log", exist_ok=True)
    os.link(f"{folder}/w-{name}/{src}", f"{folder}/log/{name}.parquet")
    os.utime(f"{folder}/log/{name}.parquet", (mtime, mtime))


def test_counts_lose_no_late_event(spark, scratch, tmp_path):
    """Seven events in three files, the oldest last: windows and total agree."""
    land(spark, tmp_path, "a", [(4, 7200), (5, 7210), (6, 7270)], 1_000_000)
    land(spark, tmp_path, "b", [(2, 3600), (3, 3601)], 1_000_001)
    land(spark, tmp_path, "c", [(0, 0), (1, 59)], 1_000_002)
    cfg = JobConfig(source=f"{tmp_path}/log", checkpoint=f"{scratch}/job", interval_seconds=60, available_now=True, max_files_per_trigger=1)
    count_job(spark, cfg, f"{scratch}/total")
    counts = {r.window_start - 1704067200: r.n for r in job_counts(spark, cfg).collect()}
    assert counts == {0: 2, 3600: 2, 7200: 2, 7260: 1}
    assert sorted(r.total for r in sinks.read_total_text(spark, f"{scratch}/total").collect()) == [3, 5, 7]
    # Without a watermark the state store loses none either.
    stream = read_events(spark, f"{tmp_path}/log", streaming=True, max_files_per_trigger=1)
    run(sinks.sink_upserts(stream_window_counts(stream, 60), f"{scratch}/s", f"{scratch}/scp", available_now=True))
    assert sum(r.n for r in sinks.read_upserts(spark, f"{scratch}/s", ["window_start"]).collect()) == 7


def test_timeout_stops_every_query(spark, staged, scratch):
    queries = [sinks.sink_console(stream_running_total(stream_of(spark, staged)), f"{scratch}/cp{i}", output_mode="complete", trigger_seconds=1)
               for i in range(2)]
    await_queries(queries, timeout_minutes=0.05)
    assert not any(q.isActive for q in queries) and all(q.exception() is None for q in queries)
    cfg = JobConfig(source=staged, checkpoint=f"{scratch}/job", interval_seconds=60, available_now=True, file_glob="part-*.parquet",
                    max_files_per_trigger=1, timeout_minutes=0.0)
    assert not any(q.isActive for q in count_job(spark, cfg, f"{scratch}/total"))


def test_a_failing_query_stops_the_others(spark, staged, scratch):
    from pyspark.errors import StreamingQueryException

    def fail(batch, batch_id):
        raise ValueError("broken sink")

    stream = stream_of(spark, staged)
    good = sinks.sink_console(stream_running_total(stream), f"{scratch}/good", output_mode="complete", trigger_seconds=1)
    bad = sinks.sink_all(stream, [fail], f"{scratch}/bad", trigger_seconds=1)
    with pytest.raises(StreamingQueryException):
        await_queries([good, bad])
    assert not good.isActive and not bad.isActive


def test_start_points_hubs_and_properties_of_jobs(spark, staged, scratch):
    stream = read_stream(spark, JobConfig(source=staged, checkpoint=scratch, after_offset=64 * 9000, file_glob="part-*.parquet"))
    run(sinks.sink_parquet(stream, f"{scratch}/late", f"{scratch}/cp-late", available_now=True))
    assert spark.read.parquet(f"{scratch}/late").agg(F.min("seqNumber"), F.count("*")).first()[:] == (9001, 999)
    hubs = {"a": {"source": staged, "num_partitions": 2}, "b": {"source": staged, "num_partitions": 3}}
    stream = read_stream(spark, JobConfig(hubs=hubs, checkpoint=scratch, file_glob="part-*.parquet", properties=["k"]))
    run(sinks.sink_parquet(stream, f"{scratch}/hubs", f"{scratch}/cp-hubs", available_now=True))
    got = {(r.hub, r.partition_id) for r in spark.read.parquet(f"{scratch}/hubs").select("hub", "partition_id").distinct().collect()}
    assert got == {("a", 0), ("a", 1), ("b", 0), ("b", 1), ("b", 2)} and "k" in stream.columns
    # Streamed back as an envelope log, from a time on.
    again = read_stream(spark, JobConfig(source=f"{scratch}/late", checkpoint=scratch, layout="envelope", after_time=0))
    run(sinks.sink_parquet(again, f"{scratch}/again", f"{scratch}/cp-again", available_now=True))
    assert spark.read.parquet(f"{scratch}/again").filter("body IS NOT NULL AND offset > 0").count() == 999
    with pytest.raises(ValueError):
        JobConfig(checkpoint=scratch)


def test_kafka_and_jdbc_options():
    from evlog.sources.events import kafka_options

    assert kafka_options({"subscribe": "t"}, 500, headers=True) == {"subscribe": "t", "maxOffsetsPerTrigger": "500", "includeHeaders": "true"}
    assert sinks.jdbc_options("u", "t", payload_type="VARCHAR(4000)")["createTableColumnTypes"] == "EventDetails VARCHAR(4000)"
    with pytest.raises(ValueError):
        kafka_options({}, 0)
