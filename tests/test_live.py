"""Counts and gaps written while a stream runs, with zeros, restarts and replayed batches."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from evlog.operators.counts import fill_idle, sequence_gaps
from evlog.schema import EVENTS_SCHEMA
from evlog.sources.events import read_events
from evlog.streaming import live
from evlog.streaming.jobs import JobConfig, count_job, job_counts

DAY = 1704067200  # 2024-01-01


def land(spark, folder, number, rows):
    """A file of events (event_id, user_id, seconds)."""
    data = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s), u, "click", 1.0, "{}") for i, u, s in rows]
    spark.createDataFrame(data, EVENTS_SCHEMA).coalesce(1).write.parquet(f"{folder}/w{number}")
    (src,) = [f for f in os.listdir(f"{folder}/w{number}") if f.endswith(".parquet")]
    os.makedirs(f"{folder}/log", exist_ok=True)
    os.link(f"{folder}/w{number}/{src}", f"{folder}/log/{number}.parquet")
    os.utime(f"{folder}/log/{number}.parquet", (1_000_000 + number, 1_000_000 + number))


FILES = [[(1, 0, 0), (2, 1, 5), (3, 0, 61)], [(5, 0, 400), (6, 1, 410)], [(7, 1, 415), (8, 1, 1000)], [(9, 0, 1001), (10, 1, 2000), (11, 1, 2001)]]


def stream_of(spark, folder):
    return read_events(spark, f"{folder}/log", streaming=True, max_files_per_trigger=1, num_partitions=2)


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def closed(spark, folder, late, step):
    events = read_events(spark, f"{folder}/log", num_partitions=2)
    top = events.agg(F.max("enqueuedTime")).first()[0]
    start = F.col("enqueuedTime") - F.col("enqueuedTime") % step
    return events.filter(start + step <= top - late).withColumn("window_start", start)


def test_zeros_and_gaps_over_a_restart(spark, scratch, tmp_path):
    """The streams run over two files, stop, and go on over two more: the sinks hold what a batch says of the closed intervals."""
    for part in (0, 2):
        for i in (part, part + 1):
            land(spark, tmp_path, i, FILES[i])
        stream = stream_of(spark, tmp_path)
        run(live.sink_live_counts(stream, f"{scratch}/n", f"{scratch}/ncp", 60, 30, available_now=True))
        run(live.sink_live_counts(stream, f"{scratch}/p", f"{scratch}/pcp", 60, 30, by=["partition_id"], available_now=True))
        run(live.sink_live_gaps(stream, f"{scratch}/g", f"{scratch}/gcp", 60, 30, available_now=True))
        events = closed(spark, tmp_path, 30, 60)
        per = events.groupBy("window_start").agg(F.count("*").alias("n"))
        got = sorted(map(tuple, live.read_live(spark, f"{scratch}/n").select("window_start", "n").collect()))
        assert got == sorted(map(tuple, fill_idle(per, 60).collect()))
        assert any(n == 0 for _, n in got) == (part == 2) and len({w for w, _ in got}) == len(got)
        gaps = live.read_live(spark, f"{scratch}/g")
        want = sequence_gaps(events, F.floor(F.col("enqueuedTime") / 60).cast("long"))
        assert sorted(map(tuple, gaps.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
        by = {}
        for r in live.read_live(spark, f"{scratch}/p").collect():
            by.setdefault(r.partition_id, {})[r.window_start] = r.n
        newest = per.agg(F.max("window_start")).first()[0]
        for p in (0, 1):
            mine = {r.window_start: r.n for r in events.filter(F.col("partition_id") == p).groupBy("window_start").agg(F.count("*").alias("n")).collect()}
            assert by[p] == {w: mine.get(w, 0) for w in range(min(mine), newest + 60, 60)}
    assert any(r.discontinuity > 0 for r in gaps.collect())


def test_a_replayed_batch_replaces_its_rows(spark, scratch):
    """The newest batch is written again after a failure, here with the rows that it had and after it had stored what it carries."""
    write = live.live_counts_writer(f"{scratch}/out", 60)
    frames = [spark.createDataFrame(rows, "window_start long, n long") for rows in ([(0, 2), (60, 1)], [(300, 1)], [], [(420, 5)])]
    expected = {0: 2, 60: 1, 120: 0, 180: 0, 240: 0, 300: 1, 360: 0, 420: 5}
    for i, frame in enumerate(frames):
        write(frame, i)
        write(frame, i)
    got = live.read_live(spark, f"{scratch}/out").collect()
    assert {r.window_start: r.n for r in got} == expected and len(got) == len(expected)
    assert sorted(os.listdir(f"{scratch}/out/_carry")) == ["2", "3"]  # older ones are gone
    gaps = live.live_gaps_writer(f"{scratch}/gaps")
    cell = "hub string, partition_id int, batch_ts long, n long, min_seq long, max_seq long"
    for i, rows in enumerate(([("h", 0, 5, 2, 1, 2)], [("h", 0, 9, 1, 5, 5), ("h", 0, 7, 1, 4, 4), (None, None, 7, 1, 3, 3)], [("h", 0, 10, 3, 6, 9)])):
        for _ in range(2):
            gaps(spark.createDataFrame(rows, cell), i)
    got = sorted((r.partition_id, r.batch_ts, r.missing, r.discontinuity) for r in live.read_live(spark, f"{scratch}/gaps").filter("hub IS NOT NULL").collect())
    assert got == [(0, 5, 0, 0), (0, 7, 0, 1), (0, 9, 0, 0), (0, 10, 1, 0)]


def test_long_idle_time_and_empty_stream(spark, scratch):
    write = live.live_counts_writer(f"{scratch}/out", 1, by=["hub"])
    write(spark.createDataFrame([], "hub string, window_start long, n long"), 0)
    write(spark.createDataFrame([("a", 0, 1), (None, 50_000, 2)], "hub string, window_start long, n long"), 1)
    out = live.read_live(spark, f"{scratch}/out")
    assert {r.hub: (r.c, r.s) for r in out.groupBy("hub").agg(F.count("*").alias("c"), F.sum("n").alias("s")).collect()} == {"a": (50_001, 1), None: (1, 2)}


def test_count_job_writes_zeros(spark, scratch, tmp_path):
    for i, rows in enumerate(FILES):
        land(spark, tmp_path, i, rows)
    cfg = JobConfig(source=f"{tmp_path}/log", checkpoint=f"{scratch}/job", interval_seconds=60, available_now=True, max_files_per_trigger=1,
                    watermark_seconds=30, idle_zeros=True)
    count_job(spark, cfg, f"{scratch}/total")
    counts = {r.window_start - DAY: r.n for r in job_counts(spark, cfg).collect()}
    assert counts[0] == 2 and counts[120] == 0 and counts[360] == 2 + 1 and max(counts) == 960
    with pytest.raises(ValueError):
        JobConfig(source="x", checkpoint="y", idle_zeros=True)
