"""Job options: saved positions, a read cap for each hub, stored properties, and errors for options without effect."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from test_live import land

from evlog.cli import _hub
from evlog.operators.ledger import save_ledger
from evlog.schema import LEDGER_SCHEMA
from evlog.sources.events import kafka_start, read_events, save_log
from evlog.streaming import sinks
from evlog.streaming.jobs import JobConfig, parquet_job, read_stream, start_positions


def seqs(spark, path):
    return sorted((r.hub, r.partition_id, r.seqNumber) for r in spark.read.parquet(path).select("hub", "partition_id", "seqNumber").collect())


def ledger(spark, path, rows):
    save_ledger(spark.createDataFrame(rows, LEDGER_SCHEMA), path)


def test_a_job_starts_from_saved_positions_once(spark, scratch, tmp_path):
    """Partition 0 goes on after event 4, partition 1 has no position and takes the other start option. A newer ledger doesn't move
    the start of a job that has begun."""
    land(spark, tmp_path, 0, [(i, i % 2, i) for i in range(1, 9)])
    ledger(spark, f"{scratch}/ledger", [(1, "u", "hub1", 0, 2 * 64, 2, 1), (2, "u", "hub1", 0, 4 * 64, 4, 1), (3, "other", "hub1", 1, 64, 1, 1)])
    cfg = JobConfig(source=f"{tmp_path}/log", checkpoint=f"{scratch}/job", available_now=True, ledger=f"{scratch}/ledger", uid="u", after_offset=3 * 64,
                    envelope={"num_partitions": 2})
    parquet_job(spark, cfg, f"{scratch}/out")
    first = [("hub1", 0, 6), ("hub1", 0, 8), ("hub1", 1, 5), ("hub1", 1, 7)]
    assert seqs(spark, f"{scratch}/out") == first
    ledger(spark, f"{scratch}/ledger", [(4, "u", "hub1", 0, 64 * 100, 100, 1)])
    land(spark, tmp_path, 1, [(9, 1, 9), (10, 0, 10)])
    parquet_job(spark, cfg, f"{scratch}/out")
    assert seqs(spark, f"{scratch}/out") == sorted(first + [("hub1", 0, 10), ("hub1", 1, 9)])
    # An older batch by its number, and a reader without rows: everything.
    old = JobConfig(**{**cfg.__dict__, "checkpoint": f"{scratch}/old", "ledger_ts": 1, "after_offset": None})
    assert [tuple(r) for r in start_positions(spark, old).select("partition_id", "end_seq").orderBy("partition_id").collect()] == [(0, 2), (1, -1)]
    none = JobConfig(**{**cfg.__dict__, "checkpoint": f"{scratch}/none", "uid": "nobody", "after_offset": None})
    parquet_job(spark, none, f"{scratch}/all")
    assert len(seqs(spark, f"{scratch}/all")) == 10


def test_the_lowest_position_reaches_the_scan(spark, scratch, tmp_path):
    land(spark, tmp_path, 0, [(i, i % 2, i) for i in range(1, 9)])
    ledger(spark, f"{scratch}/ledger", [(1, "u", "hub1", 0, 4 * 64, 4, 1), (1, "u", "hub1", 1, 5 * 64, 5, 1)])
    for partitions, pushed in ((2, True), (3, False)):
        cfg = JobConfig(source=f"{tmp_path}/log", checkpoint=f"{scratch}/job{partitions}", ledger=f"{scratch}/ledger", uid="u", envelope={"num_partitions": partitions})
        text = read_stream(spark, cfg)._jdf.queryExecution().analyzed().toString()
        assert any("seqNumber" in line and "> cast(4 as bigint)" in line for line in text.splitlines() if "Filter" in line) == pushed, text


def test_each_hub_has_its_own_read_cap(spark, scratch, tmp_path):
    for hub, n in (("a", 4), ("b", 4)):
        for i in range(n):
            land(spark, tmp_path / hub, i, [(10 * i + k, k, i) for k in range(3)])
    hubs = {"a": {"source": f"{tmp_path}/a/log", "num_partitions": 2, "max_files_per_trigger": 1},
            "b": {"source": f"{tmp_path}/b/log", "num_partitions": 3, "max_files_per_trigger": 3}}
    seen = []

    def count(batch, batch_id):
        seen.append({r.hub: r["count"] for r in batch.groupBy("hub").count().collect()})

    q = sinks.sink_all(read_stream(spark, JobConfig(hubs=hubs, checkpoint=scratch)), [count], f"{scratch}/cp", available_now=True)
    q.awaitTermination()
    assert q.exception() is None and seen == [{"a": 3, "b": 9}, {"a": 3, "b": 3}, {"a": 3}, {"a": 3}]


def test_properties_of_a_stored_log(spark, scratch, tmp_path):
    land(spark, tmp_path, 0, [(i, i % 2, i) for i in range(4)])
    raw = spark.read.parquet(f"{tmp_path}/log").withColumn("props", F.concat(F.lit('{"k": "v'), F.col("event_id").cast("string"), F.lit('"}')))
    raw.write.parquet(f"{scratch}/raw")
    save_log(read_events(spark, f"{scratch}/raw", properties=True), f"{scratch}/log")
    for properties, column in ((["k", "none"], "k"), (True, F.col("properties")["k"])):
        found = []
        stream = read_events(spark, f"{scratch}/log", streaming=True, layout="envelope", properties=properties)
        q = sinks.sink_all(stream, [lambda b, i: found.extend(b.select("seqNumber", column).collect())], f"{scratch}/cp{len(str(properties))}", available_now=True)
        q.awaitTermination()
        assert q.exception() is None and sorted(map(tuple, found)) == [(i, f"v{i}") for i in range(4)]
        batch = read_events(spark, f"{scratch}/log", properties=properties)
        assert sorted(map(tuple, batch.select("seqNumber", column).collect())) == [(i, f"v{i}") for i in range(4)]
    assert {r.none for r in read_events(spark, f"{scratch}/log", properties=["none"]).collect()} == {""}
    save_log(read_events(spark, f"{scratch}/raw"), f"{scratch}/bare")
    for properties in (True, ["k"]):
        with pytest.raises(ValueError):
            read_events(spark, f"{scratch}/bare", properties=properties)


@pytest.mark.parametrize("options", [
    {"kafka": {"subscribe": "t"}, "after_offset": 5}, {"kafka": {}, "layout": "envelope"}, {"kafka": {}, "file_glob": "*"},
    {"kafka": {}, "max_files_per_trigger": 1}, {"kafka": {}, "max_bytes_per_trigger": 1}, {"kafka": {}, "envelope": {"hub": "h"}},
    {"source": "x", "max_offsets_per_trigger": 5}, {"source": "x", "uid": "u"}, {"source": "x", "ledger": "l"}, {"source": "x", "ledger_ts": 3},
    {"hubs": {"a": {"source": "x", "typo": 1}}}, {"hubs": {"a": {}}}, {"hubs": {"a": {"source": "x", "max_offsets_per_trigger": 1}}},
    {"hubs": {"a": {"kafka": {}, "num_partitions": 1}}}, {"source": "x", "kafka": {}}, {"source": "x", "envelope": {"properties": True}},
    {"hubs": {"a": {"kafka": {"subscribe": "t"}}, "b": {"source": "x"}}, "ledger": "l", "uid": "u"},
])
def test_options_without_effect_are_errors(options):
    with pytest.raises(ValueError):
        JobConfig(checkpoint="c", **options)


def test_read_caps_are_checked(spark, scratch, tmp_path):
    land(spark, tmp_path, 0, [(1, 1, 1)])
    for wrong in ({"max_files_per_trigger": 0}, {"max_files_per_trigger": 1, "max_bytes_per_trigger": 1}):
        with pytest.raises(ValueError):
            read_events(spark, f"{tmp_path}/log", streaming=True, **wrong)
    with pytest.raises(ValueError):
        read_events(spark, f"{tmp_path}/log", max_files_per_trigger=1)
    assert _hub("a:2:hdfs://x/y") == ("a", {"source": "hdfs://x/y", "num_partitions": 2})
    assert _hub("a:2:7:hdfs://x/y") == ("a", {"source": "hdfs://x/y", "num_partitions": 2, "max_files_per_trigger": 7})


def test_kafka_starts(spark, monkeypatch):
    positions = spark.createDataFrame([("t", 0, 41), ("t", 1, -1), ("s", 0, None)], "hub string, partition_id int, end_offset long")
    assert json.loads(kafka_start(positions)["startingOffsets"]) == {"t": {"0": 42, "1": -2}, "s": {"0": -2}}
    from evlog.streaming import jobs

    seen = []
    monkeypatch.setattr(jobs, "read_kafka", lambda spark, options, cap, properties: seen.append((options, cap)))
    read_stream(spark, JobConfig(checkpoint="c", kafka={"subscribe": "t"}, after_time=10, max_offsets_per_trigger=5))
    assert seen == [({"subscribe": "t", "startingTimestamp": "11000"}, 5)]
    with pytest.raises(ValueError):
        read_stream(spark, JobConfig(checkpoint="c", kafka={"subscribe": "t", "startingOffsets": "latest"}, after_time=10))
