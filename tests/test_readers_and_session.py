"""Several readers in one ledger, positions of new partitions, and sessions that keep what the launcher set."""

from __future__ import annotations

import pytest
from conftest import envelope_rows

from evlog import session
from evlog.operators.ledger import ledger_as_of, ledger_retain, load_ledger, lost_partitions, save_ledger
from evlog.schema import LEDGER_SCHEMA
from evlog.sources.events import read_events
from evlog.sources.positions import slice_ranges, start_from


def ledger_of(spark, *rows):
    return spark.createDataFrame([(ts, uid, "h", p, 10 * seq, seq, 1) for ts, uid, p, seq in rows], LEDGER_SCHEMA)


def test_saving_one_reader_keeps_the_other(spark, scratch):
    path = f"{scratch}/ledger"
    first, second = ledger_of(spark, (5, "a", 0, 3), (5, "a", 1, 4)), ledger_of(spark, (5, "007", 0, 9))
    save_ledger(first, path)
    save_ledger(second, path)
    assert sorted(load_ledger(spark, path).collect()) == sorted(first.unionByName(second).collect())
    save_ledger(ledger_of(spark, (5, "a", 0, 7)), path)
    assert sorted((r.uid, r.end_seq) for r in load_ledger(spark, path).collect()) == [("007", 9), ("a", 7)]


def test_each_reader_has_its_own_newest_batch(spark):
    led = ledger_of(spark, (3, "a", 0, 1), (5, "a", 0, 2), (5, "a", 1, 3), (7, "b", 0, 9))
    assert {r.partition_id: (r.batch_ts, r.end_seq) for r in ledger_as_of(led, "a", 9).collect()} == {0: (5, 2), 1: (5, 3)}
    kept = sorted((r.uid, r.batch_ts, r.partition_id) for r in ledger_retain(led, 8).collect())
    assert kept == [("a", 5, 0), ("a", 5, 1), ("b", 7, 0)]
    expected = spark.createDataFrame([(u, "h", p) for u in "abc" for p in (0, 1)], "uid string, hub string, partition_id int")
    assert sorted((r.uid, r.partition_id) for r in lost_partitions(led, expected).collect()) == [("b", 1), ("c", 0), ("c", 1)]


def test_partitions_without_a_position_are_read_from_the_start(spark):
    env = envelope_rows(spark, [("h", p, "x", s * 10, s, s) for p in (0, 1) for s in range(6)])
    positions = spark.createDataFrame([("h", 0, 3)], "hub string, partition_id int, end_seq long")
    got = sorted((r.partition_id, r.seqNumber) for r in slice_ranges(env, positions, max_rate=3).collect())
    assert got == [(0, 4), (0, 5), (1, 0), (1, 1), (1, 2)]
    saved = spark.createDataFrame([("h", 0, 30, 3), ("h", 1, -1, -1)], "hub string, partition_id int, end_offset long, end_seq long")
    for complete in (False, True):
        got = sorted((r.partition_id, r.seqNumber) for r in start_from(env, checkpoint=saved, complete=complete).collect())
        assert got == [(0, 4), (0, 5), *((1, s) for s in range(6))]
    one = saved.filter("partition_id = 0")
    assert start_from(env, checkpoint=one).count() == 8 and start_from(env, checkpoint=one, complete=True).count() == 2
    assert start_from(env, checkpoint=saved.limit(0), complete=True).count() == 0


def test_envelope_log_with_start_bounds(spark, scratch):
    env = envelope_rows(spark, [("h", 0, "x", s * 10, s, 100 + s) for s in range(6)])
    env.write.parquet(f"{scratch}/log")
    assert read_events(spark, f"{scratch}/log", after_offset=20, after_time=104).count() == 1
    assert read_events(spark, f"{scratch}/log", after_offset=20).count() == 3
    with pytest.raises(ValueError):
        read_events(spark, f"{scratch}/log", layout="odd")


def test_a_session_keeps_its_master_and_shuffle_width(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "77")
        again = session.get_session()
        assert again.sparkContext.master == spark.sparkContext.master and again.conf.get("spark.sql.shuffle.partitions") == "77"
        assert session.get_session(shuffle_partitions=5).conf.get("spark.sql.shuffle.partitions") == "5"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
    assert session.is_local(spark)
