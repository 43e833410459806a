"""Zone maps of stored logs, compaction of batch folders and tables, cleaning of the ledger table."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from evlog.operators.ledger import ledger_as_of, ledger_retain
from evlog.operators.ledger_table import clean_ledger, ledger_batches, load_ledger_table, save_ledger_table
from evlog.schema import ENVELOPE_SCHEMA, LEDGER_SCHEMA
from evlog.sources.events import load_log, save_log
from evlog.sources.positions import slice_ranges
from evlog.sources.zones import index_log, latest_positions, load_range, load_zones, stored_slices
from evlog.streaming import compaction, sinks
from evlog.streaming.compaction import compact_batches, compact_table, load_manifest, read_batches


def events(spark, rows):
    """rows: (hub, partition, seq)."""
    return spark.createDataFrame([(h, p, bytearray(b"x"), s * 64, s, s, None, None) for h, p, s in rows], ENVELOPE_SCHEMA)


def log_rows(low, high):
    return [("h", p, s) for p in (0, 1) for s in range(low, high)] + [("g", 0, s) for s in range(low, high)]


def opened(df):
    return len(df.inputFiles())


def test_a_bounded_read_opens_only_matching_files(spark, scratch):
    path = f"{scratch}/log"
    save_log(events(spark, log_rows(0, 100)).coalesce(1).sortWithinPartitions("seqNumber"), path, max_records_per_file=10)
    assert index_log(spark, path) == 30 and index_log(spark, path) == 0
    zones = load_zones(spark, path).filter("hub = 'h' AND partition_id = 1").orderBy("min_seq").collect()
    assert [(z.min_seq, z.max_seq, z.n) for z in zones] == [(10 * i, 10 * i + 9, 10) for i in range(10)]
    bounds = spark.createDataFrame([("h", 0, 19, 39), ("h", 1, 95, 500), ("g", 0, 99, 200)], "hub string, partition_id int, from_seq long, until_seq long")
    near = load_range(spark, path, bounds)
    assert opened(near) == 3 and opened(load_log(spark, path)) == 30
    assert sorted(r.seqNumber for r in near.filter("partition_id = 0").collect()) == list(range(20, 40))
    positions = spark.createDataFrame([("h", 0, 19), ("h", 1, 95)], "hub string, partition_id int, end_seq long")
    whole = slice_ranges(load_log(spark, path), positions, max_rate=12)
    sliced = stored_slices(spark, path, positions, max_rate=12)
    assert opened(sliced) == 5  # 20-31, 96-99, and the unread hub's 0-11
    assert sorted(map(tuple, sliced.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))


def test_files_behind_the_map_are_read_and_gone_ones_forgotten(spark, scratch):
    path = f"{scratch}/log"
    positions = spark.createDataFrame([("h", 0, 15)], "hub string, partition_id int, end_seq long")
    save_log(events(spark, log_rows(0, 20)).coalesce(1), path)
    assert latest_positions(spark, path).count() == 3  # no map yet
    assert sorted(r.seqNumber for r in stored_slices(spark, path, positions).filter("hub = 'h' AND partition_id = 0").collect()) == [16, 17, 18, 19]
    index_log(spark, path)
    save_log(events(spark, log_rows(20, 30)).coalesce(1), path, append=True)
    got = stored_slices(spark, path, positions).filter("hub = 'h' AND partition_id = 0")
    assert sorted(r.seqNumber for r in got.collect()) == list(range(16, 30))
    assert {r.end_seq for r in latest_positions(spark, path).collect()} == {29}
    assert index_log(spark, path) == 3
    for name in os.listdir(f"{path}/hub=g/partition_id=0"):
        os.remove(f"{path}/hub=g/partition_id=0/{name}")
    assert index_log(spark, path) == 0 and load_zones(spark, path).filter("hub = 'g'").count() == 0
    assert load_zones(spark, path).count() == 4 and load_log(spark, path).count() == 60


def test_hubs_with_odd_names(spark, scratch):
    for name in ("a b%/x", "star*[1]"):
        path = f"{scratch}/{len(name)}"
        save_log(events(spark, [(name, 0, s) for s in range(10)] + [("plain", 0, 3)]).coalesce(1).sortWithinPartitions("seqNumber"), path, max_records_per_file=5)
        assert index_log(spark, path) == 3 and index_log(spark, path) == 0
        bounds = spark.createDataFrame([(name, 0, 6, 8)], "hub string, partition_id int, from_seq long, until_seq long")
        near = load_range(spark, path, bounds)
        assert sorted(r.seqNumber for r in near.collect()) == [5, 6, 7, 8, 9] and {r.hub for r in near.collect()} == {name}


def cells(path):
    write = sinks.upsert_writer(path)
    return lambda spark, i, rows=None: write(spark.createDataFrame([(f"k{i % 3}", i)] if rows is None else rows, "k string, v long"), i)


def held(spark, path):
    return sorted((r.batch_id, r.k, r.v) for r in read_batches(spark, path).select("batch_id", "k", "v").collect())


def test_compaction_beside_a_writer(spark, scratch, monkeypatch):
    """Reads are equal before, during and after; the newest batch may be written again; folders go one compaction later."""
    path = f"{scratch}/out"
    write = cells(path)
    for i in range(5):
        write(spark, i)
    expected = [(i, f"k{i % 3}", i) for i in range(5)]
    assert held(spark, path) == expected
    begun = read_batches(spark, path)  # a reader that has planned before the compaction
    during = []
    publish = compaction._publish
    monkeypatch.setattr(compaction, "_publish", lambda *a: (during.append(held(spark, path)), publish(*a)))
    assert compact_batches(spark, path, fan_in=2) == 4 and during == [expected]
    assert held(spark, path) == expected and begun.count() == 5 and os.path.isdir(f"{path}/batch_group=0/batch_id=0")
    write(spark, 4)
    write(spark, 5)
    expected.append((5, "k2", 5))
    assert held(spark, path) == expected
    assert opened(read_batches(spark, path)) < opened(spark.read.parquet(path)) + 4
    assert compact_batches(spark, path, fan_in=2) == 1 and compact_batches(spark, path, fan_in=2) == 0
    assert held(spark, path) == expected
    assert sorted(os.listdir(f"{path}/batch_group=0")) == ["batch_id=5"]
    manifest = load_manifest(spark, path)
    assert [(s.first, s.last, s.level) for s in manifest.segments] == [(0, 4, 1)]
    assert {r.k: r.v for r in sinks.read_upserts(spark, path, ["k"]).collect()} == {"k0": 3, "k1": 4, "k2": 5}


def test_an_interrupted_compaction_changes_nothing(spark, scratch, monkeypatch):
    path = f"{scratch}/out"
    write = cells(path)
    for i in range(4):
        write(spark, i)
    expected = held(spark, path)
    publish = compaction._publish

    def fail(*args):
        raise OSError("lost")

    monkeypatch.setattr(compaction, "_publish", fail)
    with pytest.raises(OSError):
        compact_batches(spark, path)
    assert held(spark, path) == expected and len(os.listdir(f"{path}/_segments")) == 1
    monkeypatch.setattr(compaction, "_publish", publish)
    assert compact_batches(spark, path) == 3 and held(spark, path) == expected and len(os.listdir(f"{path}/_segments")) == 1
    stale = load_manifest(spark, path)
    stale.number = 0
    with pytest.raises(RuntimeError):  # a second compaction with the same number
        publish(spark, path, stale)


def test_compaction_of_empty_and_single_batches(spark, scratch):
    path = f"{scratch}/out"
    write = cells(path)
    write(spark, 0, [])
    assert compact_batches(spark, path) == 0
    write(spark, 1, [])
    write(spark, 2)
    assert compact_batches(spark, path) == 2 and held(spark, path) == [(2, "k2", 2)]
    for wrong in ({"keep": 0}, {"fan_in": 1}):
        with pytest.raises(ValueError):
            compact_batches(spark, path, **wrong)


def test_levels_keep_folders_few(spark, scratch):
    path = f"{scratch}/out"
    write = cells(path)
    for i in range(9):
        write(spark, i)
        compact_batches(spark, path, fan_in=2)
    assert [(s.first, s.last, s.level) for s in load_manifest(spark, path).segments] == [(0, 7, 3)]
    assert held(spark, path) == [(i, f"k{i % 3}", i) for i in range(9)]


def test_table_compaction(spark, scratch):
    table, view = "evlog_compact_t", "evlog_compact_v"
    sinks.ensure_table(spark, table, f"{scratch}/t")
    write = sinks.table_writer(table)
    for i in range(4):
        write(events(spark, [("h", 0, i)]).withColumn("body", F.lit(f"b{i}").cast("binary")), i)

    def rows():
        return sorted(r.EventContent for r in spark.table(view).collect())

    assert compact_table(spark, table, view, fan_in=2) == 3 and rows() == ["b0", "b1", "b2", "b3"]
    write(events(spark, [("h", 0, 3)]).withColumn("body", F.lit("b3").cast("binary")), 3)  # the newest batch again
    write(events(spark, [("h", 0, 4)]).withColumn("body", F.lit("b4").cast("binary")), 4)
    assert rows() == ["b0", "b1", "b2", "b3", "b4"]
    assert compact_table(spark, table, view, fan_in=2) == 1 and compact_table(spark, table, view, fan_in=2) == 0
    assert rows() == ["b0", "b1", "b2", "b3", "b4"]
    assert len(spark.sql(f"SHOW PARTITIONS {table}").collect()) == 2
    spark.sql("CREATE OR REPLACE VIEW evlog_foreign AS SELECT 1 AS x")
    with pytest.raises(ValueError):
        compact_table(spark, table, "evlog_foreign")


def test_cleaning_the_ledger_table(spark, scratch):
    spark.sql(f"CREATE DATABASE evlog_clean LOCATION '{scratch}/db'")
    table = "evlog_clean.ledger"
    rows = [(b, u, "h", p, b * 64, b, 1) for u, batches in (("a'b+c d", (1, 3, 5, 7)), ("late", (6, 8)), ("only", (2,))) for b in batches for p in (0, 1)]
    ledger = spark.createDataFrame(rows, LEDGER_SCHEMA)
    save_ledger_table(ledger, table)
    save_ledger_table(ledger.filter("batch_ts > 6"), table)  # again: replaced, not doubled
    assert load_ledger_table(spark, table).count() == len(rows) and ledger_batches(spark, table).count() == 7
    before = {(u, t): sorted(map(tuple, ledger_as_of(load_ledger_table(spark, table), u, t).collect())) for u in ("a'b+c d", "late", "only") for t in (5, 6, 7, 9)}
    want = sorted(map(tuple, ledger_retain(ledger, 5).collect()))
    assert clean_ledger(spark, table, 5) == 2 and clean_ledger(spark, table, 5) == 0
    assert sorted(map(tuple, load_ledger_table(spark, table).collect())) == want
    for (u, t), rows_before in before.items():
        assert sorted(map(tuple, ledger_as_of(load_ledger_table(spark, table), u, t).collect())) == rows_before
    folders = sorted(os.path.basename(d) for d, _, files in os.walk(f"{scratch}/db") if any(f.endswith(".parquet") for f in files))
    assert folders == sorted(["batch_ts=5", "batch_ts=7", "batch_ts=6", "batch_ts=8", "batch_ts=2"])
    spark.sql(f"CREATE TABLE evlog_clean.outside (n BIGINT, uid STRING, batch_ts BIGINT) USING parquet PARTITIONED BY (uid, batch_ts) LOCATION '{scratch}/o'")
    with pytest.raises(ValueError):
        clean_ledger(spark, "evlog_clean.outside", 5)


def test_upkeep_from_the_command_line(spark, scratch):
    from evlog.cli import main

    write = cells(f"{scratch}/out")
    for i in range(3):
        write(spark, i)
    assert main(["compact", "--path", f"{scratch}/out"], spark) == 2 and len(held(spark, f"{scratch}/out")) == 3
    save_log(events(spark, log_rows(0, 5)).coalesce(1), f"{scratch}/log")
    assert main(["index", "--path", f"{scratch}/log"], spark) == 3
    spark.sql(f"CREATE DATABASE evlog_cli LOCATION '{scratch}/db'")
    save_ledger_table(spark.createDataFrame([(b, "u", "h", 0, b, b, 1) for b in (1, 2, 3)], LEDGER_SCHEMA), "evlog_cli.ledger")
    assert main(["clean", "--table", "evlog_cli.ledger", "--ts", "2"], spark) == 1
    with pytest.raises(SystemExit):
        main(["compact", "--table", "t"], spark)
