from __future__ import annotations

from conftest import SMALL, envelope_rows
from pyspark.sql import functions as F

from evlog.operators.ledger import (batch_report, format_ledger, ledger_as_of, ledger_audit, ledger_batch,
                                    ledger_merge, ledger_retain, ledger_rows, lost_partitions, parse_ledger)
from evlog.schema import LEDGER_SCHEMA

def ledger_df(spark, rows):
    return spark.createDataFrame(rows, LEDGER_SCHEMA)


def test_ledger_rows_repeats_positions_of_idle_partitions(spark):
    # partition 1 has no data in batch 11; partition 2 starts only in batch 12.
    env = envelope_rows(spark, [("h", 0, "x", 100, 0, 10), ("h", 1, "x", 110, 1, 10), ("h", 0, "x", 120, 2, 11),
                                ("h", 0, "x", 130, 3, 12), ("h", 2, "x", 140, 4, 12)])
    got = {(r.batch_ts, r.partition_id): (r.end_offset, r.end_seq, r.n)
           for r in ledger_rows(env, "enqueuedTime", "u").collect()}
    assert len(got) == 9
    assert got[(11, 1)] == (110, 1, 0)        # repeats its old position
    assert got[(10, 2)] == (-1, -1, 0)        # before its first event
    assert got[(12, 2)] == (140, 4, 1)
    assert got[(11, 0)] == (120, 2, 1)
    raw = ledger_rows(env, "enqueuedTime", "u", fill=False)
    assert raw.count() == 5


def test_ledger_rows_with_step_and_expected(spark):
    env = envelope_rows(spark, [("h", 0, "x", 1, 1, 1000), ("h", 0, "x", 2, 2, 3000)])
    expected = spark.createDataFrame([("h", 0), ("h", 5)], "hub string, partition_id int")
    got = ledger_rows(env, "enqueuedTime", "u", batch_step=1000, expected=expected).collect()
    assert sorted((r.batch_ts, r.partition_id, r.end_seq) for r in got) == [
        (1000, 0, 1), (1000, 5, -1), (2000, 0, 1), (2000, 5, -1), (3000, 0, 2), (3000, 5, -1)]


def test_parse_ledger_cases(spark):
    lines = spark.createDataFrame([
        ("19730 ns1 hub1 0 170048 2657",),        # valid
        ("19730 ns1 hub1 0 170048 2657 ",),       # trailing space: still six fields
        ("19730 ns1 hub1 0 170048",),             # five fields
        ("19730 ns1 hub1 0 170048 abc",),         # non-numeric seq
        ("19730 ns1 hub1 3000000000 1 2",),       # partition does not fit an INT
        ("19730  ns1 hub1 0 1 2",),               # double space: seven fields
        ("+5 ns1 hub1 -1 -1 -1",),                # signs are accepted
        ("",),
        (None,),
    ], "value string")
    got = parse_ledger(lines).collect()
    assert [r.is_valid for r in got] == [True, True, False, False, False, False, True, False, False]
    assert got[0].asDict() == {"batch_ts": 19730, "uid": "ns1", "hub": "hub1", "partition_id": 0,
                               "end_offset": 170048, "end_seq": 2657, "is_valid": True}
    assert got[6].batch_ts == 5 and got[6].end_seq == -1
    assert got[2].batch_ts is None


def test_format_parse_round_trip(spark):
    led = ledger_df(spark, [(1, "u", "h", 0, 10, 1, 1), (2, "u", "h", 1, 20, 2, 1)])
    assert format_ledger(led).collect()[0].value == "1 u h 0 10 1"
    back = parse_ledger(format_ledger(led)).drop("is_valid")
    assert sorted(back.collect()) == sorted(led.drop("n").collect())


def _ledger(spark):
    rows = []
    for ts in (10, 20, 30):
        for p in range(2):
            rows.append((ts, "u", "h", p, ts * 10 + p, ts + p, 1))
    rows.append((20, "other", "h", 0, 7, 7, 1))
    return ledger_df(spark, rows)


def test_ledger_as_of(spark):
    led = _ledger(spark)
    got = {r.partition_id: (r.batch_ts, r.end_seq) for r in ledger_as_of(led, "u", 25).collect()}
    assert got == {0: (20, 20), 1: (20, 21)}
    exact = {r.partition_id: (r.batch_ts, r.end_seq) for r in ledger_as_of(led, "u", 25, exact=True).collect()}
    assert exact == {0: (-1, -1), 1: (-1, -1)}
    older = {r.partition_id: (r.batch_ts, r.end_offset, r.end_seq) for r in ledger_as_of(led, "u", 5).collect()}
    assert older == {0: (-1, -1, -1), 1: (-1, -1, -1)}   # T older than every batch
    expected = spark.createDataFrame([("h", 0), ("h", 9)], "hub string, partition_id int")
    with_exp = {r.partition_id: r.end_seq for r in ledger_as_of(led, "u", 30, expected=expected).collect()}
    assert with_exp == {0: 30, 9: -1}


def test_ledger_merge_batch_retain(spark):
    led = _ledger(spark)
    current = ledger_as_of(led, "u", 20)
    update = spark.createDataFrame([("u", "h", 1, 31, 310, 31), ("u", "h", 2, 31, 5, 5)],
                                   "uid string, hub string, partition_id int, batch_ts long, end_offset long, end_seq long")
    merged = {r.partition_id: (r.batch_ts, r.end_seq) for r in ledger_merge(current, update).collect()}
    assert merged == {0: (20, 20), 1: (31, 31), 2: (31, 5)}
    assert sorted((r.uid, r.partition_id) for r in ledger_batch(led, 20).collect()) == [
        ("other", 0), ("u", 0), ("u", 1)]
    kept = sorted({r.batch_ts for r in ledger_retain(led, 25).collect()})
    assert kept == [20, 30]
    assert ledger_retain(led, 5).count() == led.count()     # nothing at or before T: keep all


def test_ledger_audit_and_lost_partitions(spark):
    lines = spark.createDataFrame([
        (1, "1 u h 0 10 1"), (1, "1 u h 1 20 2"),                 # complete
        (2, "2 u h 0 30 3"),                                      # partition 1 missing
        (3, "3 u h 0 40 4"), (3, "4 u h 1 50 5"),                 # two timestamps in one file
        (4, "4 u h 0 60 6"), (4, "4 u h 1 70"),                   # malformed line
    ], "file_ts long, value string")
    records = parse_ledger(lines, keep=["file_ts"])
    expected = spark.createDataFrame([("u", "h", 0), ("u", "h", 1)], "uid string, hub string, partition_id int")
    got = {r.file_ts: r for r in ledger_audit(records, expected, file_col="file_ts").collect()}
    assert got[1].valid and got[1].n_missing == 0
    assert not got[2].valid and got[2].n_missing == 1
    assert not got[3].valid and got[3].n_timestamps == 2
    assert not got[4].valid and got[4].n_malformed == 1 and got[4].n_missing == 1
    led = ledger_df(spark, [(1, "u", "h", 0, 1, 1, 1), (1, "u", "h", 1, 1, 1, 1), (2, "u", "h", 0, 2, 2, 1)])
    assert [(r.uid, r.partition_id) for r in lost_partitions(led, expected).collect()] == [("u", 1)]


def test_batch_report(spark):
    led = ledger_df(spark, [(1, "u", "h", 0, 64, 1, 2), (1, "u", "h", 1, 128, 2, 3),
                            (2, "u", "h", 0, 320, 5, 4), (2, "u", "h", 1, 128, 2, 0)])
    got = {r.batch_ts: r for r in batch_report(led).collect()}
    assert got[1].input_size == (1 + 1) + (2 + 1) and got[1].valid
    assert got[2].input_size == 4
    assert got[1].description == ("eventhub: h-partition-0\tstarting offsets: -1sequenceNumbers: -1 to 1\n"
                                  "eventhub: h-partition-1\tstarting offsets: -1sequenceNumbers: -1 to 2")
    bad = ledger_df(spark, [(1, "u", "h", 0, 64, 9, 1), (2, "u", "h", 0, 64, 3, 1)])
    assert not {r.batch_ts: r.valid for r in batch_report(bad).collect()}[2]


def test_saved_ledger_is_idempotent_and_pruned(spark, scratch):
    import contextlib
    import io

    from evlog.operators.ledger import load_ledger, save_ledger

    path = f"{scratch}/ledger"
    save_ledger(_ledger(spark), path)
    save_ledger(_ledger(spark).filter("batch_ts = 20"), path)      # rewrite one batch
    back = load_ledger(spark, path)
    assert sorted(back.collect()) == sorted(_ledger(spark).collect())
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        ledger_batch(back, 20).explain(mode="formatted")
    assert "PartitionFilters: [isnotnull(batch_ts" in buf.getvalue() and "= 20)" in buf.getvalue()


def test_fill_of_readers_in_one_pass_shuffles_little(spark, monkeypatch):
    """Both readers' filled ledgers: at most eight shuffles and one scan, checkpointed plans included; no nested-loop join."""
    from evlog.operators import ledger as module
    from evlog.plans import queries as Q

    plans = []

    def recorded(df, keep=module.materialize):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(module, "materialize", recorded)
    env = Q.events(spark, SMALL)
    out = module.readers_ledger(env, {"a": (Q.hour(), 1), "b": (F.floor(Q.hour() / 5) * 5 + 4, 5)})
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    text = "\n".join(plans)
    assert sum("Exchange hashpartitioning" in line or "Exchange SinglePartition" in line for line in text.splitlines()) <= 8
    assert text.count("FileScan parquet") == 1 and "NestedLoop" not in text and "Cartesian" not in text
    plans.clear()
    cells = spark.createDataFrame([("h", 0, 5, 64, 1, 1), ("h", 1, 9, 128, 2, 1)], "hub string, partition_id int, batch_ts long, end_offset long, end_seq long, n long")
    filled = module.fill_cells(module.materialize(cells), "u")
    assert "NestedLoop" not in filled._jdf.queryExecution().executedPlan().toString() and filled.count() == 10
    assert module.fill_cells(cells.limit(0), "u").collect() == []


def test_next_row_in_blocks(spark):
    from evlog.operators.ordered import with_next

    rows = [("a", b) for b in (1, 2, 9, 10, 30, 31)] + [("b", b) for b in (0, 100)] + [("c", 5)]
    df = spark.createDataFrame(rows, "k string, b long")
    want = {("a", 1): 2, ("a", 2): 9, ("a", 9): 10, ("a", 10): 30, ("a", 30): 31, ("a", 31): None, ("b", 0): 100, ("b", 100): None, ("c", 5): None}
    for block in (1, 4, 1000):
        assert {(r.k, r.b): r.next_b for r in with_next(df, ["k"], "b", block=block).collect()} == want


def test_audit_holds_each_reader_against_its_own_partitions(spark):
    rows = [(1, "u", "h", 0, 1, 1, 1), (1, "u", "h", 1, 1, 1, 1), (1, "v", "h", 1, 1, 1, 1), (2, "u", "h", 0, 1, 1, 1), (2, "w", "h", 0, 1, 1, 1)]
    records = spark.createDataFrame(rows, LEDGER_SCHEMA)
    expected = spark.createDataFrame([("u", "h", 0), ("u", "h", 1), ("v", "h", 1)], "uid string, hub string, partition_id int")
    got = {(r.uid, r.batch_ts): (r.n_records, r.n_missing, r.valid) for r in ledger_audit(records, expected).collect()}
    assert got == {("u", 1): (2, 0, True), ("v", 1): (1, 0, True), ("u", 2): (1, 1, False), ("w", 2): (1, 0, True)}  # nothing is expected of w


def test_as_of_for_many_requests(spark):
    """Each request against ledger_as_of: before the first batch, on a batch, between batches, repeated, unknown readers."""
    from evlog.operators.ledger import ledger_as_of_many

    rows = [(b, u, "h", p, b * 64 + p, b, 1) for u, batches in (("u", (2, 4, 9)), ("v", (3,))) for b in batches for p in (0, 1) if (b, p) != (4, 1)]
    saved = spark.createDataFrame(rows, LEDGER_SCHEMA)
    asked = [("u", t) for t in (0, 2, 3, 4, 5, 8, 9, 100)] + [("u", 3), ("v", 2), ("v", 50), ("nobody", 5)]
    got = ledger_as_of_many(saved, spark.createDataFrame(asked, "uid string, ts long")).collect()
    want = []
    for uid, ts in sorted(set(asked)):
        want += [(uid, ts, r.hub, r.partition_id, r.batch_ts, r.end_offset, r.end_seq) for r in ledger_as_of(saved, uid, ts).collect()]
    assert sorted(map(tuple, got)) == sorted(want)
    expected = spark.createDataFrame([("nobody", "h", 7), ("v", "h", 1)], "uid string, hub string, partition_id int")
    got = ledger_as_of_many(saved, spark.createDataFrame(asked, "uid string, ts long"), expected).collect()
    assert sorted(map(tuple, got)) == [("nobody", 5, "h", 7, -1, -1, -1), ("v", 2, "h", 1, -1, -1, -1), ("v", 50, "h", 1, 3, 193, 3)]
    assert ledger_as_of_many(saved.limit(0), spark.createDataFrame(asked, "uid string, ts long")).collect() == []
