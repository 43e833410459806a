from __future__ import annotations

import random

import pytest
from conftest import MEDIUM, envelope_rows
from pyspark.sql import functions as F

from evlog.functions.payload import count_non_empty, decode_payload, encode_json, key_by_constant, non_empty
from evlog.operators.counts import end_positions, running_total, sequence_gaps, window_counts
from evlog.sources.events import read_events


def test_payload_edge_bodies(spark):
    long_text = "x" * 200
    env = envelope_rows(spark, [("h", 0, b"\xffA", 0, 0, 0), ("h", 0, b"", 1, 1, 0), ("h", 0, "it's", 2, 2, 0),
                                ("h", 0, long_text, 3, 3, 0), ("h", 0, None, 4, 4, 0)])
    text = [r.EventDetails for r in decode_payload(env, keep=["seqNumber"]).orderBy("seqNumber").collect()]
    assert text[0] == "�A"          # lenient about invalid UTF-8
    assert text[1] == "" and text[2] == "it's" and text[3] == long_text and text[4] is None
    js = [r.value for r in encode_json(decode_payload(env.filter("seqNumber = 2"))).collect()]
    assert js == ['{"EventDetails":"it\'s"}']
    assert non_empty(env).count() == 3
    assert env.agg(count_non_empty().alias("c")).first().c == 3
    assert key_by_constant(env).distinct().collect()[0].asDict() == {"key": "StreamLength", "value": 1}


def test_window_counts_fill_idle_intervals(spark):
    env = envelope_rows(spark, [("h", 0, "a", 0, 0, 100), ("h", 0, "a", 1, 1, 119), ("h", 0, "a", 2, 2, 185)])
    got = {r.window_start: r.n for r in window_counts(env, 60).collect()}
    assert got == {60: 2, 120: 0, 180: 1}
    assert {r.window_start: r.n for r in window_counts(env, 60, fill_empty=False).collect()} == {60: 2, 180: 1}
    wide = {r.window_start: r.n for r in window_counts(env, 60, start=0, end=300).collect()}
    assert wide == {0: 0, 60: 2, 120: 0, 180: 1, 240: 0, 300: 0}
    assert window_counts(env.limit(0), 60).count() == 0
    with pytest.raises(ValueError):
        window_counts(env, 0)


def test_window_spine_spans_many_blocks(spark):
    # 10,000 one-second windows: several spine blocks of 4096.
    env = envelope_rows(spark, [("h", 0, "a", 0, 0, 5), ("h", 0, "a", 1, 1, 10_004)])
    got = window_counts(env, 1)
    assert got.count() == 10_000
    assert got.agg(F.sum("n")).first()[0] == 2


def test_running_total_matches_one_level_prefix(spark):
    rnd = random.Random(7)
    times = [rnd.randrange(0, 5 * 86400) for _ in range(3000)]
    env = envelope_rows(spark, [("h", 0, "a", i, i, t) for i, t in enumerate(times)])
    got = running_total(window_counts(env, 600), block_seconds=86400).orderBy("window_start").collect()
    total = 0
    for r in got:
        total += r.n
        assert r.total == total
    assert total == 3000


def test_sequence_gaps(spark):
    # partition 0: batch 1 has 0,1,2,5 (two missing), batch 2 starts at 9 after max 5.
    rows = [("h", 0, "x", s, s, 1) for s in (0, 1, 2, 5)] + [("h", 0, "x", s, s, 2) for s in (9, 10)]
    rows += [("h", 1, "", 3, 3, 1), ("h", 1, "x", 4, 4, 1)]  # an empty body counts as missing
    got = {(r.partition_id, r.batch_ts): r for r in sequence_gaps(envelope_rows(spark, rows), "enqueuedTime").collect()}
    a = got[(0, 1)]
    assert (a.n, a.min_seq, a.max_seq, a.missing, a.discontinuity) == (4, 0, 5, 2, -1)
    b = got[(0, 2)]
    assert (b.missing, b.discontinuity) == (0, 3)
    c = got[(1, 1)]
    assert (c.n, c.missing, c.discontinuity) == (1, 1, 2)


def test_end_positions_picks_offset_of_highest_seq(spark):
    rows = [("h", 0, "x", 500, 3, 0), ("h", 0, "x", 900, 2, 0), ("h", 1, "x", 10, 0, 0)]
    got = {r.partition_id: (r.end_offset, r.end_seq, r.n) for r in end_positions(envelope_rows(spark, rows)).collect()}
    assert got == {0: (500, 3, 2), 1: (10, 0, 1)}


def test_window_counts_total_equals_events(spark):
    env = read_events(spark, f"{MEDIUM}/events.parquet")
    assert window_counts(env, 60).agg(F.sum("n")).first()[0] == env.count()


def test_operators_on_empty_input(spark):
    from evlog.operators.ledger import batch_report, ledger_rows
    from evlog.sources.positions import partition_lag, slice_ranges

    env = envelope_rows(spark, [("h", 0, "x", 0, 0, 0)]).limit(0)
    pos = spark.createDataFrame([("h", 0, 5)], "hub string, partition_id int, end_seq long")
    assert window_counts(env, 60).count() == 0
    assert running_total(window_counts(env, 60)).count() == 0
    assert sequence_gaps(env, "enqueuedTime").count() == 0
    assert end_positions(env).count() == 0
    assert ledger_rows(env, "enqueuedTime", "u").count() == 0
    assert batch_report(ledger_rows(env, "enqueuedTime", "u")).count() == 0
    assert slice_ranges(env, pos).count() == 0
    assert partition_lag(env, pos).count() == 0


def test_fill_idle(spark):
    from evlog.operators.counts import fill_idle

    counts = spark.createDataFrame([(60, 2), (240, 1)], "window_start long, n long")
    assert {r.window_start: r.n for r in fill_idle(counts, 60).collect()} == {60: 2, 120: 0, 180: 0, 240: 1}
    wide = {r.window_start: r.n for r in fill_idle(counts, 60, start=0, end=180).collect()}
    assert wide == {0: 0, 60: 2, 120: 0, 180: 0}


def test_running_total_from_events(spark):
    env = envelope_rows(spark, [("h", 0, "a", 0, 0, 100), ("h", 0, "a", 1, 1, 119), ("h", 0, "a", 2, 2, 185)])
    got = [(r.window_start, r.n, r.total) for r in running_total(env, 60).orderBy("window_start").collect()]
    assert got == [(60, 2, 2), (120, 0, 2), (180, 1, 3)]
    with pytest.raises(ValueError):
        running_total(env)
