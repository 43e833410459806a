"""Property tests: operators against plain-Python brute force on random input."""

from __future__ import annotations

from collections import Counter

import pytest
from conftest import envelope_rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from evlog.operators.counts import sequence_gaps, window_counts
from evlog.operators.ledger import parse_ledger

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.fixture()
def small_blocks(monkeypatch):
    """Blocks of two batches, so that carries across blocks are exercised."""
    from evlog.operators import ordered

    monkeypatch.setattr(ordered, "ORDER_BLOCK", 2)


def java_split_space(line: str) -> list[str]:
    parts = line.split(" ")
    while parts and parts[-1] == "":
        parts.pop()
    return parts if parts or line == "" else []


def java_long(text: str, bits: int):
    body = text[1:] if text[:1] in "+-" else text
    if not body or not all("0" <= c <= "9" for c in body):
        return None
    v = int(text)
    return v if -(2 ** (bits - 1)) <= v < 2 ** (bits - 1) else None


def brute_parse(line: str):
    parts = java_split_space(line)
    if len(line) == 0:
        parts = [""]
    if len(parts) != 6:
        return None
    ts, off, seq = java_long(parts[0], 64), java_long(parts[4], 64), java_long(parts[5], 64)
    pid = java_long(parts[3], 32)
    if None in (ts, pid, off, seq):
        return None
    return (ts, parts[1], parts[2], pid, off, seq)


token = st.one_of(st.sampled_from(["1", "-1", "+7", "12a", "", "99999999999", "3000000000", "x", "ns1", "h"]),
                  st.integers(-10**12, 10**12).map(str))
line = st.lists(token, min_size=0, max_size=8).map(" ".join) | st.text(alphabet=" 0123456789ab", max_size=20)


@SETTINGS
@given(st.lists(line, min_size=1, max_size=30))
def test_parse_ledger_matches_java_split_rules(spark, lines):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i long, value string")
    got = {r.i: r for r in parse_ledger(df, keep=["i"]).collect()}
    for i, s in enumerate(lines):
        want = brute_parse(s)
        r = got[i]
        if want is None:
            assert not r.is_valid, s
        else:
            assert r.is_valid, s
            assert (r.batch_ts, r.uid, r.hub, r.partition_id, r.end_offset, r.end_seq) == want


@SETTINGS
@given(st.lists(st.integers(0, 2000), min_size=1, max_size=60), st.sampled_from([1, 7, 60, 600]))
def test_window_counts_brute_force(spark, times, interval):
    env = envelope_rows(spark, [("h", 0, "x", i, i, t) for i, t in enumerate(times)])
    got = {r.window_start: r.n for r in window_counts(env, interval).collect()}
    hits = Counter(t - t % interval for t in times)
    lo, hi = min(hits), max(hits)
    want = {w: hits.get(w, 0) for w in range(lo, hi + 1, interval)}
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 50), st.integers(0, 4), st.booleans()),
                min_size=1, max_size=60, unique_by=lambda x: (x[0], x[1])))
def test_sequence_gaps_brute_force(spark, small_blocks, events):
    rows = [("h", p, "x" if full else "", s * 3, s, b) for p, s, b, full in events]
    got = {(r.partition_id, r.batch_ts): (r.n, r.min_seq, r.max_seq, r.missing, r.discontinuity)
           for r in sequence_gaps(envelope_rows(spark, rows), "enqueuedTime").collect()}
    want = {}
    for p in {e[0] for e in events}:
        prev = 0
        for b in sorted({e[2] for e in events if e[0] == p}):
            cell = [e for e in events if e[0] == p and e[2] == b]
            seqs = [e[1] for e in cell]
            n = sum(1 for e in cell if e[3])
            want[(p, b)] = (n, min(seqs), max(seqs), max(seqs) - min(seqs) - n + 1, min(seqs) - (prev + 1))
            prev = max(seqs)
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 6)), min_size=1, max_size=40))
def test_ledger_rows_brute_force(spark, small_blocks, cells):
    from evlog.operators.ledger import ledger_rows

    # seq numbers increase with the batch, as in a log; offsets are seq * 10.
    rows = [("h", p, "x", i * 10, i, b) for i, (p, b) in enumerate(sorted(cells, key=lambda c: c[1]))]
    got = {(r.batch_ts, r.partition_id): (r.end_offset, r.end_seq, r.n)
           for r in ledger_rows(envelope_rows(spark, rows), "enqueuedTime", "u").collect()}
    lo, hi = min(r[5] for r in rows), max(r[5] for r in rows)
    want = {}
    for p in {r[1] for r in rows}:
        pos = (-1, -1)
        for b in range(lo, hi + 1):
            mine = [r for r in rows if r[1] == p and r[5] == b]
            if mine:
                top = max(mine, key=lambda r: r[4])
                pos = (top[3], top[4])
            want[(b, p)] = (pos[0], pos[1], len(mine))
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40)), min_size=1, max_size=60,
                unique_by=lambda x: x), st.dictionaries(st.integers(0, 2), st.integers(-1, 30), max_size=3),
       st.integers(1, 15))
def test_slice_ranges_brute_force(spark, events, starts, rate):
    from evlog.sources.positions import slice_ranges

    env = envelope_rows(spark, [("h", p, "x", s, s, 0) for p, s in events])
    pos = spark.createDataFrame([("h", p, s) for p, s in starts.items()] or [("h", 99, 0)],
                                "hub string, partition_id int, end_seq long")
    got = sorted((r.partition_id, r.seqNumber) for r in slice_ranges(env, pos, max_rate=rate).collect())
    want = []
    for p in {p for p, _ in events}:
        start = starts.get(p, -1)                # no position: from the start of the log
        seqs = [s for q, s in events if q == p]
        until = min(max(seqs), start + rate)
        want += [(p, s) for s in seqs if start < s <= until]
    assert got == sorted(want)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-5, 20), st.one_of(st.none(), st.integers(0, 99))),
                min_size=1, max_size=40, unique_by=lambda x: (x[0], x[1])), st.integers(1, 3))
def test_ordered_helpers_brute_force(spark, rows, block):
    from evlog.operators.ordered import fill_forward, with_previous

    df = spark.createDataFrame(rows, "k int, b long, v long")
    prev = {(r.k, r.b): r.prev_v for r in with_previous(df, ["k"], "b", ["v"], block=block).collect()}
    filled = {(r.k, r.b): r.v for r in fill_forward(df, ["k"], "b", ["v"], block=block).collect()}
    for k in {r[0] for r in rows}:
        mine = sorted((b, v) for kk, b, v in rows if kk == k)
        last = None
        for i, (b, v) in enumerate(mine):
            assert prev[(k, b)] == (mine[i - 1][1] if i else None)
            last = v if v is not None else last
            assert filled[(k, b)] == last
