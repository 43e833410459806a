"""Vector codes against plain k-means over integers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evlog.llm import codes


def plain(vectors, parts, entries, rounds):
    """vectors: integer arrays in the order of their ids. Codes, errors and the last codebooks, by full distance tables in Python integers."""
    width = len(vectors[0]) // parts
    book = [[[int(x) for x in v[p * width:(p + 1) * width]] for v in vectors[:entries]] for p in range(parts)]
    for turn in range(rounds + 1):
        own, error = [], []
        for v in vectors:
            cut = [[int(x) for x in v[p * width:(p + 1) * width]] for p in range(parts)]
            best = [min((sum((a - b) ** 2 for a, b in zip(cut[p], entry)), e) for e, entry in enumerate(book[p])) for p in range(parts)]
            own.append([e for _, e in best])
            error.append(sum(d for d, _ in best))
        if turn == rounds:
            return own, error, book
        for p in range(parts):
            for e in range(len(book[p])):
                mine = [v[p * width:(p + 1) * width] for v, o in zip(vectors, own) if o[p] == e]
                if mine:
                    book[p][e] = [sum(int(m[k]) for m in mine) // len(mine) for k in range(width)]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("groups, rounds", [(1, 6), (4, 6), (16, 3), (3, 0)])
def test_codes_against_plain(spark, groups, rounds):
    rng = np.random.default_rng(7)
    matrix = (rng.normal(size=(300, 24)) * rng.choice([0.01, 0.3, 20], (300, 1))).astype(np.float32)
    matrix[50:90] = matrix[50]  # copies
    matrix[5] = matrix[3]  # equal entries: ties go to the lower index
    ids = rng.permutation(300)
    order = np.argsort(ids)
    rows = [(int(i), v.tolist(), int(i) % 3 if i % 7 else None) for i, v in zip(ids, matrix)]
    frame = rows_of(spark, rows).repartition(5).withColumn("code", F.lit("clash")).withColumn("dim", F.lit("clash"))
    coded, history = codes.compress(frame, parts=3, entries=16, rounds=rounds, groups=groups)
    got = {r.id: r for r in codes.with_label_error(coded).collect()}
    ints = [[math.floor(4096 * float(x)) for x in matrix[j]] for j in order]
    own, error, book = plain(ints, 3, 16, rounds)
    assert history.shape == (rounds + 1, 3, 16, 8) and history[-1].tolist() == book
    assert [got[i].code for i in range(300)] == ["".join(f"{e:02x}" for e in o) for o in own]
    assert [got[i].error for i in range(300)] == error
    sums = {}
    for r in got.values():
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in got.values()) and None in sums


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 5), st.sampled_from([1, 2, 3, 4, 8]), st.sampled_from([1, 50, 4096, 1 << 27]))
def test_bounds_never_skip_the_nearest(seed, rounds, groups, scale):
    """Whatever way the entries move, forth and back too, an assignment by bounds is that of a full table."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-scale, scale + 1, (40, 2, 3))
    history = rng.integers(-scale, scale + 1, (1, 2, 8, 3))
    state = codes.new_state(40, 2, groups)
    for turn in range(rounds + 2):
        state, best, measured = codes.assign(x, state, history)
        table = ((x[:, :, None] - history[-1][None]) ** 2).sum(axis=3)
        assert (state[0] == table.argmin(axis=2)).all() and (best == table.min(axis=2)).all() and measured <= 40 * 2 * 9
        step = rng.integers(-max(1, scale // 20), max(1, scale // 20) + 1, history[-1].shape)
        moved = history[-1] + step if turn % 3 else history[max(0, turn - 2)]
        history = np.concatenate((history, moved[None]))


def test_net_displacement_beats_drift_and_saves_distances():
    """Entries that come back have no net displacement: nothing but the own entries is measured."""
    rng = np.random.default_rng(1)
    x = rng.integers(-2000, 2000, (500, 1, 8))
    first = rng.integers(-2000, 2000, (1, 1, 16, 8))
    state, _, all_measured = codes.assign(x, codes.new_state(500, 1, 16), first)
    away = first + rng.integers(-300, 300, first.shape)
    back = np.concatenate((first, away, first))
    _, _, again = codes.assign(x, state, back)
    assert all_measured == 500 * 17 and again < 500 * 1.05


def test_left_out_and_odd_vectors(spark):
    good = [0.5] * 8
    rows = [(1, good, 1), (2, None, 1), (3, [0.5] * 7 + [None], 1), (4, [0.5] * 7 + [float("nan")], 1), (5, [float("inf")] + [0.5] * 7, 1),
            (6, [0.25] * 16, 2), (7, [], None), (8, [-0.5] * 8, None), (8, [-0.5] * 8, None), (None, [2.0] * 8, 5), (9, good, 1)]
    coded, history = codes.compress(rows_of(spark, rows))
    got = sorted((str(r.id), r.label, r.code, r.error, r.label_error) for r in codes.with_label_error(coded).collect())
    assert history.shape == (7, 8, 5, 1)  # five vectors of the usual length
    zero = "0" * 16
    assert got == sorted([("1", 1, zero, 0, 0), ("9", 1, zero, 0, 0), ("8", None, "01" * 8, 0, 0), ("8", None, "01" * 8, 0, 0), ("None", 5, "04" * 8, 0, 0),
                          ("6", 2, None, None, None), ("7", None, None, None, 0)])


def test_no_vectors_and_errors(spark):
    coded, history = codes.compress(rows_of(spark, [(1, None, 1)]))
    assert codes.with_label_error(coded).collect() == [] and history.shape[0] == 7 and codes.codebook_digest(history[-1]) == codes.hashlib.sha256(b"").hexdigest()
    assert codes.compress(rows_of(spark, []))[0].columns == ["id", "label", "code", "error"]
    only_empty, _ = codes.compress(rows_of(spark, [(1, [], 1), (2, [], 1)]))
    assert [(r.code, r.error) for r in only_empty.collect()] == [("0" * 16, 0)] * 2
    for wrong in ({"entries": 0}, {"entries": 257}, {"rounds": 256}, {"groups": 17}, {"parts": 0}):
        with pytest.raises(ValueError):
            codes.compress(rows_of(spark, []), **wrong)
    with pytest.raises(ValueError):
        codes.compress(rows_of(spark, [(1, [0.5] * 9, 1)]))
    with pytest.raises(Exception, match="beyond the supported"):
        codes.compress(rows_of(spark, [(1, [70_000.0] * 8, 1)]))


def test_wide_components_and_very_frequent_labels(spark):
    """Two- and four-byte rows side by side; one label has most rows."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * (3000 if i % 5 == 0 else 1)).astype(np.float32).tolist(), 1 if i % 10 else i) for i in range(200)]
    coded, history = codes.compress(rows_of(spark, rows).repartition(3))
    ints = [[math.floor(4096 * x) for x in v] for _, v, _ in rows]
    own, error, book = plain(ints, 8, 16, 6)
    got = {r.id: r for r in codes.with_label_error(coded).collect()}
    assert [got[i].error for i in range(200)] == error and history[-1].tolist() == book
    assert got[1].label_error == sum(e for (_, _, label), e in zip(rows, error) if label == 1)
