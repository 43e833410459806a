"""What near-duplicate detection moves: texts and sets that can't match aren't shuffled."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evlog.llm import common, minmax
from tests.llm.test_brute_force import plain_groups

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def joins_shuffle(spark):
    """Broadcasts only where the code asks for them, as on large tables."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in names}
    for k in names:
        spark.conf.set(k, "-1")
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f"{base}/{f}": os.path.getsize(f"{base}/{f}") for folder in folders for base, _, files in os.walk(folder)
            for f in files if f.startswith("shuffle_") and f.endswith(".data")}


def texts_with_copies(n=300, n_words=2000):
    draw = random.Random(7)
    texts = {i: " ".join(f"{draw.getrandbits(36):09x}" for _ in range(n_words)) for i in range(n)}
    for i in range(6):
        texts[n + i] = texts[i]
        texts[n + 10 + i] = texts[20 + i].replace(" ", f" new{i} ", 3)
    return texts


def test_texts_without_copies_stay_where_they_are(joins_shuffle):
    texts = texts_with_copies()
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(i, texts[i], lang, "s", 1) for i in (40, 41) for lang in ("de", "en")]
    rows += [(None, texts[50], "en", "s", 1), (None, "no copy of it", "en", "s", 1), (None, "no copy of it", "en", "s", 1), (None, None, "en", "s", 0)]
    docs = joins_shuffle.createDataFrame(rows, SHAPE).repartition(4)
    kept = {i for i, (_, _, _, own) in plain_groups(texts).items() if own}
    assert len(kept) == len(texts) - 12
    before = shuffle_files(joins_shuffle)
    own = docs.checkpoint()
    dealt = sum(n for f, n in shuffle_files(joins_shuffle).items() if f not in before)
    assert dealt > 5_000_000  # the table itself, dealt out once
    before = shuffle_files(joins_shuffle)
    out = corpus_pipeline.drop_near_duplicates(joins_shuffle, own, "")
    found = out.collect()
    moved = sum(n for f, n in shuffle_files(joins_shuffle).items() if f not in before)
    assert sorted(map(tuple, found), key=str) == sorted(
        [(i, texts[i], "de" if i in (40, 41) else "en", "s", 1 if i in (40, 41) else len(texts[i])) for i in kept]
        + [(None, "no copy of it", "en", "s", 1)] * 2 + [(None, None, "en", "s", 0)], key=str)
    assert moved < 0.6 * dealt


def test_sets_in_no_pair_are_not_moved(joins_shuffle, monkeypatch):
    texts = texts_with_copies()
    docs = joins_shuffle.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4).checkpoint()
    before, files, materialize = shuffle_files(joins_shuffle), {}, minmax.materialize

    def watched(rows):  # Spark may remove a step's files once nothing reads them
        out = materialize(rows)
        files.update(shuffle_files(joins_shuffle))
        return out

    monkeypatch.setattr(minmax, "materialize", watched)
    found = {r.doc_id: tuple(r) for r in minmax.near_duplicates(docs).collect()}
    moved = sum(n for f, n in files.items() if f not in before)
    assert found == plain_groups(texts)
    assert moved < 0.6 * sum(map(len, texts.values()))


@pytest.mark.parametrize(("most", "others"), [(1 << 27, 8_000), (1 << 15, 90_000)])
def test_possible_rows(spark, monkeypatch, most, others):
    """No key is missed, also if the bitmap is much too small for them."""
    monkeypatch.setattr(common, "MAX_BITS", most)
    rows = spark.range(100_000).select(F.expr("nullif(id, 0)").alias("id"), F.expr("nullif(cast(id % 7 AS string), '0')").alias("part"))
    keys = rows.filter("id IS NULL OR id % 10 = 0").select("part", "id")
    marked = common.mark_possible(rows, ["part", "id"], keys)
    assert marked.columns == ["id", "part", "possible"]
    counts = {(r.key, r.possible): r["count"] for r in marked.groupBy(F.expr("id IS NULL OR id % 10 = 0").alias("key"), "possible").count().collect()}
    assert counts[True, True] == 10_000 and (True, False) not in counts
    assert 0 < counts[False, True] < others
    assert common.mark_possible(rows, ["id"], rows.select("id").limit(0)).filter("possible").count() == 0
