"""Nulls, empty and very long texts, repeated rows, empty tables and extra columns for every operator and stage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evlog.llm import chat, fingerprint, langid, lm, minmax, mixing, quality, surrogates, warc, wumanber
from evlog.llm.tokens import NOT_SPACE, Words, flat

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = "the of and this that with from is was are to in on at by for an it be as or"


def text_of(i, n=60):
    w = PLAIN.split()
    return " ".join(f"{w[(i * 7 + k * (i + 3)) % len(w)]}{(i + k) % 9}" for k in range(n))


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, text_of(i), "en" if i % 2 else "de", f"s{i % 3}", None) for i in range(1, 40)]
    data += [(2, text_of(2), "de", "s2", None), (None, text_of(50), "en", None, 1), (None, None, None, None, None), (41, None, "en", "s1", 0),
             (42, "", "en", None, 0), (43, " \n\t", "de", "s0", 3), (44, "!!! 123", None, "s0", 7), (45, text_of(45, 60_000), "en", "s1", 9),
             (46, text_of(1), "en", "s1", 9), (47, "x" * 200_000, "en", "s1", 9)]
    frame = spark.createDataFrame(data, SHAPE)
    for name in ("id", "rep", "digest", "hash", "band", "row", "use", "block", "n", "n_entities", "known", "kind", "score", "share"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 40)] + [(None, 1, 0), (3, None, 0), (3, 1, 1), (5, 7, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, text_of(3, 15)), (None, text_of(4, 12)), (2, None), (3, ""), (4, "--")], "item_id long, text string")


OPERATORS = {
    "lm": lambda d, l, i: lm.score(d),
    "wumanber": lambda d, l, i: wumanber.find_windows(d, i),
    "langid": lambda d, l, i: langid.identify(d, langid.fit(d)),
    "minmax": lambda d, l, i: minmax.near_duplicates(d),
    "quality": lambda d, l, i: quality.score(d, quality.fit(d, l)),
    "fingerprint": lambda d, l, i: fingerprint.compare_edits(d),
    "surrogates": lambda d, l, i: surrogates.replace_entities(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(name, rows, labels, items):
    out = OPERATORS[name](rows, labels, items).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in rows.collect())
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    if name not in ("fingerprint", "minmax"):
        assert by[2][0] == by[2][1]  # a repeated row
    if name == "lm":
        assert [by[i][0].n_tokens for i in (41, 42, 43, 45, 47)] == [1, 1, 1, 60_001, 2] and not any(r.held_out for r in by[None])
        assert all(r.score < 0 and r.base_score < 0 for r in out)
    elif name == "wumanber":
        assert [by[i][0].n_words for i in (41, 42, 43, 44, 45, 47)] == [0, 0, 0, 1, 60_000, 1]
        assert by[3][0]["items"] == ["1"] and by[4][0]["items"] == ["null"] and by[3][0].n_hit >= 15
    elif name == "langid":
        assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 for i in (41, 42, 43, 44)) and by[45][0].lang_pred in ("en", "de")
    elif name == "minmax":
        assert {(r.n_shingles, r.component_id, r.kept) for i in (41, 42, 43) for r in by[i]} == {(0, i, True) for i in (41, 42, 43)}
        assert (by[46][0].component_id, by[46][0].kept) == (1, False) and by[2][0] == by[2][1]
        assert all(r.kept and r.component_id is None for r in by[None])
    elif name == "quality":
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    elif name == "fingerprint":
        assert [by[i][0].n_chars for i in (41, 42, 43)] == [0, 0, 3] and by[47][0].n_chars == 200_000
        assert len({by[i][0].fingerprint for i in (41, 42, 43)}) == 1 and all(0 <= r.near_next <= 1 for r in out)
    else:
        assert by[41][0].text is None and by[44][0].text == "!!! 123" and by[44][0].n_entities == 0 and by[45][0].digest == "clash"


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(name, rows, labels, items):
    assert OPERATORS[name](rows.limit(0), labels, items).collect() == []


def test_missing_side_tables(rows, labels, items):
    assert not any(r.contaminated for r in wumanber.find_windows(rows, items.limit(0)).collect())
    assert {r.score for r in quality.score(rows, quality.fit(rows, labels.limit(0))).collect()} == {0.5}
    assert {r.lang_pred for r in langid.identify(rows, langid.fit(rows.limit(0))).collect()} == {"und"}


def test_mixing_edges(rows):
    out = mixing.mix_sources(rows).collect()
    assert {str(r.doc_id) for r in out} == {str(r.doc_id) for r in rows.collect()}
    assert {r.source for r in out} == {"s0", "s1", "s2", None}
    assert mixing.mix_sources(rows.limit(0)).collect() == []
    empty = mixing.mix_sources(rows.filter("doc_id in (41, 42)")).collect()
    assert [(r.doc_id, r.epoch, r.n_tokens, r.weight) for r in sorted(empty, key=lambda r: -r.doc_id)] == [(42, 0, 0, 0.0), (41, 0, 0, 0.0)]


def test_chat_and_archives_without_rows(spark, scratch):
    turns = spark.createDataFrame([], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    assert chat.read_chat(chat.format_chat(turns)).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = f"{scratch}/none"
    assert warc.write_archives(warc.mark_revisits(pages), folder, warc.train_dictionary(pages)) == 0
    assert warc.read_archives(spark, folder).collect() == []


def test_pipeline_stages(spark, rows, labels, items, scratch):
    labels.write.parquet(f"{scratch}/labels.parquet")
    items.write.parquet(f"{scratch}/benchmark.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, rows.limit(0), scratch).collect() == [], name
        out = stage(spark, rows, scratch)
        ids = [r.doc_id for r in out.collect()]
        if i < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        if name != "quality":
            assert {None, 41, 42, 43} <= set(ids)
        if name == "near_duplicates":
            assert 46 not in ids and ids.count(2) == 1 and ids.count(None) == 2
        elif name == "decontamination":
            assert 3 not in ids and 4 not in ids and ids.count(2) == 2


def test_pipeline_against_its_operators(spark, scratch):
    """Each stage's rows on the smallest tables, from plain versions of its decision."""
    from evlog.llm.common import table
    from tests.conftest import SMALL
    from tests.llm.test_brute_force import plain_groups

    docs = table(spark, SMALL, "documents")
    kept = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = {r.doc_id: r for r in kept.collect()}
        path = f"{scratch}/{i}"
        stage(spark, kept, SMALL).write.parquet(path)
        kept = spark.read.parquet(path)
        after = {r.doc_id: r for r in kept.collect()}
        if name == "quality":
            wrong = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
            gone = before.keys() - after.keys()
            assert gone and sum(wrong.get(d) == 1 for d in gone) <= 1 and sum(wrong.get(d) == 0 for d in after) <= 1
        elif name == "near_duplicates":
            assert after.keys() == {d for d, (_, _, _, keep) in plain_groups({d: r.text for d, r in before.items()}).items() if keep}
        elif name == "decontamination":
            hits = {r.doc_id for r in wumanber.find_windows(docs, table(spark, SMALL, "benchmark")).filter("contaminated").collect()}
            assert after.keys() == before.keys() - hits
        else:
            assert after.keys() == before.keys()
            assert all(r.text == before[d].text for d, r in after.items() if not list(surrogates.entities(before[d].text)))
            assert all(c not in r.text for d, r in after.items() for _, _, _, c in surrogates.entities(before[d].text))
        assert all(len(r.text) == r.n_chars for r in after.values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()} == set(after)


def test_pipeline_decides_on_rows(spark, items, scratch, monkeypatch):
    """Rows without an id are not spared, and rows that share one are not dropped for each other."""
    def kept(stage, data):
        out = stage(spark, spark.createDataFrame([(*d, "en", "s", 1) if len(d) == 2 else (*d, "s", 1) for d in data], SHAPE), scratch)
        assert out.columns == corpus_pipeline.COLUMNS
        return sorted(((r.doc_id, r.text, r.lang) for r in out.collect()), key=str)

    a, b, c, e = (text_of(i) for i in (11, 12, 13, 14))
    assert kept(corpus_pipeline.drop_near_duplicates, [(1, a), (None, a), (2, a), (2, b), (3, c, "en"), (3, c, "de"), (3, c, "fr"), (None, e), (None, None)]) == sorted(
        [(1, a, "en"), (2, b, "en"), (3, c, "de"), (None, e, "en"), (None, None, "en")], key=str)
    items.write.parquet(f"{scratch}/benchmark.parquet")
    leak = text_of(3, 15)
    assert kept(corpus_pipeline.drop_contaminated, [(None, leak), (4, leak), (4, a), (None, b), (5, None)]) == sorted(
        [(4, a, "en"), (None, b, "en"), (5, None, "en")], key=str)
    good, bad = "a calm long sentence about the old river " * 9, "!!! 99 $$ BUY BUY " * 20
    features, n = quality.passage_features(*flat(pa.array([good, bad] * 8)), Words(NOT_SPACE))
    model = quality.train(features, n, np.array([1.0, 0.0] * 8))
    monkeypatch.setattr(quality, "fit", lambda *_: model)
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: None)
    assert kept(corpus_pipeline.keep_quality, [(None, bad), (6, bad), (6, good), (None, good)]) == sorted([(6, good, "en"), (None, good, "en")], key=str)
