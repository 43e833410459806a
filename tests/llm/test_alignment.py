"""Token alignment against a plain one, byte by byte."""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evlog.llm import alignment

TEXTS = ["Dr Anna Novak's token = \"24be64439e\" <|endoftext|> </s>", "", None, "été naïve ﬁ Ａ ß 漢字 🙂🙂", "  two  spaces\t\r\n\n tail ", "a\x00b",
         "▁x in the piece alphabet", "x", " ", "x" * 5000, "the of and the of and " * 300, "é", "the of and the of and " * 300]


def plain(rows):
    """(doc_id, text) -> expected rows, from the libraries' own tokens and sets of bytes."""
    tokenizer = Tokenizer.from_file(alignment.A_PATH)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=alignment.B_PATH)
    letters = alignment.byte_letters()
    names = {i: t for t, i in json.load(open(alignment.A_PATH))["model"]["vocab"].items()}

    def bytes_a(i):
        return bytes(letters[c] for c in names[i])

    def bytes_b(i):
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    out, counts = [], Counter()
    for doc_id, text in rows:
        a = tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids
        b = model.encode(text or "")
        spans = []
        for ids, of in ((a, bytes_a), (b, bytes_b)):
            ends = np.cumsum([len(of(i)) for i in ids]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends)))
        if not text or any(b"".join(map(of, ids)) != (" " + text).encode() for ids, of in ((a, bytes_a), (b, bytes_b))):
            a, b, spans = [], [], [[], []]
        links, at = [], 0
        for i, (s, e) in zip(a, spans[0]):
            while at < len(b) and spans[1][at][1] <= s:
                at += 1
            k = at
            while k < len(b) and spans[1][k][0] < e:
                links.append((i, b[k]))
                k += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        text_of, low = [], 0
        for cut in cuts:
            sides = [[str(i) for i, (s, e) in zip(ids, sp) if low <= s and e <= cut] for ids, sp in zip((a, b), spans)]
            text_of.append("|".join(",".join(x) for x in sides))
            low = cut
        counts.update(links)
        out.append([doc_id, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(text_of).encode()).hexdigest() if a else ""])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(d, na, nb, ng, len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for d, na, nb, ng, ls, sha in out]


@pytest.mark.parametrize("frequent", [1 << 20, 40, 0])
def test_documents_against_plain(spark, frequent):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (3, "one id, two texts"), (3, "one id, two texts")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'clash' AS n_a", "'clash' AS row", "'clash' AS pair")
    found = alignment.align_documents(docs.repartition(3), frequent=frequent)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain(rows)))


def test_no_documents(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only_null = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in alignment.align_documents(only_null).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_bytes_that_are_no_text(spark):
    docs = spark.createDataFrame([(1, bytearray(b"ok \xff\xfe")), (2, bytearray(b"ok"))], "doc_id long, text binary").withColumn("text", alignment.F.expr("CAST(text AS string)"))
    assert [(r.doc_id, r.n_a > 0) for r in alignment.align_documents(docs).orderBy("doc_id").collect()] == [(1, False), (2, True)]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 3000)), st.sets(st.integers(0, 3000)))
def test_gallop_is_a_sorted_search(a, b):
    a, b = (np.array(sorted(x), np.int64) for x in (a, b))
    assert alignment.gallop(a, b).tolist() == np.searchsorted(b, a).tolist()


def test_gallop_over_long_gaps():
    long = np.cumsum(np.random.default_rng(1).integers(1, 5, 200_000))
    short = long[[0, 3, 7, 150_000, 150_001, 199_999]] + [0, 1, 0, 0, 1, 0]
    assert alignment.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()


def test_merged_counts_of_many_documents(monkeypatch):
    monkeypatch.setattr(alignment, "MERGE", 8)
    rng = np.random.default_rng(0)
    docs = [np.unique(rng.integers(0, 30, 5), return_counts=True) for _ in range(50)]
    batch = alignment.pa.RecordBatch.from_pydict({
        "n_pairs": [len(d) for d, _ in docs], "links": [alignment.pack(np.diff(d, prepend=0)) for d, _ in docs],
        "times": [alignment.pack(k) for _, k in docs]})
    found = Counter()
    for out in alignment._count(iter([batch])):
        for p, n in zip(out.column("pair").to_pylist(), out.column("n").to_pylist()):
            found[p] += n
    expected = Counter()
    for d, k in docs:
        for p, n in zip(d.tolist(), k.tolist()):
            expected[p] += n
    assert found == expected


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(open(alignment.A_PATH, "rb").read(), open(alignment.B_PATH, "rb").read())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab s'1.é\n\t\r 　́᠎​﻿\x1c\x85 ▁漢🙂\x00A", max_size=30), min_size=1, max_size=6))
def test_words_give_the_tokens_of_whole_texts(pair, texts):
    given_texts = [t.encode() for t in texts]
    by_word = pair.tokens(given_texts)
    whole = pair._encoded(texts)
    for i, expected in enumerate(whole):
        assert [by_word[side][i].tolist() for side in (0, 1)] == [list(x) for x in expected or ([], [])], texts[i]


def test_forgetting_words_changes_nothing(pair, monkeypatch):
    texts = [" ".join(f"w{i * k % 97}x" for k in range(50)).encode() for i in range(20)]
    expected = [[ids.tolist() for ids in side] for side in pair.tokens(texts)]
    monkeypatch.setattr(alignment, "MAX_WORDS", 10)
    monkeypatch.setattr(alignment, "TOGETHER", 3)
    for i, text in enumerate(texts):
        assert [side[0].tolist() for side in pair.tokens([text])] == [expected[0][i], expected[1][i]]
