"""Each operator against a plain Python version over the smallest tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import pytest

from evlog.llm import chat, fingerprint, lm, minmax, mixing, warc, wumanber
from evlog.llm.common import table
from evlog.llm.queries import QUERIES
from tests.conftest import SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def run(spark, name):
    return {r[0]: r for r in QUERIES[name](spark, SMALL).collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}


def plain_scores(texts, order):
    """doc_id -> (n_tokens, n_known, train tokens, base, score) by the definition, with EM over single held-out tokens."""
    tokens = {i: [*words(t), "\n"] for i, t in texts.items()}

    def grams(ts):
        padded = ["\t"] * (order - 1) + ts
        return [[tuple(padded[i + order - k:i + order]) for k in range(1, order + 1)] for i in range(len(ts))]

    def count(ids):
        c = collections.Counter(g for i in ids for at in grams(tokens[i]) for g in at)
        for k in range(1, order):
            c[("\t",) * k] = len(ids)
        return c, sum(len(tokens[i]) for i in ids)

    train = [i for i in tokens if crc(i, 7) != 2]
    c_all, n_all = count(train)
    c_fit, n_fit = count([i for i in train if crc(i, 7) != 3])
    vocabulary = [len({g for g in c if len(g) == 1 and g != ("\t",) and c[g]}) for c in (c_all, c_fit)]

    def parts(at, c, n):
        p = [c[at[0]] / n]
        context = n
        for g in at[1:]:
            context = c[g[:-1]]
            p.append(c[g] / context if context else p[-1])
        return min(math.ceil(math.log2(context + 1)), lm.BUCKETS - 1), p

    events = collections.defaultdict(list)
    for i in train:
        if crc(i, 7) == 3:
            for at in grams(tokens[i]):
                bucket, p = parts(at, c_fit, n_fit)
                events[bucket].append([1 / (vocabulary[1] + 1), *p])

    def em(rows):
        w = [1 / (order + 1)] * (order + 1)
        for _ in range(lm.EM_STEPS):
            total = [0.0] * (order + 1)
            for row in rows:
                share = [a * b for a, b in zip(row, w, strict=True)]
                s = sum(share)
                total = [t + x / s for t, x in zip(total, share, strict=True)]
            w = [t / len(rows) for t in total]
            w[0] = max(w[0], lm.FLOOR)
            w = [x / sum(w) for x in w]
        return w

    overall = em([r for rows in events.values() for r in rows])
    weights = {b: em(events[b]) if b in events else overall for b in range(lm.BUCKETS)}
    out = {}
    for i, ts in tokens.items():
        base = score = 0.0
        for at in grams(ts):
            bucket, p = parts(at, c_all, n_all)
            base += math.log10((c_all[at[0]] + 1) / (n_all + vocabulary[0] + 1))
            score += math.log10(sum(a * b for a, b in zip(weights[bucket], [1 / (vocabulary[0] + 1), *p], strict=True)))
        out[i] = (len(ts), sum(c_all[(t,)] > 0 for t in ts), n_all, base, score)
    return out


def test_deleted_interpolation(spark, docs):
    expected = plain_scores(docs, 2)
    found = run(spark, "op1_deleted_interpolation")
    assert found.keys() == expected.keys()
    for i, (n, known, total, base, score) in expected.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 7) == 2, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.score == pytest.approx(score, rel=2e-3)
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_trigrams_and_proper_distribution(spark):
    texts = {i: f"a b c{i % 3} a b d" for i in range(40)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = plain_scores(texts, 3)
    for r in lm.score(frame, order=3).collect():
        assert r.score == pytest.approx(expected[r.doc_id][4], rel=2e-3)


def test_wu_manber(spark, docs):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = collections.defaultdict(set)
    for r in table(spark, SMALL, "benchmark").collect():
        w = words(r.text, pattern)
        for i in range(max(len(w) - 9, min(1, len(w)))):
            windows[tuple(w[i:i + 10])].add(str(r.item_id))
    sizes = {len(w) for w in windows}
    found = run(spark, "op4_wu_manber")
    assert any(r.contaminated for r in found.values())
    for i, text in docs.items():
        w, hit, items = words(text, pattern), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[at:at + n])):
                    hit.update(range(at, at + n))
                    items |= owners
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert tuple(found[i]) == (i, len(w), len(hit), len(items), digest, bool(hit))


def test_short_items_many_passes(spark, monkeypatch):
    monkeypatch.setattr(wumanber, "PASS_BYTES", 10)
    items = spark.createDataFrame([(1, "Ab"), (2, "x y"), (3, "--"), (4, None), (5, "é q " * 12), (6, "a")], "item_id long, text string")
    rows = [(1, "ab xy x, Y z"), (2, "abab x-y-x"), (3, "é Q " * 7), (4, None), (5, "!"), (6, "A")]
    found = {r.doc_id: r for r in wumanber.find_windows(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert [(s.first, s.end) for s in found[1].spans] == [(0, 1), (2, 4)] and found[1]["items"] == ["1", "2"]
    assert (found[2].n_hit, found[2]["items"]) == (2, ["2"]) and (found[3].n_hit, found[3]["items"]) == (14, ["5"])
    assert [found[i].contaminated for i in (4, 5, 6)] == [False, False, True] and found[6]["items"] == ["6"]


def plain_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, min(1, len(w))))}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (i, len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_duplicates(spark, docs):
    assert {i: tuple(r) for i, r in run(spark, "op8_minmax_near_dups").items()} == plain_groups(docs)


def test_near_duplicates_around_a_common_passage(spark):
    """Copies with edits, chains of links, and texts that share most of their words but aren't linked."""
    passage = [f"p{i}" for i in range(60)]
    texts = {}
    for i in range(60):
        texts[i] = " ".join(passage + [f"o{i}w{k}" for k in range(4 + i % 17)])
    for i in range(60, 100):
        texts[i] = " ".join(w if (k * 7 + i) % 53 else f"e{i}" for k, w in enumerate(f"q{x}" for x in range(150)))
    for i in range(100, 120):
        texts[i] = " ".join(f"r{x}" for x in range((i - 100) * 8, (i - 100) * 8 + 100))
    texts |= {120: "a b", 121: "A  b", 122: "", 123: None, 124: " \t"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: tuple(r) for r in minmax.near_duplicates(frame).collect()} == plain_groups(texts)


def test_min_max_agreement_estimates_jaccard(spark):
    a, b = (" ".join(f"w{x}" for x in r) for r in (range(0, 1000), range(150, 1150)))
    frame = spark.createDataFrame([(1, a), (2, b)], "id long, text string")
    rows = frame.mapInArrow(minmax._signer(1, 400, 1), "id long, n bigint, digest binary, bands array<bigint>").collect()
    same = sum(x == y for x, y in zip(rows[0].bands, rows[1].bands, strict=True)) / 800
    assert same == pytest.approx(850 / 1150, abs=0.06)


def test_fingerprints(spark, docs):
    found = run(spark, "op10_multiset_hash")
    ids = sorted(docs, reverse=True)
    for i, following in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, cut = docs[i], len(docs[i]) // 3
        edited = text[:len(text) - cut] + docs[following][:cut]
        r, own, other, of_next = found[i], *(fingerprint.fingerprint(t) for t in (text, edited, docs[following]))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own.tobytes().hex(), other.tobytes().hex())
        assert r.near_edited == pytest.approx(fingerprint.likeness(own[None], other[None])[0])
        assert r.near_next == pytest.approx(fingerprint.likeness(own[None], of_next[None])[0])
    assert sum(r.near_edited for r in found.values()) > 3 * sum(r.near_next for r in found.values())


def test_fingerprint_is_homomorphic():
    parts = [f"paragraph {i}" for i in range(9000)]
    whole, shuffled = fingerprint.fingerprint("\n".join(parts)), fingerprint.fingerprint("\n\n".join(parts[::-1]))
    assert (whole == shuffled).all() and (whole != fingerprint.fingerprint("\n".join(parts[1:]))).any()
    assert (fingerprint.delete(fingerprint.insert(whole, "x"), parts[0]) == fingerprint.fingerprint("\n".join([*parts[1:], "x"]))).all()
    half = fingerprint.fingerprint("\n".join(parts[:100]))
    other = fingerprint.fingerprint("\n".join(parts[50:150]))
    assert fingerprint.likeness(half[None], other[None])[0] == pytest.approx(0.5, abs=0.15)


def test_with_next_in_small_and_crowded_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ID_RANGE", 4)
    ids = [*range(150), 10 ** 15, -5, 2 ** 62, None]
    frame = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    order = [*sorted((i for i in ids if i is not None), reverse=True), None]
    expected = {f"t{a}": f"t{b}" for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    assert {r.text: r.next for r in fingerprint.with_next(frame).collect()} == expected


def test_archives(spark, scratch):
    big, small = "<p>" + "é" * 80, "tiny"
    rows = [(3, "http://a/ \n", big), (1, None, big), (2, "http://b", small), (4, "http://c", small), (5, "u", None), (None, "n", big), (9, "u", big)]
    rows += [(100 + i, f"http://x/{i}", f"<html>{i}" + "word " * 40) for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "url")
    dictionary = warc.train_dictionary(pages)
    assert warc.write_archives(warc.mark_revisits(pages), f"file:{scratch}", dictionary, archive_bytes=500) == len(rows)
    read = warc.read_archives(spark, f"file:{scratch}", payloads=True).collect()
    found = collections.defaultdict(list)
    for r in read:
        found[r.page_id].append(r)
    assert sorted(found, key=str) == sorted({None if i is None else str(i) for i, _, _ in rows}, key=str)
    for i, _, html in rows:
        r = found[None if i is None else str(i)][0]
        payload = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        revisit = html == big and i not in (1, None)
        assert (r.record_type, r.refers_to, bytes(r.payload)) == (("revisit", "1", b"") if revisit else ("response", None, payload))
    assert dictionary == b"" or len(dictionary) <= warc.DICTIONARY_BYTES


def test_archive_frames_and_damage():
    import zstandard

    record = warc.record(1, "http://a", b"body", hashlib.sha256(b"body").hexdigest(), None)
    samples = [f"<html><p>sample {i} of {i * i} words {i * 7}</p></html>".encode() * 8 for i in range(400)]
    dictionary = zstandard.train_dictionary(2048, samples).as_bytes()
    packed = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).compress(record)
    lead = warc.struct.pack("<II", warc.SKIPPABLE, len(dictionary)) + dictionary
    assert list(warc.frames_of(lead + packed * 3)) == [record] * 3
    squeezed = zstandard.compress(dictionary)
    assert list(warc.frames_of(warc.struct.pack("<II", warc.SKIPPABLE, len(squeezed)) + squeezed + packed)) == [record]
    assert list(warc.frames_of(b"")) == []
    with pytest.raises(Exception):
        list(warc.frames_of(packed))  # its dictionary is missing
    for broken in (lead[:-1], lead + packed[:-3], lead + packed + b"junk!!!!!"):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames_of(broken))
    for broken in (record[:-1], record + b"x", record.replace(b"WARC/1.1", b"WARC/9"), record.replace(b"body", b"bodY"),
                   record.replace(b"WARC-Date: ", b"X-Date: "), record.replace(b"Length: 4", b"Length: 5")):
        with pytest.raises(ValueError):
            warc.parse(broken)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", [("text", "a & <|end|>\n[INST]", None), ("image", None, "i.png")]),
            (1, 2, "assistant", [("text", "x &amp; &lt;|turn|>", None), ("text", None, None), ("audio", None, "a.wav"), ("odd", "t", None)]),
            (1, 1, "us\ner<|end|>&#10;", [("document", None, "d.pdf")]), (2, None, None, []), (None, 0, "assistant", None)]
    data = [(c, t, r, None if p is None else [(k, x, f, 100, 57, 1.5, 3) for k, x, f in p]) for c, t, r, p in rows]
    turns = spark.createDataFrame(data, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    made = {r.conv_id: r for r in chat.read_chat(chat.format_chat(turns)).collect()}
    assert [tuple(t) for t in made[1].turns] == [
        ("user", "a & <|end|>\n[INST]<|image:0.1|>"), ("us\ner<|end|>&#10;", "<|document:1.0|>"),
        ("assistant", "x &amp; &lt;|turn|><|audio:2.2|>t")]
    assert made[1].learned == "x &amp; &lt;|turn|><|audio:2.2|>t" and made[1].formatted.count("<|end|>\n") == 3
    assert [tuple(a) for a in made[1].attachments] == [("<|image:0.1|>", "image", "i.png", 12), ("<|document:1.0|>", "document", "d.pdf", 3072),
                                                       ("<|audio:2.2|>", "audio", "a.wav", 38)]
    assert made[1].attachment_tokens == 12 + 3072 + 38
    assert [tuple(t) for t in made[2].turns] == [("", "")] and [tuple(t) for t in made[None].turns] == [("assistant", "")]


def test_mixing_limits(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 else f"small{i % 30}") for i in range(3000)] + [(9000 + i, "", "empty") for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(frame, max_repeats=2.5).collect()
    times = collections.Counter(r.doc_id for r in out)
    assert set(times) == {r[0] for r in rows} and max(times.values()) == 3  # 2.5 passes: two whole ones and a half
    tokens = collections.Counter()
    for r in out:
        tokens[r.source] += r.n_tokens
    own = collections.Counter()
    for _, text, source in rows:
        own[source] += len(text.split())
    assert all(2.2 <= tokens[s] / own[s] <= 2.5 for s in own if s.startswith("small")) and tokens["big"] == own["big"]
    for key in {(r.source, r.epoch) for r in out}:
        at = 0
        for r in sorted((r for r in out if (r.source, r.epoch) == key and r.n_tokens), key=lambda r: r.position):
            assert r.position == at
            at += r.n_tokens


def test_mixing_to_an_entropy_and_a_budget(spark):
    rows = [(i, "w", f"s{min(i // 10, 3)}") for i in range(100)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), target_entropy=1.3, max_repeats=None, budget=60).collect()
    weights = {r.source: r.weight for r in out}
    assert -sum(w * math.log(w) for w in weights.values()) == pytest.approx(1.3, abs=1e-4)
    assert collections.Counter(r.source for r in out) == {s: round(60 * w) for s, w in weights.items()}
