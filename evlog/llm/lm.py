"""LM scoring by deleted interpolation.

Maximum-likelihood estimates of every order are mixed with weights that depend
on how often the context was seen. The weights are learned by expectation-
maximisation on a held-out section of the training texts; the final estimates
count all of them.

The corpus is worked on in blocks of texts. A block asks for the counts of its
distinct n-grams (packed, one row for each block and range of hashes), each
range adds up what all blocks ask and answers them, and a block scores its
texts with the answers. A frequent n-gram is one key for each block, so no key
is hot, and nothing that grows with the corpus is collected or broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlog.llm.common import id_remainder
from evlog.llm.tokens import MULTIPLIER, NOT_SPACE, U64, Words, blocks, flat, mix, pack, unpack
from evlog.session import materialize

ORDER = 2
FOLDS, TEST, SECTION = 7, 2, 3  # of crc32(doc_id): remainder TEST is never learned from, SECTION is the EM's held-out section
BLOCK_BYTES = 12 << 20
RANGE_BYTES = 8 << 20  # of corpus text for each range of hashes: memory of a counting task is a small multiple of it
MAX_RANGE_BITS = 16
BUCKETS = 24  # of context frequency: 0, 1, 2-3, 4-7, ...
EM_STEPS = 60
FLOOR = 1e-6  # least weight of the uniform part
KEY_BITS = 56  # of the hash of an n-gram: among n different ones, a share of about n / 2**56 meets another
END, BEGIN = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
FIT, HELD, NONE = 0, 1, 2  # how a text is used: counted, held out for the EM, not learned from


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", order: int = ORDER) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, a row for each row of ``docs``.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered and one end for
    each text; a null or empty text is just the end. Texts whose
    crc32(doc_id) mod 7 is 2 are held out; a null id is never learned from and
    not held out. base_score is the add-one unigram score, score the mixture's;
    both are log10 probabilities of the whole text. With no training text at
    all, every token has probability 1. Repeated rows count as often as they
    occur. ``docs`` has to give the same rows in the same order when read again,
    as a table does; a mismatch is an error, not a wrong result.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    remainder = id_remainder(doc_id, FOLDS)
    use = F.when(remainder.isNull() | (remainder == TEST), NONE).when(remainder == SECTION, HELD).otherwise(FIT)
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), use.alias("use"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(MAX_RANGE_BITS, max(4, math.ceil(math.log2(max(size / RANGE_BYTES, 4 * width, 1)))))

    asked = base.mapInArrow(_asker(order, bits), "block string, use int, part int, unigrams int, n int, keys binary, counts binary")
    answers = materialize(asked.groupBy("part").applyInArrow(
        _answer, "block string, part int, n int, total binary, fit binary, v_all bigint, v_fit bigint, n_all bigint, n_fit bigint"))
    v_all, v_fit, n_all, n_fit = (x or 0 for x in answers.filter("block IS NULL").agg(
        F.sum("v_all"), F.sum("v_fit"), F.sum("n_all"), F.sum("n_fit")).first())
    shape = f"block string, ids array<{kind}>, lengths binary, n int, n_words int, words binary, places binary"
    answers = answers.filter("block IS NOT NULL").select("block", "part", "n", "total", "fit")

    events = (base.mapInArrow(_blocker((HELD,)), shape).groupBy("block")
              .cogroup(answers.filter("fit IS NOT NULL").groupBy("block"))
              .applyInArrow(_events(order, bits, n_fit), "code bigint, n bigint, sums array<double>"))
    sums = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(order)]
    rows = events.groupBy("code").agg(F.sum("n").alias("n"), *sums).toPandas()  # of at most BUCKETS x (bins of each order) rows
    weights = learn(rows["code"].to_numpy(np.int64) >> 40, rows["n"].to_numpy(float),
                    rows[[f"s{k}" for k in range(order)]].to_numpy(float), 1 / (v_fit + 1))

    scored = base.mapInArrow(_blocker((FIT, HELD, NONE)), shape).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scorer(order, bits, n_all, v_all, weights),
        f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", F.coalesce(id_remainder("doc_id", FOLDS) == TEST, F.lit(False)).alias("held_out"), "n_tokens",
                         "n_known", F.lit(n_all).cast("bigint").alias("train_tokens"), "base_score", "score")


def learn(buckets: np.ndarray, n: np.ndarray, sums: np.ndarray, uniform: float) -> np.ndarray:
    """Weights of (uniform, order 1, order 2, ...) for each bucket, by EM on held-out events.

    ``n`` events with probabilities ``sums / n`` were seen in a context of the
    bucket. A bucket without events gets the weights learned from all events.
    """
    order = sums.shape[1]
    equal = np.full(order + 1, 1 / (order + 1))
    p = np.column_stack((np.full(len(n), uniform), sums / np.maximum(n, 1)[:, None]))

    def em(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        weights = equal
        for _ in range(EM_STEPS if n.sum() else 0):
            share = p * weights
            weights = (share / share.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
            weights = np.maximum(weights, [FLOOR] + [0.0] * order)
            weights = weights / weights.sum()
        return weights

    overall = em(p, n)
    return np.array([em(p[at], n[at]) if (at := buckets == b).any() else overall for b in range(BUCKETS)])


def _grams(tokens: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes (of ``KEY_BITS``) of the 1-gram, 2-gram, ... that ends at each token, with BEGIN before the first one."""
    age = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    gram = mix(tokens + U64(1))
    found = [gram]
    for k in range(2, order + 1):
        before = np.full(len(tokens), BEGIN, U64)
        before[k - 1:] = tokens[:len(tokens) - k + 1]
        before[age < k - 1] = BEGIN
        gram = mix(gram * U64(MULTIPLIER) + before + U64(k))
        found.append(gram)
    return [g >> U64(64 - KEY_BITS) for g in found]


def _distinct(tokens: np.ndarray, lengths: np.ndarray, order: int, bits: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: its distinct hashes in order, where each token has its, and where each range begins."""
    steps = np.arange(1 << bits, dtype=U64) << U64(KEY_BITS - bits)
    found = []
    for grams in _grams(tokens, lengths, order):
        unique, places = np.unique(grams, return_inverse=True)
        found.append((unique, places, np.append(np.searchsorted(unique, steps), len(unique))))
    return found


def _token_blocks(batches, uses: tuple = (FIT, HELD, NONE)) -> Iterator[tuple[str, int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of texts of one use: name, use, rows, tokens, number of tokens of each text. Names don't depend on ``uses``."""
    words, serial, task = Words(NOT_SPACE), 0, TaskContext.get().partitionId()
    for batch in blocks(batches, "text", BLOCK_BYTES):
        of_rows = batch.column("use").to_numpy(zero_copy_only=False)
        for use in (FIT, HELD, NONE):
            if not (of_rows == use).any():
                continue
            serial += 1
            if use not in uses:
                continue
            rows = batch.filter(pa.array(of_rows == use))
            hashes, counts = words.hashes(*flat(rows.column("text")))
            lengths = counts + 1
            tokens = np.full(int(lengths.sum()), END, U64)
            inner = np.ones(len(tokens), bool)
            inner[np.cumsum(lengths) - 1] = False
            tokens[inner] = hashes
            yield f"{task}-{serial}-{int(mix(tokens).sum(dtype=U64)):x}", use, rows, tokens, lengths


def _asker(order: int, bits: int):
    def ask(batches):
        for name, use, _, tokens, lengths in _token_blocks(batches):
            kinds = _distinct(tokens, lengths, order, bits)
            counts = [np.bincount(places).astype(np.uint32) for _, places, _ in kinds]
            columns: list[list] = [[], [], [], [], []]
            for part in range(1 << bits):
                cuts = [slice(bounds[part], bounds[part + 1]) for _, _, bounds in kinds]
                keys = np.concatenate([unique[cut] for (unique, _, _), cut in zip(kinds, cuts, strict=True)])
                if len(keys):
                    steps = np.diff(keys, prepend=U64(0))  # of ordered hashes: small numbers
                    row = (part, cuts[0].stop - cuts[0].start, len(keys), pack(steps),
                           pack(np.concatenate([c[cut] for c, cut in zip(counts, cuts, strict=True)])) if use != NONE else None)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            n = len(columns[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n, pa.string()), pa.array([use] * n, pa.int32()),
                 *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True))],
                ["block", "use", "part", "unigrams", "n", "keys", "counts"])

    return ask


def _answer(asked: pa.Table) -> pa.Table:
    """Totals of one range of hashes for each block that asks, and a row of sums over the range."""
    rows = asked.to_pylist()
    keys = [np.cumsum(unpack(r["keys"], r["n"], U64), dtype=U64) for r in rows]
    ends = np.cumsum([len(k) for k in keys])
    unique, places = np.unique(np.concatenate(keys), return_inverse=True)
    totals = {FIT: np.zeros(len(unique), np.int64), HELD: np.zeros(len(unique), np.int64)}
    unigram = np.zeros(len(unique), bool)
    for r, end in zip(rows, ends, strict=True):
        at = places[end - r["n"]:end]
        unigram[at[:r["unigrams"]]] = True
        if r["use"] in totals:
            totals[r["use"]][at] += unpack(r["counts"], r["n"], np.uint32)  # a block's keys are distinct
    fit, both = totals[FIT], totals[FIT] + totals[HELD]
    out = []
    for r, end in zip(rows, ends, strict=True):
        at = places[end - r["n"]:end]
        out.append({"block": r["block"], "part": r["part"], "n": r["n"], "total": pack(both[at]),
                    "fit": pack(fit[at]) if r["use"] == HELD else None})
    out.append({"v_all": int((both[unigram] > 0).sum()), "v_fit": int((fit[unigram] > 0).sum()),
                "n_all": int(both[unigram].sum()), "n_fit": int(fit[unigram].sum())})
    return pa.Table.from_pylist(out, pa.schema(
        [("block", pa.string()), ("part", pa.int32()), ("n", pa.int32()), ("total", pa.binary()), ("fit", pa.binary()),
         ("v_all", pa.int64()), ("v_fit", pa.int64()), ("n_all", pa.int64()), ("n_fit", pa.int64())]))


def _blocker(uses: tuple):
    def texts(batches):
        for name, _, rows, tokens, lengths in _token_blocks(batches, uses):
            words, places = np.unique(tokens, return_inverse=True)
            ids = rows.column("id")
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 pa.array([pack(lengths)]), pa.array([len(lengths)], pa.int32()), pa.array([len(words)], pa.int32()),
                 pa.array([pack(np.diff(words, prepend=U64(0)))]), pa.array([pack(places.astype(np.uint32))])],
                ["block", "ids", "lengths", "n", "n_words", "words", "places"])

    return texts


def _joined(texts: pa.Table, answers: pa.Table, order: int, bits: int, counted: str):
    """A block's ids, numbers of tokens, and for each order the corpus count of the n-gram at each token."""
    (row,) = texts.to_pylist()
    lengths = unpack(row["lengths"], row["n"], np.int64)
    words = np.cumsum(unpack(row["words"], row["n_words"], U64), dtype=U64)
    tokens = words[unpack(row["places"], int(lengths.sum()), np.uint32)]
    kinds = _distinct(tokens, lengths, order, bits)
    counts = [np.zeros(len(unique), np.int64) for unique, _, _ in kinds]
    seen = 0
    for r in answers.to_pylist():
        values, at = unpack(r[counted], r["n"], np.int64), 0
        for (_, _, bounds), count in zip(kinds, counts, strict=True):
            begin, end = bounds[r["part"]], bounds[r["part"] + 1]
            count[begin:end] = values[at:at + end - begin]
            at += end - begin
        if at != len(values):
            raise ValueError(f"block {row['block']} changed between two readings")
        seen += at
    if seen != sum(map(len, counts)):
        raise ValueError(f"block {row['block']} lacks counts: the documents changed between two readings")
    return row["ids"], lengths, [count[places] for count, (_, places, _) in zip(counts, kinds, strict=True)]


def _parts(counts: list[np.ndarray], lengths: np.ndarray, n_tokens: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The bucket of each token's context, and its probability by each order. An unseen context takes the order below.

    A context's count is that of the n-gram that ends before the token. A text's beginning was seen as often as its end.
    """
    parts = [counts[0] / max(n_tokens, 1)]
    context = np.full(len(counts[0]), n_tokens)
    ends = np.cumsum(lengths)
    for shorter, count in zip(counts, counts[1:], strict=False):
        context = np.concatenate(([0], shorter[:-1]))
        context[ends - lengths] = counts[0][ends - 1]
        parts.append(np.where(context > 0, count / np.maximum(context, 1), parts[-1]))
    buckets = np.minimum(np.ceil(np.log2(context + 1.0)).astype(np.int64), BUCKETS - 1)
    return buckets, parts


def _events(order: int, bits: int, n_tokens: int):
    """Held-out tokens, added up by bucket and binned probabilities (eighths of a power of two)."""
    def events(texts: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("code", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.float64()))])
        if not texts.num_rows:
            return schema.empty_table()
        _, lengths, counts = _joined(texts, answers, order, bits, "fit")
        code, parts = _parts(counts, lengths, n_tokens)
        for p in parts:
            binned = np.clip(np.round(-8 * np.log2(np.maximum(p, 2.0 ** -100))), 0, 511).astype(np.int64)
            code = code * 1024 + binned
        code <<= 40 - 10 * order
        unique, places = np.unique(code, return_inverse=True)
        sums = np.column_stack([np.bincount(places, p) for p in parts])
        return pa.Table.from_arrays([pa.array(unique), pa.array(np.bincount(places)), pa.array(sums.tolist(), pa.list_(pa.float64()))],
                                    schema=schema)

    return events


def _scorer(order: int, bits: int, n_tokens: int, n_types: int, weights: np.ndarray):
    def scores(texts: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
        ids_type = texts.schema.field("ids").type.value_type
        types = [ids_type, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not texts.num_rows:
            return pa.schema(list(zip(names, types, strict=True))).empty_table()
        ids, lengths, counts = _joined(texts, answers, order, bits, "total")
        buckets, parts = _parts(counts, lengths, n_tokens)
        chosen = weights[buckets]
        p = chosen[:, 0] / (n_types + 1)
        for k, part in enumerate(parts):
            p = p + chosen[:, k + 1] * part
        base = (counts[0] + 1) / (n_tokens + n_types + 1)
        if not n_tokens:
            p = np.ones(len(base))
        starts = np.cumsum(lengths) - lengths
        columns = [ids, lengths, np.add.reduceat((counts[0] > 0).astype(np.int64), starts),
                   np.add.reduceat(np.log10(base), starts), np.add.reduceat(np.log10(p), starts)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return scores
