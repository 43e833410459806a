"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers cut a text into tokens; the byte ends of their tokens are two
sorted lists. Their common ends, found by galloping the shorter list through
the longer one, cut the tokens into groups, and the ranks that the search leaves
behind say which tokens overlap. Links between token ids are counted over the
whole corpus, and each document is told how its links rank there.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evlog.llm.tokens import blocks, pack, unpack
from evlog.session import materialize, work_path

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 1 << 20  # of text tokenized at a time
MERGE = 1 << 21  # documents' distinct pairs that a task holds before it merges them
TOGETHER = 512  # words encoded as one text
MAX_WORDS = 500_000  # that a task remembers the tokens of; beyond it, it starts anew
FREQUENT = 1 << 20  # pairs with the highest counts that every task holds; the others are joined


# ---- tokenizers ------------------------------------------------------------------------------------

def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {**{chr(b): b for b in printable}, **{chr(0x100 + i): b for i, b in enumerate(rest)}}


#: A space between two characters that no library takes for white space (the excluded ones were or are taken for it by some).
VISIBLE = "[^\\s\u180e\u200b\u2060\ufeff]"
BETWEEN = re.compile(f"(?<={VISIBLE}) (?={VISIBLE})")
INNER = re.compile(f"{VISIBLE}(.*{VISIBLE})?\\Z", re.DOTALL)


class ByteLevel:
    """A byte-level BPE tokenizer, from the text of its JSON file."""

    def __init__(self, source: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(source.decode())
        self.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        letters, said = byte_letters(), json.loads(source)
        vocabulary = said["model"]["vocab"]
        # Its pattern begins a new piece at a space between two other characters, and pieces are encoded one by one.
        self.separable = (said["normalizer"] is None and said["pre_tokenizer"]["type"] == "ByteLevel" and said["pre_tokenizer"].get("use_regex", False)
                          and not said["pre_tokenizer"]["add_prefix_space"])
        self.bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model with byte fallback, from the bytes of its file. It adds the leading space itself."""

    def __init__(self, source: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=source)
        self.bytes = []
        # If no piece goes on with a space, merges don't reach over one.
        self.separable = not any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(self.model.get_piece_size()))
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


# ---- sorted lists ----------------------------------------------------------------------------------

def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of ``short`` the index of the first value of ``long`` that isn't smaller. Both rise strictly.

    A value starts from where a smaller value of ``short`` was found: steps of 1, 2, 4, ... until the next would
    pass it, then a binary search in the last step. First every 2**k-th value is searched, each from the one
    before, then those halfway between, and so on, so that all searches of a turn run as one.
    """
    at, n = np.zeros(len(short), np.int64), len(long)
    padded = np.append(long, np.iinfo(np.int64).max)
    stride = 1 << max(0, len(short).bit_length() - 1)
    while stride:
        which = np.arange(0 if stride << 1 > len(short) else stride, len(short), stride if stride << 1 > len(short) else stride << 1)
        values, low = short[which], at[np.maximum(which - stride, 0)]
        step, going = np.ones(len(which), np.int64), np.ones(len(which), bool)
        high = low.copy()  # the answer is in [low, high] once long[high] isn't smaller
        while True:
            going = padded[high] < values
            if not going.any():
                break
            low = np.where(going, high + 1, low)
            high = np.where(going, np.minimum(high + step, n), high)
            step <<= going
        while True:
            open_ = low < high
            if not open_.any():
                break
            middle = (low + high) >> 1
            smaller = open_ & (padded[middle] < values)
            low = np.where(smaller, middle + 1, low)
            high = np.where(open_ & ~smaller, middle, high)
        at[which] = low
        stride >>= 1
    return at


@dataclass
class Aligned:
    """Tokens of many documents: ids end to end, and for each token the group it's in; links as indexes of tokens."""

    n_a: np.ndarray  # a document's number of tokens, groups and links
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    group_a: np.ndarray  # a token's group, numbered through all documents
    group_b: np.ndarray
    link_a: np.ndarray  # a link's tokens
    link_b: np.ndarray


def align(ends_a: list[np.ndarray], ends_b: list[np.ndarray]) -> Aligned:
    """Aligns documents whose tokens' byte ends are given; both lists of a document rise strictly to the same end (or are empty)."""
    n_a, n_b = (np.array([len(e) for e in ends], np.int64) for ends in (ends_a, ends_b))
    size = np.array([e[-1] if len(e) else 0 for e in ends_a], np.int64)
    # A document's ends follow those of the one before, so that all documents are two rising lists; the shorter one drives in each.
    base = np.cumsum(size) - size
    a_drives = n_a <= n_b
    drivers = [a if s else b for a, b, s in zip(ends_a, ends_b, a_drives, strict=True)]
    targets = [b if s else a for a, b, s in zip(ends_a, ends_b, a_drives, strict=True)]
    n_driver, n_target = np.where(a_drives, n_a, n_b), np.where(a_drives, n_b, n_a)

    def joined(lists: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
        return (np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)) + np.repeat(base, counts)

    driver, target = joined(drivers, n_driver), joined(targets, n_target)
    rank = gallop(driver, target)
    common = target[rank] == driver if len(driver) else np.zeros(0, bool)
    # A driver token begins where the one before ended: after that one's last partner if both ended together, else within it.
    first = np.concatenate(([0], rank[:-1] + common[:-1])) if len(rank) else rank
    many = rank - first + 1
    of_link = np.repeat(np.arange(len(driver)), many)
    to_link = np.arange(len(of_link)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    group_driver = np.cumsum(common) - common
    cuts = np.zeros(len(target), np.int64)
    cuts[rank[common]] = 1
    group_target = np.cumsum(cuts) - cuts
    doc = np.repeat(np.arange(len(n_a)), n_driver)
    # Tokens of each side in the order of documents, whichever side drives.
    start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    start_driver, start_target = np.cumsum(n_driver) - n_driver, np.cumsum(n_target) - n_target
    a_link = a_drives[doc[of_link]]
    link_doc = doc[of_link]
    in_driver, in_target = of_link - start_driver[link_doc], to_link - start_target[link_doc]
    link_a = start_a[link_doc] + np.where(a_link, in_driver, in_target)
    link_b = start_b[link_doc] + np.where(a_link, in_target, in_driver)
    group_a, group_b = np.zeros(n_a.sum(), np.int64), np.zeros(n_b.sum(), np.int64)
    for groups, counts, starts in ((group_driver, n_driver, start_driver), (group_target, n_target, start_target)):
        of = np.repeat(np.arange(len(n_a)), counts)
        inside = np.arange(len(of)) - starts[of]
        is_a = a_drives[of] if groups is group_driver else ~a_drives[of]
        group_a[(start_a[of] + inside)[is_a]] = groups[is_a]
        group_b[(start_b[of] + inside)[~is_a]] = groups[~is_a]
    return Aligned(n_a, n_b, np.bincount(doc[common], minlength=len(n_a)), np.bincount(link_doc, minlength=len(n_a)), group_a, group_b, link_a, link_b)


# ---- documents -------------------------------------------------------------------------------------

class Pair:
    """Two tokenizers, and what their tokens look like in the description of groups."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.separable = self.a.separable and self.b.separable
        self.forget()
        self.sizes = [np.array([len(t) for t in side.bytes], np.int64) for side in (self.a, self.b)]
        # Two strings for each token, with what follows it in its group, and with what follows the group's last one of its side.
        self.shown = [f"{i}{after}".encode() for side, last in ((self.a, "|"), (self.b, ";")) for i in range(len(side.bytes)) for after in (",", last)]

    def forget(self) -> None:
        """Starts anew with the words whose tokens are known: their places, whether their bytes come out the same, and for each
        side their numbers of ids and the ids end to end."""
        self.known: dict[str, int] = {}
        self.fine = np.zeros(0, bool)
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2

    def _encoded(self, words: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both, or None where the tokens' bytes aren't a space and the word."""
        out: list[tuple[list[int], list[int]] | None] = []
        for word, a, b in zip(words, self.a.encode(words), self.b.encode(words), strict=True):
            wanted = b" " + word.encode()
            same = word and all(b"".join(map(side.bytes.__getitem__, ids)) == wanted for side, ids in ((self.a, a), (self.b, b)))
            out.append((a, b) if same else None)
        return out

    def _together(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """For both sides the words' numbers of ids and the ids, from one text of all the words. None if the bytes don't come out the same or a
        token reaches over a word's end."""
        text = " ".join(words)
        wanted = b" " + text.encode()
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        out = []
        for side, sizes in zip((self.a, self.b), self.sizes, strict=True):
            ids = side.encode([text])[0]
            if b"".join(map(side.bytes.__getitem__, ids)) != wanted:
                return None
            ids = np.array(ids, np.int64)
            token_ends = np.cumsum(sizes[ids])
            at = np.searchsorted(token_ends, ends)
            if (token_ends[at] != ends).any():
                return None
            out.append((np.diff(at + 1, prepend=0), ids))
        return out

    def _learn(self, words: list[str]) -> None:
        """Adds words to those whose tokens are known. Words that begin and end without white space are encoded many at a time."""
        inner = [w for w in words if INNER.match(w)]
        found, alone = [], [w for w in words if not INNER.match(w)]
        for i in range(0, len(inner), TOGETHER):
            some = inner[i:i + TOGETHER]
            ids = self._together(some)
            if ids is None:
                alone += some
            else:
                found.append((some, np.ones(len(some), bool), ids))
        if alone:
            each = self._encoded(alone)
            sides = [[e[side] if e else () for e in each] for side in (0, 1)]
            found.append((alone, np.array([e is not None for e in each], bool),
                          [(np.array([len(i) for i in ids], np.int64), np.fromiter(chain.from_iterable(ids), np.int64)) for ids in sides]))
        for some, fine, ids in found:
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some)), strict=True))
        if found:
            self.fine = np.concatenate((self.fine, *(f for _, f, _ in found)))
            self.held = [tuple(np.concatenate((old, *(ids[side][k] for _, _, ids in found))) for k, old in enumerate(self.held[side])) for side in (0, 1)]

    def tokens(self, texts: list[bytes | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by either tokenizer; none where the tokens' bytes aren't a space and the text.

        Where both tokenizers work word by word, that is, between plain spaces, a word is encoded once and its ids are looked up after that.
        """
        given = []
        for text in texts:
            try:
                given.append((text or b"").decode())
            except UnicodeDecodeError:
                given.append("")
        if not given:
            return [], []
        words = [BETWEEN.split(t) for t in given] if self.separable else [[t] for t in given]
        if len(self.known) > MAX_WORDS or not self.separable:
            self.forget()
        every = list(chain.from_iterable(words))
        self._learn(sorted(set(every) - self.known.keys()))
        place = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        n_words = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(n_words) - n_words  # every text has a word, if only an empty one
        fine = np.logical_and.reduceat(self.fine[place], first)
        found = []
        for sizes, ids in self.held:
            starts = np.cumsum(sizes) - sizes
            count = np.where(np.repeat(fine, n_words), sizes[place], 0)
            flat = ids[np.repeat(starts[place] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            found.append(np.split(flat, np.cumsum(np.add.reduceat(count, first))[:-1]))
        return found[0], found[1]

    def documents(self, texts: list[bytes | None]) -> dict[str, pa.Array]:
        """Columns of ``DOCUMENT`` for the texts."""
        ids = self.tokens(texts)
        found = align(*([np.cumsum(sizes[i]) for i in of] for of, sizes in zip(ids, self.sizes, strict=True)))
        a, b = (np.concatenate(of) if of else np.zeros(0, np.int64) for of in ids)
        # Groups in order, and in each the tokens of A before those of B.
        shown_a, shown_b = (flat * 2 + (np.diff(groups, append=-1) != 0) for flat, groups in ((a, found.group_a), (b, found.group_b)))
        order = np.argsort(np.concatenate((found.group_a * 2, found.group_b * 2 + 1)), kind="stable")
        line = np.concatenate((shown_a, shown_b + 2 * len(self.a.bytes)))[order].tolist()
        pairs, digests, links, times, n_pairs, at, link = a[found.link_a] * len(self.b.bytes) + b[found.link_b], [], [], [], [], 0, 0
        for n, m in zip((found.n_a + found.n_b).tolist(), found.n_links.tolist(), strict=True):
            digests.append(hashlib.sha256(b"".join(map(self.shown.__getitem__, line[at:at + n]))[:-1]).hexdigest() if n else "")
            distinct, often = np.unique(pairs[link:link + m], return_counts=True)
            links.append(pack(np.diff(distinct, prepend=0)))
            times.append(pack(often))
            n_pairs.append(len(distinct))
            at, link = at + n, link + m
        return {"n_a": pa.array(found.n_a), "n_b": pa.array(found.n_b), "n_groups": pa.array(found.n_groups), "n_links": pa.array(found.n_links),
                "groups_sha256": pa.array(digests, pa.string()), "n_pairs": pa.array(n_pairs, pa.int64()), "links": pa.array(links, pa.binary()),
                "times": pa.array(times, pa.binary())}


DOCUMENT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_pairs bigint, links binary, times binary"


def _links(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each document's distinct pairs and how often they occur in it."""
    for n, links, times in zip(*(batch.column(c).to_pylist() for c in ("n_pairs", "links", "times")), strict=True):
        yield np.cumsum(unpack(links, n, np.int64)), unpack(times, n, np.int64)


def _merged(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(np.concatenate(pairs), return_inverse=True)
    # Counts of one task are far below 2**53, where sums of floats are exact.
    return distinct, np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n) of a task's documents; a pair may come more than once."""
    pairs, counts, held = [], [], 0
    for batch in batches:
        for distinct, often in _links(batch):
            pairs.append(distinct)
            counts.append(often)
            held += len(distinct)
            if held >= MERGE:
                merged = _merged(pairs, counts)
                if len(merged[0]) >= MERGE // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged], ["pair", "n"])
                    pairs, counts, held = [], [], 0
                else:
                    pairs, counts, held = [merged[0]], [merged[1]], len(merged[0])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(pairs, counts)], ["pair", "n"])


def count_pairs(documents: DataFrame, ids_b: int) -> DataFrame:
    """``(pair, n, best)``: how many links hold a pair of ids, and whether no other pair with its B id is held by more."""
    counts = materialize(documents.select("n_pairs", "links", "times").mapInArrow(_count, "pair bigint, n bigint")
                         .groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair") % ids_b
    most = F.broadcast(counts.groupBy(b.alias("b")).agg(F.max("n").alias("most")))  # at most a row for each id of the vocabulary
    return counts.join(most, b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", a_path: str = A_PATH, b_path: str = B_PATH,
                    frequent: int = FREQUENT) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, a row for each document.

    The texts, after a space, are tokenized by the byte-level tokenizer of ``a_path`` and the sentencepiece
    model of ``b_path`` (files that the driver can read; special tokens are plain text). A link is two overlapping
    tokens; ``n_best`` counts those whose pair of ids is the most frequent one of its B id in the corpus
    (ties included), ``count_sum`` adds up the corpus-wide counts of the links' pairs. ``groups_sha256`` is the
    digest of ``a1,a2|b1;a3|b2``, ids between common ends. A text that is null, empty, no UTF-8, or whose
    tokens' bytes aren't a space and the text has no tokens: zeros, and an empty string for the digest. Repeated rows
    count as often as they occur, a null doc_id is an id, other columns are ignored. No rows in, no rows out.

    Documents are tokenized once and their links kept packed in a written table. The at most ``frequent`` pairs with the
    highest counts, which hold nearly all links and every hot pair, go to all tasks (17 bytes each); links
    with another pair are joined by it with the table of counts.
    """
    spark = docs.sparkSession
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        sources = a.read(), b.read()
    shared = spark.sparkContext.broadcast(sources)
    ids_b = sentencepiece.SentencePieceProcessor(model_proto=sources[1]).get_piece_size()

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = None
        for batch in blocks(batches, "text", BLOCK_BYTES):
            tokenizers = tokenizers or Pair(*shared.value)
            columns = tokenizers.documents(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns.values()], ["doc_id", *columns])

    kind = docs.schema[doc_id].dataType.simpleString()
    folder = work_path(spark, "alignment")
    docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(tokenized, f"doc_id {kind}, {DOCUMENT}").write.parquet(folder)
    documents = spark.read.parquet(folder)
    counts = materialize(count_pairs(documents, ids_b))
    # The lowest power of two that few enough pairs reach.
    by_size, n, reached = dict(counts.groupBy(F.floor(F.log2("n")).cast("int")).count().collect()), 0, 64
    for size in sorted(by_size, reverse=True):
        n += by_size[size]
        if n > frequent:
            break
        reached = size
    least = 1 << reached if reached < 63 else (1 << 63) - 1
    top = counts.filter(F.col("n") >= least).orderBy("pair").toArrow()
    known = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, total, best = known.value
        for batch in batches:
            n_best, count_sum, rest = [], [], []
            for distinct, often in _links(batch):
                at = np.searchsorted(pair, distinct)
                is_known = np.zeros(len(distinct), bool)
                is_known[at < len(pair)] = pair[at[at < len(pair)]] == distinct[at < len(pair)]
                at, times = at[is_known], often[is_known]
                n_best.append(int(times[best[at]].sum()))
                count_sum.append(int((times * total[at]).sum()))
                rest.append([{"pair": p, "often": k} for p, k in zip(distinct[~is_known].tolist(), often[~is_known].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()),
                 batch.column("groups_sha256"), pa.array(rest, pa.list_(pa.struct([("pair", pa.int64()), ("often", pa.int64())])))],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rest"])

    out = documents.mapInArrow(told, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
                                     "groups_sha256 string, rest array<struct<pair:bigint,often:bigint>>")
    if sum(by_size.values()) <= frequent:
        return out.drop("rest")
    path = work_path(spark, "alignment-rest")
    out.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    partly = spark.read.parquet(path)
    rare = (partly.select("row", F.inline("rest")).join(counts.filter(F.col("n") < least), "pair")
            .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("more_best"),
                                F.sum(F.col("often") * F.col("n")).alias("more_sum")))
    return partly.join(rare, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
