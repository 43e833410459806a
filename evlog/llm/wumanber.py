"""Benchmark decontamination by Wu-Manber multi-pattern search.

Windows of consecutive benchmark words are searched in the documents' words.
Both are normalised to words between single spaces, so an occurrence of a
window is an occurrence of a string. For strings of at least m bytes, a table
gives for each block of bytes how far the end of the search position may move
(no string has the block nearer to its m-th byte); where it may not move, the
block's bucket lists the strings that end their first m bytes with it, and
these are compared directly. Many places of a batch of texts move at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlog.llm.tokens import ALPHANUMERIC, MULTIPLIER, U64, blocks, flat, lower_table

WINDOW = 10
#: Benchmark text searched for in one pass over the documents. A larger benchmark takes more passes, so what a task
#: holds stays bounded.
PASS_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
LANE = 1024  # bytes of text that one moving place covers
TABLE_BITS = 18
CLASSES = (1, 8, 16, 32, 64)  # strings are searched with others of similar length, as the shortest one limits all moves
END = 0x0A  # after each text; no string has it


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text as END, space, and every word with a space after it; and the places of the ENDs (one more at the end)."""
    n = len(offsets) - 1
    ends = offsets + 3 * np.arange(n + 1)
    spread = np.full(int(ends[-1]) + 1, 0x20, np.uint8)
    for i in range(n):
        spread[ends[i] + 2:ends[i + 1] - 1] = data[offsets[i]:offsets[i + 1]]
    word = ALPHANUMERIC[spread]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the byte after a word becomes its space
    out = np.where(word, lower_table()[spread], np.uint8(0x20))
    out[ends] = END
    keep[ends] = keep[ends[:-1] + 1] = True
    return out[keep], np.searchsorted(np.flatnonzero(keep), ends)


def item_windows(items: list[tuple], width: int = WINDOW) -> dict[bytes, list]:
    """The strings to search for (space, words with a space after each), with the ids of the items that have them."""
    found: dict[bytes, list] = {}
    texts = [(text or "").encode() for _, text in items]
    offsets = np.cumsum([0, *map(len, texts)])
    flat_bytes, ends = normalised(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for (item, _), begin, end in zip(items, ends[:-1], ends[1:], strict=True):
        words = flat_bytes[begin + 1:end].tobytes().split()
        for i in range(max(len(words) - width + 1, min(1, len(words)))):
            owners = found.setdefault(b" " + b" ".join(words[i:i + width]) + b" ", [])
            if item not in owners:
                owners.append(item)
    return found


class Search:
    """Wu-Manber tables of strings of at least ``m`` bytes."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.m = m = min(map(len, strings))
        self.block = block = min(8, m)
        self.mask = U64((1 << 8 * block) - 1)
        heads = np.frombuffer(b"".join(s[:m] for s in strings), np.uint8).reshape(len(strings), m)
        self.shift = np.full(1 << TABLE_BITS, m - block + 1, np.int64)
        for j in range(m - block + 1):
            np.minimum.at(self.shift, self._hash(self._blocks(heads, j)), m - block - j)
        last = self._hash(self._blocks(heads, m - block))
        order = np.argsort(last, kind="stable")
        self.members = order
        self.first = np.searchsorted(last[order], np.arange((1 << TABLE_BITS) + 1))
        self.prefix = self._blocks(heads, 0)

    def _blocks(self, heads: np.ndarray, j: int) -> np.ndarray:
        padded = np.zeros((len(heads), 8), np.uint8)
        padded[:, :self.block] = heads[:, j:j + self.block]
        return padded.view(U64).ravel()

    def _hash(self, block: np.ndarray) -> np.ndarray:
        return ((block * U64(MULTIPLIER)) >> U64(64 - TABLE_BITS)).astype(np.int64)

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where strings begin in ``text`` (normalised), and which ones."""
        padded = np.concatenate((text, np.zeros(8, np.uint8)))
        words = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place
        last = len(text) - self.block  # place of the last block
        place = np.arange(self.m - self.block, last + 1, LANE)
        stop = np.minimum(place + LANE, last + 1)
        stops, hashes = [], []
        while len(place):
            hashed = self._hash(words[place] & self.mask)
            move = self.shift[hashed]
            still = move == 0
            if still.any():
                stops.append(place[still])
                hashes.append(hashed[still])
            place = place + np.maximum(move, 1)
            on = place < stop
            if not on.all():
                place, stop = place[on], stop[on]
        if not stops:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin, hashed = np.concatenate(stops) - (self.m - self.block), np.concatenate(hashes)
        n = self.first[hashed + 1] - self.first[hashed]
        row = np.repeat(np.arange(len(begin)), n)
        which = self.members[np.repeat(self.first[hashed], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
        begin = begin[row]
        near = (words[begin] & self.mask) == self.prefix[which]
        begin, which = begin[near], which[near]
        raw = text.tobytes()
        same = [raw.startswith(self.strings[w], b) for b, w in zip(begin.tolist(), which.tolist(), strict=True)]
        return begin[same], which[same]


def searches(strings: list[bytes]) -> list[Search]:
    found = []
    for low, high in zip(CLASSES, (*CLASSES[1:], 1 << 62), strict=True):
        of_class = [s for s in strings if low <= len(s) < high]
        if of_class:
            found.append(Search(of_class))
    return found


def find_windows(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id",
                 item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items)``, a row for each row of ``docs``.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lowered. A window
    is ``width`` consecutive words of an item, or all words of an item of fewer
    (not of none). spans are the maximal runs (first word, end) of document
    words inside occurrences of windows, n_hit their words; items are the items with
    occurring windows, as strings in order (a null item_id is the string
    ``null``), and items_sha256 the hex digest of them joined by commas. A window that several
    items share counts for each of them. Null texts have no words. No items: nothing is hit. Repeated rows
    each get their own. Other columns are ignored.

    The benchmark is read in passes of a bounded size, each one step of the plan over the documents; nothing is shuffled.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    tests = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shape = f"doc_id {kind}, text string, n_words bigint, spans array<array<bigint>>, items array<string>"
    for i in range(passes):
        part = tests.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == i).collect()  # about PASS_BYTES
        strings = item_windows([("null" if r["item"] is None else r["item"], r["text"]) for r in part], width)
        found = found.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(strings), first=i == 0, final=i == passes - 1),
                                 shape if i < passes - 1 else shape.replace("text string, ", ""))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"),
                        F.transform("spans", lambda s: F.struct(s[0].alias("first"), s[1].alias("end"))).alias("spans"), "items")


def _finder(windows, first: bool, final: bool):
    def find(batches) -> Iterator[pa.RecordBatch]:
        strings = list(windows.value)
        owners = [windows.value[s] for s in strings]
        n_words = np.array([s.count(b" ") - 1 for s in strings], np.int64)
        place = {s: i for i, s in enumerate(strings)}
        tables = [(t, np.array([place[s] for s in t.strings])) for t in searches(strings)]
        for batch in blocks(batches, "text", BLOCK_BYTES):
            flat_bytes, ends = normalised(*flat(batch.column("text")))
            is_word = (flat_bytes != 0x20) & (flat_bytes != END)
            word_at = np.flatnonzero(is_word[1:] & ~is_word[:-1]) + 1  # first bytes of words
            of_doc = np.searchsorted(word_at, ends)  # words before each text
            begins, which = [], []
            for search, at in tables:
                b, w = search.occurrences(flat_bytes)
                begins.append(b)
                which.append(at[w])
            begin = np.concatenate(begins) if begins else np.zeros(0, np.int64)
            string = np.concatenate(which) if which else np.zeros(0, np.int64)
            word = np.searchsorted(word_at, begin)  # a string begins with the space before its first word
            doc = np.searchsorted(ends, begin, side="right") - 1
            order = np.argsort(doc, kind="stable")
            word, string, doc = word[order], string[order], doc[order]
            spans, items = _old(batch, first)
            for d in np.unique(doc).tolist():
                here = slice(*np.searchsorted(doc, [d, d + 1]))
                starts = word[here] - of_doc[d]
                spans[d] = _union(spans[d] + list(zip(starts.tolist(), (starts + n_words[string[here]]).tolist(), strict=True)))
                items[d] = sorted({*items[d], *(item for s in set(string[here].tolist()) for item in owners[s])})
            columns = [batch.column("doc_id"), pa.array(np.diff(of_doc)), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                       pa.array(items, pa.list_(pa.string()))]
            names = ["doc_id", "n_words", "spans", "items"]
            if not final:
                columns.insert(1, batch.column("text"))
                names.insert(1, "text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return find


def _old(batch: pa.RecordBatch, first: bool) -> tuple[list, list]:
    if first:
        return [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
    return batch.column("spans").to_pylist(), batch.column("items").to_pylist()


def _union(spans: list) -> list[list[int]]:
    """Maximal runs: spans that overlap or touch become one."""
    out: list[list[int]] = []
    for begin, end in sorted(map(tuple, spans)):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out
