"""Words of whole texts as arrays, for functions that run over Arrow batches.

Everything works on the UTF-8 bytes of many texts at once: a text is a range
of one byte array. Word rules here only name ASCII bytes, so bytes and code
points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """256 flags, set for the bytes in the given inclusive ranges."""
    flags = np.zeros(256, bool)
    for low, high in ranges:
        flags[low:high + 1] = True
    return flags


#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in lower-cased text; upper-case letters count, as they are lowered.
ALPHANUMERIC = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def lower_table() -> np.ndarray:
    """Each byte with A-Z lowered."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit moves every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end, and the offsets of the texts (one more than there are texts). Null reads as empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most ``max_bytes`` of text; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + max_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end


class Words:
    """Finds words and gives each a 64-bit hash of its bytes with A-Z lowered."""

    CHUNK = 2 << 20  # bytes of text hashed at a time

    def __init__(self, word_bytes: np.ndarray):
        self.word = word_bytes
        self.value = mix((lower_table().astype(U64) + U64(1)) * U64(MULTIPLIER))
        self.value[~word_bytes] = 0
        self.power = self.inverse = np.ones(1, U64)

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and end of every word in order, and the number of words of each text."""
        inside = self.word[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # a word ends where its text ends
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, offsets))

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words in order, and the number of words of each text."""
        found, counts, i, n = [], [], 0, len(offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + self.CHUNK, side="right")) - 1)
            part = data[offsets[i]:offsets[j]]
            starts, ends, count = self.spans(part, offsets[i:j + 1] - offsets[i])
            found.append(self._hash(part, starts, ends))
            counts.append(count)
            i = j
        return (np.concatenate(found), np.concatenate(counts)) if found else (np.zeros(0, U64), np.zeros(0, np.int64))

    def _hash(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.power) < len(data):
            size = max(len(data), min(self.CHUNK, 2 * len(self.power)))
            self.power = np.cumprod(np.full(size, MULTIPLIER, U64))
            self.inverse = np.cumprod(np.full(size, INVERSE, U64))
        if not len(starts):
            return np.zeros(0, U64)
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(self.value[data] * self.power[:len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(U64))


def pack(values: np.ndarray) -> bytes:
    """An array as compressed bytes, equal bytes of neighbours together."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, n: int, dtype: type) -> np.ndarray:
    """The array of ``n`` values that ``pack`` was given."""
    if not n:
        return np.zeros(0, dtype)
    width = np.dtype(dtype).itemsize
    raw = pa.decompress(packed, n * width, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(width, n).T.copy().view(dtype).ravel()
