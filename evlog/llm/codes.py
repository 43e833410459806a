"""Vector codes: product quantisation by k-means whose exact distances are skipped by norm-of-sum bounds.

A vector is cut into equal parts, and each part position has a small codebook.
The codebooks of all rounds are kept. A lower bound on a part's distance to a
group of entries is an exact distance and the round it was measured in (its
stamp). In a later round the bound sinks by how far an entry has moved since
that stamp: the length of the sum of its moves, never more than the sum of their
lengths that a drifting bound would lose. Only groups whose bound doesn't clear
the distance to the own entry are measured again.

All arithmetic that decides is on integers; bounds are rounded to the safe side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlog.llm.common import discard
from evlog.session import materialize, work_path

SCALE = 4096
LIMIT = 1 << 28  # of an integer component: 64 squared differences still add up in 64 bits
PARTS, ENTRIES, ROUNDS = 8, 16, 6
GROUPS = 4  # of entries that share a bound
ROWS = 4096  # vectors worked on at a time
MAX_BROADCAST_LABELS = 200_000
SAFE = 1e-9  # relative, far above the rounding of square roots
FAR = np.iinfo(np.int64).max  # stands for a distance that wasn't measured

State = tuple[np.ndarray, np.ndarray, np.ndarray]


# ---- a few vectors ---------------------------------------------------------------------------------

def new_state(n: int, parts: int, groups: int) -> State:
    """(codes, bounds, stamps) that know nothing: every bound fails, so the first round measures all."""
    return np.zeros((n, parts), np.uint8), np.full((n, parts, groups), -1, np.float16), np.zeros((n, parts, groups), np.uint8)


def _down(x: np.ndarray) -> np.ndarray:
    """In half precision, never rounded up."""
    x = np.clip(x, -1.0, 65504.0)  # all negative bounds fail alike
    half = x.astype(np.float16)
    return np.where(half > x, np.nextafter(half, np.float16(-np.inf)), half)


def _sunk(history: np.ndarray, part: int, groups: list[np.ndarray]) -> np.ndarray:
    """``[stamp, group, own]``: the furthest that an entry of the group, other than ``own``, is from where it was at the stamp."""
    now = history[-1, part]
    net = np.sqrt(((now[None] - history[:, part]) ** 2).sum(axis=2).astype(np.float64)) * (1 + SAFE)
    out = np.zeros((len(history), len(groups), len(now)))
    for g, members in enumerate(groups):
        out[:, g, :] = net[:, members].max(axis=1, initial=0)[:, None]
        for own in members:
            out[:, g, own] = net[:, members[members != own]].max(axis=1, initial=0)
    return out


def assign(x: np.ndarray, state: State, history: np.ndarray) -> tuple[State, np.ndarray, int]:
    """Each part's nearest entry (the first of equally near ones) in the last codebook of ``history``.

    ``x`` is ``[n, parts, width]`` and ``history`` ``[rounds, parts, entries, width]``,
    both integers. Returns the new state, the squared distances ``[n, parts]`` and how
    many distances were measured. A bound is on its group's entries without the part's own one.
    """
    codes, bounds, stamps = (a.copy() for a in state)
    n, parts, _ = x.shape
    round_, entries = len(history) - 1, history.shape[2]
    groups = np.array_split(np.arange(entries), bounds.shape[2])
    group_of = np.concatenate([np.full(len(m), g) for g, m in enumerate(groups)])
    best, measured, every = np.zeros((n, parts), np.int64), n * parts, np.arange(n)
    for p in range(parts):
        book, before = history[-1, p], codes[:, p].astype(np.int64)
        near = ((x[:, p] - book[before]) ** 2).sum(axis=1)
        sunk = bounds[:, p].astype(np.float64) - _sunk(history, p, groups)[stamps[:, p], np.arange(len(groups))[None, :], before[:, None]]
        again = sunk <= (np.sqrt(near.astype(np.float64)) * (1 + SAFE))[:, None]
        apart = np.full((n, entries), FAR)
        apart[every, before] = near
        for g, members in enumerate(groups):
            rows = np.flatnonzero(again[:, g])
            if len(rows) and len(members):
                apart[rows[:, None], members] = ((x[rows, p][:, None, :] - book[members][None]) ** 2).sum(axis=2)
                measured += len(rows) * len(members)
        own = apart.argmin(axis=1)
        best[:, p] = apart[every, own]
        apart[every, own] = FAR
        for g, members in enumerate(groups):
            least = _down(np.sqrt(apart[:, members].min(axis=1, initial=FAR).astype(np.float64)) * (1 - SAFE))
            # A group that wasn't measured gets the part's former entry as a member: its distance is known.
            joined = ~again[:, g] & (own != before) & (group_of[before] == g)
            bounds[:, p, g] = np.where(again[:, g], least, np.where(joined, np.minimum(least, _down(sunk[:, g])), bounds[:, p, g]))
            stamps[:, p, g] = np.where(again[:, g] | joined, round_, stamps[:, p, g])
        codes[:, p] = own
    return (codes, bounds, stamps), best, measured


def moves(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """How the counts ``[parts, entries]`` and sums ``[parts, entries, width]`` of the entries' parts change."""
    n, parts, width = x.shape
    counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    for p in range(parts):
        rows = np.arange(n) if old is None else np.flatnonzero(old[:, p] != new[:, p])
        np.add.at(counts[p], new[rows, p], 1)
        np.add.at(sums[p], new[rows, p], x[rows, p])
        if old is not None:
            np.subtract.at(counts[p], old[rows, p], 1)
            np.subtract.at(sums[p], old[rows, p], x[rows, p])
    return counts, sums


# ---- columns ---------------------------------------------------------------------------------------

def _binary(matrix: np.ndarray) -> pa.Array:
    """A row of bytes for each row of the matrix."""
    raw = np.ascontiguousarray(matrix).reshape(len(matrix), -1).view(np.uint8) if matrix.size else np.zeros((len(matrix), 0), np.uint8)
    offsets = np.arange(len(raw) + 1, dtype=np.int64) * raw.shape[1]
    return pa.Array.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _matrix(column: pa.Array, dtype: type, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), *shape)


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    """``[n, dim]``; a row has two or four bytes for each component."""
    out = np.zeros((len(column), dim), np.int64)
    if dim:
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // dim
        for size, dtype in ((2, "<i2"), (4, "<i4")):
            rows = np.flatnonzero(sizes == size)
            if len(rows):
                out[rows] = _matrix(column.take(pa.array(rows)), dtype, (dim,))
    return out


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, dim, vector) of the vectors without null or non-finite components."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            vectors = batch.column("vector")
            lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            values = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            kept = (lengths >= 0) & (bad[starts + np.maximum(lengths, 0)] == bad[starts])
            for dim in np.unique(lengths[kept]).tolist():
                rows = np.flatnonzero(kept & (lengths == dim))
                scaled = np.floor(values[starts[rows][:, None] + np.arange(dim)] * SCALE)
                most = np.abs(scaled).max(axis=1, initial=0)
                if (most >= LIMIT).any():
                    raise ValueError(f"a component of {most.max() / SCALE:g} is beyond the supported {LIMIT // SCALE}")
                for wide in (False, True):
                    which = np.flatnonzero((most >= 1 << 15) == wide)
                    if len(which):
                        take = pa.array(rows[which])
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("id").take(take), batch.column("label").take(take), pa.array(np.full(len(which), dim, np.int32)),
                             _binary(scaled[which].astype("<i4" if wide else "<i2"))], ["id", "label", "dim", "vector"])


def _round(history: np.ndarray, dim: int, groups: int, first: bool) -> Callable:
    """A round over the table of the round before: new state, and in one more row for each task what its parts moved."""
    parts, entries = history.shape[1:3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, dim // parts), np.int64)
        kinds = None
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                kinds = [batch.column(c).type for c in ("id", "label")]
                x = _integers(batch.column("vector"), dim).reshape(batch.num_rows, parts, dim // parts)
                state = new_state(batch.num_rows, parts, groups) if first else _state(batch, parts, groups)
                found, _, _ = assign(x, state, history)
                more = moves(x, None if first else state[0], found[0], entries)
                counts += more[0]
                sums += more[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("label"), batch.column("vector"), *map(_binary, found),
                     pa.nulls(batch.num_rows, MOVED)], ["id", "label", "vector", "codes", "bounds", "stamps", "moved"])
        if kinds:
            slots = np.flatnonzero((sums.reshape(parts * entries, -1) != 0).any(axis=1) | (counts.ravel() != 0))
            row = [{"slot": s, "count": c, "sums": v} for s, c, v in zip(
                slots.tolist(), counts.ravel()[slots].tolist(), sums.reshape(parts * entries, -1)[slots].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), *(pa.nulls(1, pa.binary()) for _ in range(4)), pa.array([row], MOVED)],
                ["id", "label", "vector", "codes", "bounds", "stamps", "moved"])

    return run


MOVED = pa.list_(pa.struct([("slot", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(pa.int64()))]))
MOVED_SQL = "array<struct<slot:int,count:bigint,sums:array<bigint>>>"


def _state(batch: pa.RecordBatch, parts: int, groups: int) -> State:
    return (_matrix(batch.column("codes"), np.uint8, (parts,)), _matrix(batch.column("bounds"), np.float16, (parts, groups)),
            _matrix(batch.column("stamps"), np.uint8, (parts, groups)))


def _last(history: np.ndarray, dim: int, groups: int, first: bool) -> Callable:
    """Rows (id, label, code, error) by the final codebooks."""
    parts = history.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = _integers(batch.column("vector"), dim).reshape(batch.num_rows, parts, dim // parts)
                state = new_state(batch.num_rows, parts, groups) if first else _state(batch, parts, groups)
                (codes, _, _), best, _ = assign(x, state, history)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("label"), pa.array([row.tobytes().hex() for row in codes], pa.string()),
                     pa.array(best.sum(axis=1))], ["id", "label", "code", "error"])

    return run


# ---- tables ----------------------------------------------------------------------------------------

def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS) -> tuple[DataFrame, np.ndarray]:
    """``(id, label, code, error)`` for each vector, and the codebooks of all rounds, ``[rounds + 1, parts, entries, width]``.

    Vectors that are null or hold null or non-finite components are left out. The dimension is the
    length that most of the others have (the larger of equally frequent ones), and must be a multiple of ``parts``; a
    vector of another length has null for code and error. The first codebooks are the parts of the vectors with the smallest
    ids (ids that repeat are in the order of their quantised vectors, null ids come last); with fewer than ``entries`` vectors there
    are as many entries. Equal vectors have equal codes. Without any vector the result is empty, as are the codebooks.
    A component beyond 65,536 is an error, as the integers would overflow. At most 255 rounds and 256 entries.

    Each round writes the vectors with their bounds to the shared folder and reads them in the next one; the folder before is removed
    then. A task adds up what its parts moved, so only ``parts * entries`` sums reach the driver.
    """
    if not (1 <= entries <= 256 and 0 <= rounds <= 255 and 1 <= groups <= entries and parts >= 1):
        raise ValueError("entries must be 1 to 256, rounds 0 to 255, groups 1 to entries, parts at least 1")
    spark = vectors.sparkSession
    columns = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    kinds = {c: columns.schema[c].dataType.simpleString() for c in ("id", "label")}
    keep = f"id {kinds['id']}, label {kinds['label']}"
    folder = work_path(spark, "codes-vectors")
    columns.mapInArrow(_quantise, f"{keep}, dim int, vector binary").write.parquet(folder)
    quantised = spark.read.parquet(folder)
    dims = quantised.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not dims:
        return spark.createDataFrame([], f"{keep}, code string, error bigint"), np.zeros((rounds + 1, parts, 0, 0), np.int64)
    dim = dims[0]["dim"]
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    others = quantised.filter(F.col("dim") != dim)
    current = quantised.filter(F.col("dim") == dim)
    history = _seeds(current, dim, parts, entries)
    counts, sums = np.zeros(history.shape[1:3], object), np.zeros(history.shape[1:], object)
    state = f"{keep}, vector binary, codes binary, bounds binary, stamps binary, moved {MOVED_SQL}"
    before = None
    for i in range(rounds):
        path = work_path(spark, f"codes-round{i}")
        groups_now = min(groups, history.shape[2])
        current.mapInArrow(_round(history, dim, groups_now, i == 0), state).write.parquet(path)
        written = spark.read.parquet(path)
        _add_moves(written, counts, sums)
        book = history[-1].copy()
        for p, e in zip(*np.nonzero(counts), strict=True):
            book[p, e] = [int(s) // int(counts[p, e]) for s in sums[p, e]]
        history = np.concatenate((history, book[None]))
        current = written.filter("vector IS NOT NULL")
        if before:
            discard(spark, before)
        before = path
    coded = current.mapInArrow(_last(history, dim, min(groups, history.shape[2]), rounds == 0), f"{keep}, code string, error bigint")
    rest = others.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    return coded.unionByName(rest), history


def _seeds(quantised: DataFrame, dim: int, parts: int, entries: int) -> np.ndarray:
    """``[1, parts, entries, width]`` from the vectors with the smallest ids."""
    ids = quantised.select("id").orderBy(F.asc_nulls_last("id")).limit(entries).collect()
    near = quantised if ids[-1][0] is None else quantised.filter(F.col("id") <= F.lit(ids[-1][0]))
    rows = near.select("id", "vector").orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()
    first = _integers(pa.array([bytes(r["vector"]) for r in rows], pa.binary()), dim)
    return first.reshape(len(rows), parts, dim // parts).transpose(1, 0, 2)[None].copy()


def _add_moves(written: DataFrame, counts: np.ndarray, sums: np.ndarray) -> None:
    """Adds the tasks' moves, in exact integers."""
    each = written.filter("moved IS NOT NULL").select(F.explode("moved").alias("m")).select(
        "m.slot", F.posexplode(F.concat(F.array("m.count"), F.col("m.sums"))).alias("at", "value"))
    entries = counts.shape[1]
    for slot, at, value in each.groupBy("slot", "at").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect():
        if at == 0:
            counts[slot // entries, slot % entries] += int(value)
        else:
            sums[slot // entries, slot % entries, at - 1] += int(value)


def codebook_digest(book: np.ndarray) -> str:
    """SHA-256 of all integers of ``[parts, entries, width]`` in that order, as decimals with commas between."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` (written once) with ``label_error``, the sum of ``error`` over the rows with the same label (nulls together)."""
    coded = materialize(coded)
    # One row for each label, computed apart: the join reads a table on both sides, so a very frequent label can be split.
    totals = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"))
    if totals.count() <= MAX_BROADCAST_LABELS:
        totals = F.broadcast(totals)
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
