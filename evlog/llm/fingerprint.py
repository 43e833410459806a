"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

Each paragraph is hashed to a wide vector of +1 and -1; a document's
fingerprint is the sum of its paragraphs' vectors, each entry modulo a power of two.
The order of paragraphs doesn't matter, and inserting or deleting one is adding
or subtracting its vector. As the vectors of different paragraphs are nearly
orthogonal, the squared length of the difference of two fingerprints estimates
how many paragraphs differ.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evlog.llm.tokens import blocks
from evlog.session import materialize

WIDTH = 256  # entries of a fingerprint
ENTRY = np.dtype("<u2")  # modulo 2**16
ID_RANGE = 1024  # wanted documents in a group when they're put in order
MAX_BROADCAST_GROUPS = 200_000
BLOCK_BYTES = 4 << 20
CHUNK = 2048  # paragraph vectors held at a time


def paragraphs(text: str) -> list[str]:
    """Lines with white space around them removed, without empty ones."""
    return [p for line in text.split("\n") if (p := line.strip())]


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row for each text: the sum of its paragraphs' vectors, zeros for none."""
    found = np.zeros((len(texts), WIDTH), ENTRY)
    hashes: list[bytes] = []
    owners: list[int] = []

    def add() -> None:
        bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(len(hashes), WIDTH // 8), axis=1)
        first = np.flatnonzero(np.diff(owners, prepend=-1))
        sums = np.add.reduceat(bits.astype(ENTRY) * ENTRY.type(2) - ENTRY.type(1), first, axis=0, dtype=ENTRY)
        found[np.array(owners)[first]] += sums
        hashes.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for part in paragraphs(text):
            hashes.append(hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=WIDTH // 8).digest())
            owners.append(i)
            if len(hashes) >= CHUNK:
                add()
    if hashes:
        add()
    return found


def fingerprint(text: str | None) -> np.ndarray:
    return fingerprints([text or ""])[0]


def insert(value: np.ndarray, part: str) -> np.ndarray:
    """The fingerprint with one more paragraph, wherever it stands."""
    return value + fingerprint(part)


def delete(value: np.ndarray, part: str) -> np.ndarray:
    """The fingerprint without one of the paragraphs."""
    return value - fingerprint(part)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of fingerprints, 1 if equal, about 0 without a common paragraph, and the shared part between: twice the inner
    product over the sum of the squared lengths."""
    x, y = (v.view(np.dtype("<i2")).astype(np.float64) for v in (a, b))
    inner, lengths = np.einsum("ij,ij->i", x, y), np.einsum("ij,ij->i", x, x) + np.einsum("ij,ij->i", y, y)
    return np.where((a == b).all(axis=1), 1.0, np.clip(2 * inner / np.maximum(lengths, 1.0), 0.0, 1.0))


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(id, text, next)``: each text with that of the next smaller (numeric) id; the smallest is followed by the largest.

    Rows with one id are ordered by a hash of their text, and rows without an id come last in that order. Null texts are empty.

    Ids are cut into ranges of about ``ID_RANGE`` rows, and a window puts each range in order. The text that follows the
    last row of a range is brought into it as a guest before the shuffle, so whole texts move once.
    """
    base = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    low, high, n = base.agg(F.min("id"), F.max("id"), F.count("id")).first()
    width = max(1, -(-(high - low + 1) // max(1, n // ID_RANGE))) if n else 1
    while True:
        # Rows without an id are ranged by their hash.
        band = F.when(F.col("id").isNull(), F.lit(-1 << 63)).otherwise(F.floor(F.col("id") / F.lit(width))).cast("bigint")
        ranged = base.withColumn("band", band).withColumn("spread", F.when(F.col("id").isNull(), F.shiftright("hash", 52)).otherwise(0).cast("bigint"))
        heads = materialize(ranged.groupBy("band", "spread").agg(F.max(F.struct("id", F.bitwise_not("hash").alias("not_hash"))).alias("head"),
                                                                 F.count("*").alias("n")))
        most = heads.filter("band <> -9223372036854775808").agg(F.max("n")).first()[0] or 0
        if most <= 16 * ID_RANGE or width <= ID_RANGE:
            break
        width = max(ID_RANGE, width * ID_RANGE // most)  # ids are crowded somewhere: finer ranges everywhere
    # A row for each range, in one task: about one for ID_RANGE documents, without texts.
    turn = Window.partitionBy(F.lit(0)).orderBy(F.desc("band"), F.asc("spread"))
    follow = (heads.select("band", "spread", F.coalesce(F.lead("head").over(turn), F.first("head").over(turn)).alias("head"))
              .select(F.col("band").alias("to_band"), F.col("spread").alias("to_spread"), F.col("head.id").alias("head_id"),
                      F.bitwise_not("head.not_hash").alias("head_hash")))
    if heads.count() <= MAX_BROADCAST_GROUPS:
        follow = F.broadcast(follow)
    guests = (base.join(follow, (F.col("hash") == F.col("head_hash")) & F.col("id").eqNullSafe(F.col("head_id")))
              .select("id", "text", "hash", F.col("to_band").alias("band"), F.col("to_spread").alias("spread"), F.lit(True).alias("guest")))
    order = Window.partitionBy("band", "spread").orderBy("guest", F.desc_nulls_last("id"), "hash")
    return (ranged.withColumn("guest", F.lit(False)).unionByName(guests)
            .withColumn("next", F.lead("text").over(order)).filter(~F.col("guest")).select("id", "text", "next"))


def compare_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``, a row for each of ``docs``.

    The edited text has its last third (rounded down, in code points) replaced by as many first ones of the next document
    (``with_next``). Fingerprints are the hex digits of their entries. Null and empty texts have no paragraph, and their
    fingerprint is zero, like every text of white space only; equal fingerprints have likeness 1.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def fingerprinted(batches):
        for batch in blocks(batches, "text", BLOCK_BYTES):
            texts, nexts = batch.column("text").to_pylist(), batch.column("next").to_pylist()
            cuts = [len(t) // 3 for t in texts]
            edited = [t[:len(t) - c] + n[:c] for t, n, c in zip(texts, nexts, cuts, strict=True)]
            place = {t: i for i, t in enumerate(dict.fromkeys(texts + nexts))}  # most texts are another row's next one too
            known = fingerprints(list(place))
            own, of_next, of_edited = known[[place[t] for t in texts]], known[[place[t] for t in nexts]], fingerprints(edited)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(map(len, texts), pa.int64()),
                 pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                 pa.array([v.tobytes().hex() for v in own], pa.string()), pa.array([v.tobytes().hex() for v in of_edited], pa.string()),
                 pa.array(likeness(own, of_edited)), pa.array(likeness(own, of_next))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs, text, doc_id).mapInArrow(
        fingerprinted, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                       "near_edited double, near_next double")
