"""MinHash near-dedup by min-max hashing.

Each permutation of the shingle hashes yields two signature values, the
minimum and the maximum, so half as many hashes are evaluated for a signature
of the same length. Both agree between two sets with their Jaccard similarity
as probability, and as they're negatively correlated the share of agreeing
values varies less than with independent minima.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evlog.llm.common import mark_possible
from evlog.llm.components import components, tight
from evlog.llm.tokens import MULTIPLIER, NOT_SPACE, U64, Words, blocks, flat, mix
from evlog.session import materialize

SHINGLE = 5
PERCENT = 75
#: 100 permutations give 200 values in 40 bands of 5: a pair at 0.75 shares no band with probability 2e-5, at 0.85 with 6e-11.
PERMUTATIONS = 100
ROWS = 5
BLOCK_BYTES = 4 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: Words, width: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    hashes, counts = words.hashes(data, offsets)
    power = [U64(pow(MULTIPLIER, 2 * j + 3, 1 << 64)) for j in range(width)]
    n = max(0, len(hashes) - width + 1)
    runs = np.zeros(n, U64)
    for j in range(width):
        runs += hashes[j:j + n] * power[j]
    runs = mix(runs)
    end = 0
    for count in counts.tolist():
        start, end = end, end + count
        if count >= width:
            yield np.unique(runs[start:end - width + 1])
        elif count:
            yield mix(np.sum(hashes[start:end] * np.array(power[:count], U64), keepdims=True) + U64(count))
        else:
            yield np.zeros(0, U64)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE, percent: int = PERCENT,
                    permutations: int = PERMUTATIONS, rows: int = ROWS, carry: str | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each row of ``docs``.

    A text's set holds its distinct shingles of ``width`` words (all words as one
    shingle, if there are fewer). Texts are linked if the intersection is at
    least ``percent`` % of the union; component_id is the smallest doc_id that
    links lead to, kept tells whether it is the row's own.

    * Equal sets are one class, found by a digest and represented by their
      smallest doc_id; classes are compared, so copies never make pairs.
    * In each band bucket all members are compared with the smallest one, by their
      full sets. Members that this leaves in different components are compared with
      each other if they share one of their rarest shingles, as linked sets must.
    * Null or wordless texts have no shingles and no links. A null doc_id links
      nothing: the row belongs to the component of an equal set if there is one
      and isn't kept; else component_id is null and it's kept. Rows with one
      doc_id are one document. No rows in, no rows out; other columns of
      ``docs`` are ignored, but for ``carry``, which each row keeps.
    """
    more = [carry] if carry else []
    kind = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    carried = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *(F.col(c).alias("carried") for c in more))
    signed = materialize(carried.mapInArrow(_signer(width, permutations, rows), "id " + kind + ", n bigint, digest binary, bands array<bigint>"
                                            + "".join(f", carried {docs.schema[c].dataType.simpleString()}" for c in more)))
    classes = materialize(signed.filter("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest")
                          .agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")))
    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("far")).filter("centre < far")
    members = tight(materialize(banded.join(shared.select("bucket", "centre"), "bucket")))
    labels = _linked(base, members, kind, width, percent)
    found = (classes.select("digest", "rep").join(labels, F.col("rep") == F.col("node"), "left")
             .select("digest", F.coalesce("root", "rep").alias("component")))
    own = F.coalesce("component", "id")
    return (signed.select("id", "n", "digest", *("carried" for _ in more)).join(found, "digest", "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"),
                    F.coalesce(F.col("id") == own, own.isNull()).alias("kept"), *(F.col("carried").alias(c) for c in more)))


def _signer(width: int, permutations: int, rows: int):
    seeds = mix(np.arange(1, 2 * permutations + 1, dtype=U64) * U64(MULTIPLIER)) >> U64(32)
    times, plus = seeds[:permutations].astype(np.uint32) | np.uint32(1), seeds[permutations:].astype(np.uint32)
    n_bands = 2 * permutations // rows
    weights = mix(np.arange(1, rows + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
    band_of = np.arange(n_bands, dtype=U64) * U64(MULTIPLIER)

    def signature(unique: np.ndarray) -> np.ndarray:
        low, high = np.full(permutations, 0xFFFFFFFF, np.uint32), np.zeros(permutations, np.uint32)
        short = (unique >> U64(32)).astype(np.uint32)
        for i in range(0, len(short), 2048):
            permuted = short[i:i + 2048] * times[:, None] + plus[:, None]
            np.minimum(low, permuted.min(axis=1), out=low)
            np.maximum(high, permuted.max(axis=1), out=high)
        return np.column_stack((low, high)).ravel()

    def sign(batches):
        words = Words(NOT_SPACE)
        for batch in blocks(batches, "text", BLOCK_BYTES):
            n, digests, bands = [], [], []
            for unique in shingle_sets(*flat(batch.column("text")), words, width):
                n.append(len(unique))
                if not len(unique):
                    digests.append(None)
                    bands.append(None)
                    continue
                digests.append(hashlib.blake2b(unique.tobytes(), digest_size=16).digest())
                values = signature(unique)
                sums = (values[:n_bands * rows].reshape(n_bands, rows).astype(U64) * weights).sum(axis=1, dtype=U64)
                bands.append(mix(sums + band_of).view(np.int64))
            carried = [c for c in batch.schema.names if c == "carried"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), *map(batch.column, carried)], ["id", "n", "digest", "bands", *carried])

    return sign


def _linked(base: DataFrame, members: DataFrame, kind: str, width: int, percent: int) -> DataFrame:
    """``(node, root)`` of the classes that links join."""
    nodes = tight(materialize(members.select("rep").distinct()))

    def sets(batches):
        words = Words(NOT_SPACE)
        for batch in blocks(batches, "text", BLOCK_BYTES):
            found = list(shingle_sets(*flat(batch.column("text")), words, width))
            codes = [int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "big", signed=True) for u in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(codes, pa.int64()),
                                              pa.array([u.view(np.int64) for u in found], pa.list_(pa.int64()))], ["id", "code", "shingles"])

    # The few sets of other rows that this lets in are in no pair.
    full = materialize(mark_possible(base, ["id"], nodes).filter("possible").select("id", "text")
                       .mapInArrow(sets, f"id {kind}, code bigint, shingles array<bigint>"))

    def confirm(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked, by their full sets. Only sets that a side names are moved for it."""
        pairs = tight(materialize(pairs))
        if pairs.isEmpty():
            return pairs

        def check(batches):
            for batch in batches:
                keep = []
                (x_all, x_at), (y_all, y_at) = ((c.values.to_numpy().view(U64), c.offsets.to_numpy()) for c in (batch.column("sa"), batch.column("sb")))
                for i in range(batch.num_rows):
                    x, y = x_all[x_at[i]:x_at[i + 1]], y_all[y_at[i]:y_at[i + 1]]
                    few, many = (x, y) if len(x) <= len(y) else (y, x)
                    if not len(few) or 100 * len(few) < percent * len(many):
                        keep.append(False)
                        continue
                    at = np.searchsorted(many, few)
                    same = int(np.count_nonzero(many[np.minimum(at, len(many) - 1)] == few))
                    keep.append(100 * same >= percent * (len(x) + len(y) - same))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        sa, sb = (mark_possible(full, ["id"], pairs.select(side)).filter("possible")
                  .select(F.col("id").alias(side), F.col("shingles").alias(f"s{side}")) for side in ("a", "b"))
        joined = pairs.join(sa, "a").join(sb, "b")
        return tight(materialize(joined.select("a", "b", "sa", "sb").mapInArrow(check, f"a {kind}, b {kind}")))

    # Most members are linked with the smallest centre of their buckets; other centres only matter where that leaves components apart.
    star = members.filter("rep <> centre").select("rep", "centre").distinct()
    first = star.groupBy("rep").agg(F.min("centre").alias("centre"))
    links = confirm(first.select(F.col("rep").alias("a"), F.col("centre").alias("b")))
    labels = components(links)
    ends = _labelled(star.join(first, ["rep", "centre"], "left_anti"), labels).withColumnsRenamed({"rep": "of", "comp": "of_comp", "centre": "rep"})
    more = confirm(_labelled(ends, labels).filter("comp <> of_comp").select(F.col("of").alias("a"), F.col("rep").alias("b")))
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)

    # What is left: members of a bucket, its centre aside, that are in different components so far.
    rest = _labelled(members.filter("rep <> centre"), labels)
    mixed = rest.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("bucket")
    left = tight(materialize(rest.join(mixed, "bucket", "left_semi").select("rep").distinct()))
    if left.isEmpty():
        return labels
    rare = _rare_shingles(mark_possible(full, ["id"], left).filter("possible").join(left, F.col("id") == F.col("rep"), "left_semi"), percent)
    # First with the smallest set that has the shingle, which of sets around a common part is linked if any is; then all the rest.
    for step in (_with_smallest, _with_each_other):
        more = confirm(step(_labelled(rare, labels), percent))
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
    return labels


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "rep")).drop("node", "root")


def _rare_shingles(full: DataFrame, percent: int) -> DataFrame:
    """``(shingle, rep, n, rank)``: of each set of n shingles the rarest ones with their ranks from 1, so many that sets to be
    linked share one, without those that no other set has.

    Linked sets share at least percent % of either, so in any common order of all shingles they share one of the first
    100 - percent % (and one more) of each. Rarest first keeps what many sets have out of these.
    """
    rows = full.select(F.col("id").alias("rep"), "code", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("sets")).filter("sets > 1")
    rows = rows.join(often, "shingle")
    of_set = Window.partitionBy("rep", "code")
    rank = F.col("n") - F.count("*").over(of_set) + F.row_number().over(of_set.orderBy("sets", "shingle"))
    first = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    return tight(materialize(rows.withColumn("rank", rank).filter(F.col("rank") <= first).select("shingle", "rep", "n", "rank").distinct()))


def _similar_size(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _with_smallest(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs of each shingle's smallest set with its other sets, if in different components."""
    hubs = (rare.groupBy("shingle").agg(F.min(F.struct("n", "rep", "comp")).alias("hub"), F.min("comp").alias("low"), F.max("comp").alias("high"))
            .filter("low < high").select("shingle", F.col("hub.n").alias("hub_n"), F.col("hub.rep").alias("b"), F.col("hub.comp").alias("hub_comp")))
    return (rare.join(hubs, "shingle").filter((F.col("comp") != F.col("hub_comp")) & _similar_size("n", "hub_n", percent))
            .select(F.col("rep").alias("a"), "b").distinct())


def _with_each_other(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets with a common shingle in different components, if they may be linked.

    If it's their first common one, what they share is it and at most what follows it in either, and what precedes it in
    either isn't shared. Sets that then can't be linked even with the one that has the shingle earliest are left out before pairs are made.
    """
    mixed = (rare.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("rank").alias("earliest"))
             .filter("low < high").select("shingle", "earliest"))
    shared = F.col("n") - F.col("rank") + 1
    rare = rare.join(mixed, "shingle").filter(100 * shared >= percent * (F.col("n") + F.col("earliest") - 1)).select("shingle", "rep", "n", "rank", "comp")
    other = rare.select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("rep", "n", "rank", "comp")))
    most = F.least(shared, F.col("n_b") - F.col("rank_b") + 1)
    return (rare.join(other, "shingle").filter((F.col("comp") < F.col("comp_b")) & (100 * most >= percent * (F.col("n") + F.col("n_b") - most)))
            .select(F.col("rep").alias("a"), F.col("rep_b").alias("b")).distinct())
