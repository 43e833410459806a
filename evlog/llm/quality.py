"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage is
encoded, a gated attention gives it a weight within its document, and the
weighted sum of the encodings is classified. All parts are learned together
from document labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlog.llm.common import held_out, id_remainder, sample_per_class
from evlog.llm.tokens import NOT_SPACE, U64, Words, blocks, byte_set, flat

FOLDS, TEST = 3, 1  # of crc32(doc_id): labels of remainder TEST are never learned from
PER_CLASS = 1500  # bound on the labelled documents of each class that are learned from
PER_DOCUMENT = 512  # passages of a document that are learned from; scoring reads all
PASSAGE = 64  # words
BLOCK_BYTES = 2 << 20
HIDDEN, ATTENTION = 16, 8
STEPS, RATE, DECAY = 250, 0.03, 1e-4
SEED = 7

#: Groups of bytes whose shares describe a passage; each byte is in the last group that has it.
GROUPS = (byte_set((0, 255)), byte_set((0x41, 0x5A)), byte_set((0x61, 0x7A)), byte_set((0x30, 0x39)), byte_set((0x80, 0xFF)),
          byte_set((0x20, 0x20)), byte_set((0x09, 0x0D)), byte_set((0x2E, 0x2E), (0x2C, 0x2C)), byte_set((0x21, 0x21), (0x3F, 0x3F)),
          byte_set((0x23, 0x26), (0x2A, 0x2A)), byte_set((0x7C, 0x7C)), byte_set((0x28, 0x29), (0x5B, 0x5B), (0x5D, 0x5D)))
N_FEATURES = len(GROUPS) + 6


def passage_features(data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage of ``PASSAGE`` words, in order, and the number of passages of each text.

    A text without words is one passage without any: its features are 0 but for the shares of its bytes.
    """
    group = np.zeros(256, np.int64)
    for i, flags in enumerate(GROUPS):
        group[flags] = i
    hashes, counts = words.hashes(data, offsets)
    starts, ends, _ = words.spans(data, offsets)
    n = np.maximum(1, -(-counts // PASSAGE))  # passages of each text
    first = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    passage = first[doc] + within // PASSAGE
    # Bytes belong to the passage of the word that is or follows next before them; a text's first bytes to its first passage.
    cuts = offsets[:-1].repeat(n)
    opening = np.flatnonzero((within % PASSAGE == 0) & (within > 0))
    cuts[passage[opening]] = starts[opening]
    sizes = np.diff(np.append(cuts, len(data)))
    total = int(n.sum())
    cells = np.bincount(np.repeat(np.arange(total) * len(GROUPS), sizes) + group[data], minlength=total * len(GROUPS))
    shares = cells.reshape(total, len(GROUPS)) / np.maximum(sizes, 1)[:, None]

    def per_passage(values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(passage, values, minlength=total).astype(float)

    n_words = per_passage()
    keys = np.sort((passage.astype(U64) << U64(40)) | (hashes >> U64(24)))  # few words to a passage: 40 bits tell them apart
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount((keys[new] >> U64(40)).astype(np.int64), minlength=total)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    length = (ends - starts).astype(float)
    some = np.maximum(n_words, 1)
    mean = per_passage(length) / some
    spread = np.sqrt(np.maximum(per_passage(length ** 2) / some - mean ** 2, 0))
    more = np.column_stack((n_words / PASSAGE, distinct / some, per_passage(again) / some, mean / 10, spread / 10,
                            per_passage((length <= 3).astype(float)) / some))
    return np.hstack((shares, more)), n


class MilModel:
    """Encoder, gated attention and classifier, with the scale of the features."""

    NAMES = ("encode", "encode_b", "gate_v", "gate_u", "attend", "classify", "classify_b")

    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray]):
        self.centre, self.scale, self.weights = centre, scale, weights

    def forward(self, features: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = np.clip((features - self.centre) / self.scale, -6, 6)
        h = np.tanh(x @ w["encode"] + w["encode_b"])
        tanh, gate = np.tanh(h @ w["gate_v"]), 1 / (1 + np.exp(-(h @ w["gate_u"])))
        raw = (tanh * gate) @ w["attend"]
        start = np.cumsum(n) - n
        power = np.exp(raw - np.repeat(np.maximum.reduceat(raw, start), n))
        share = power / np.repeat(np.add.reduceat(power, start), n)
        bag = np.add.reduceat(h * share[:, None], start, axis=0)
        score = 1 / (1 + np.exp(-np.clip(bag @ w["classify"] + w["classify_b"], -30, 30)))
        return {"x": x, "h": h, "tanh": tanh, "gate": gate, "share": share, "bag": bag, "score": score}

    def gradients(self, features: np.ndarray, n: np.ndarray, target: np.ndarray, of_bag: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted cross entropy."""
        w, f = self.weights, self.forward(features, n)
        start = np.cumsum(n) - n
        d_logit = (f["score"] - target) * of_bag
        d_bag = np.repeat(d_logit[:, None] * w["classify"], n, axis=0)
        d_share = (d_bag * f["h"]).sum(axis=1)
        d_raw = f["share"] * (d_share - np.repeat(np.add.reduceat(d_share * f["share"], start), n))
        d_both = d_raw[:, None] * w["attend"]
        d_tanh, d_gate = d_both * f["gate"] * (1 - f["tanh"] ** 2), d_both * f["tanh"] * f["gate"] * (1 - f["gate"])
        d_h = d_bag * f["share"][:, None] + d_tanh @ w["gate_v"].T + d_gate @ w["gate_u"].T
        d_in = d_h * (1 - f["h"] ** 2)
        return {"encode": f["x"].T @ d_in, "encode_b": d_in.sum(axis=0), "gate_v": f["h"].T @ d_tanh, "gate_u": f["h"].T @ d_gate,
                "attend": (f["tanh"] * f["gate"]).T @ d_raw, "classify": f["bag"].T @ d_logit, "classify_b": d_logit.sum(keepdims=True)}


def train(features: np.ndarray, n: np.ndarray, target: np.ndarray, steps: int = STEPS) -> MilModel:
    """Adam over all bags at once; both classes weigh the same."""
    random = np.random.default_rng(SEED)
    size = features.shape[1]
    shapes = {"encode": (size, HIDDEN), "encode_b": (HIDDEN,), "gate_v": (HIDDEN, ATTENTION), "gate_u": (HIDDEN, ATTENTION),
              "attend": (ATTENTION,), "classify": (HIDDEN,), "classify_b": (1,)}
    weights = {k: random.normal(0, 1 / np.sqrt(s[0]), s) if not k.endswith("_b") else np.zeros(s) for k, s in shapes.items()}
    model = MilModel(features.mean(axis=0), np.maximum(features.std(axis=0), 1e-3), weights)
    share = np.array([max(np.mean(target == c), 1e-9) for c in (0, 1)])
    of_bag = 0.5 / share[target.astype(int)] / len(target)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    for step in range(1, steps + 1):
        for k, g in model.gradients(features, n, target, of_bag).items():
            g = g + DECAY * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] -= RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def _spread(n: int, most: int) -> np.ndarray:
    """All of n places, or ``most`` evenly spread ones, the first and last among them."""
    return np.arange(n) if n <= most else np.linspace(0, n - 1, most).astype(int)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
        per_class: int = PER_CLASS, per_document: int = PER_DOCUMENT) -> MilModel | None:
    """The model of a bounded sample of the training fold's labelled documents; None if that lacks a class.

    Labels that aren't 0 or 1 and rows without an id or text are left out; of several labels of a document the largest holds, and
    of several texts that with the smallest digest. A document of more than ``per_document`` passages is learned from as many, evenly spread ones.
    """
    marked = (labels.filter(F.col(label).isin(0, 1) & (id_remainder(doc_id, FOLDS) != TEST))
              .groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label")))
    sample = sample_per_class(marked, "label", "id", per_class)  # at most two times per_class rows

    def featured(batches):
        words = Words(NOT_SPACE)
        for batch in blocks(batches, "text", BLOCK_BYTES):
            features, n = passage_features(*flat(batch.column("text")), words)
            rows = [r[_spread(len(r), per_document)] for r in np.split(features.astype(np.float32), np.cumsum(n)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())],
                                             ["id", "label", "n", "features"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = (docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("text IS NOT NULL")
            .join(F.broadcast(sample), "id").groupBy("id", "label")
            .agg(F.min(F.struct(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text")).getField("text").alias("text"))
            .mapInArrow(featured, f"id {kind}, label int, n bigint, features binary").orderBy("id", "label", "features").collect())
    target = np.array([r["label"] for r in rows], float)
    if len(set(target)) < 2:
        return None
    features = np.frombuffer(b"".join(bytes(r["features"]) for r in rows), np.float32).reshape(-1, N_FEATURES).astype(float)
    return train(features, np.array([r["n"] for r in rows]), target)


def score(docs: DataFrame, model: MilModel | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, a row for each row of ``docs``.

    score, 0 to 1, is higher the likelier label 1 is; predicted is 1 from 0.5 on. Whole texts are read and nothing else. A null,
    empty or wordless text is scored as one passage without words. Without a model every score is 0.5. Repeated rows get equal scores.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def scored(batches):
        words = Words(NOT_SPACE)
        for batch in blocks(batches, "text", BLOCK_BYTES):
            found = np.full(batch.num_rows, 0.5)
            if model:
                found = model.forward(*passage_features(*flat(batch.column("text")), words))["score"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    found = (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(scored, f"doc_id {kind}, score double"))
    return found.select("doc_id", held_out("doc_id", FOLDS, TEST).alias("held_out"), "score",
                        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
