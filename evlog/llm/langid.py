"""Language identification with string kernels.

The kernel of two texts is the number of n-grams (1 to 3 bytes, all lengths
together) present in both, divided by the geometric mean of the numbers in
each. Kernel values with a set of landmark texts, whitened by the landmarks'
own kernel matrix (Nyström), are the features of one ridge regression for each
language against the rest. Only n-grams that a landmark has are compared.

With Z the landmarks' presence rows, scores of a batch of presence rows X are
``normalise(X) @ Z.T @ coefficients``. The last two matrices are constant, so
their product is made once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlog.llm.common import held_out, id_remainder, sample_per_class
from evlog.llm.tokens import blocks, byte_set, flat, lower_table

FOLDS, TEST = 5, 0  # of crc32(doc_id): remainder TEST is never learned from
#: Bound on the labelled rows that are learned from: so many of each language, among texts up to so many bytes.
PER_CLASS = 300
SAMPLE_TEXT_BYTES = 1 << 16
LANDMARKS = 60  # of each language, out of those rows
RIDGE = 0.05
SHARPNESS = 6.0  # of the softmax that turns scores to 0..1
BLOCK_BYTES = 2 << 20
CELLS = 8 << 20  # of a batch's presence matrix
UNKNOWN = "und"

#: ASCII bytes that aren't letters become one space for each run.
LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def letters_only(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with A-Z lowered and runs of other ASCII bytes as one space, each text with a space before and after."""
    n = len(offsets) - 1
    starts = offsets + np.arange(n + 1)
    spread = np.full(int(starts[-1]) + 1, 0x20, np.uint8)
    for i in range(n):
        spread[starts[i] + 1:starts[i + 1]] = data[offsets[i]:offsets[i + 1]]
    letter = LETTER[spread]
    out = np.where(letter, lower_table()[spread], np.uint8(0x20))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts[:-1]] = True  # a text's first space; the next text's stands for its last
    keep[-1] = True
    return out[keep], np.searchsorted(np.flatnonzero(keep), starts)


def gram_codes(text: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that begins at each byte, as a number below 256**n."""
    code = text[:max(0, len(text) - n + 1)].astype(np.int32)
    for j in range(1, n):
        code = code * 256 + text[j:len(text) - n + 1 + j]
    return code


class Presence:
    """Rows of which n-grams of a vocabulary occur in each text."""

    def __init__(self, vocabulary: list[np.ndarray]):
        """vocabulary: for n = 1, 2, 3 the codes of the n-grams."""
        self.tables, at = [], 0
        small = sum(map(len, vocabulary)) < 1 << 16
        for n, codes in enumerate(vocabulary, 1):
            places = np.zeros(256 ** n, np.uint16 if small else np.uint32)  # 0: not in the vocabulary
            places[codes] = np.arange(at + 1, at + len(codes) + 1)
            self.tables.append(places)
            at += len(codes)
        self.width = at + 1

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Presence as 0 and 1, the texts in batches of a bounded number of cells."""
        text, starts = letters_only(data, offsets)
        step = max(1, CELLS // self.width)
        for i in range(0, len(offsets) - 1, step):
            j = min(i + step, len(offsets) - 1)
            part, bounds = text[starts[i]:starts[j] + 1], starts[i:j + 1] - starts[i]
            base = np.repeat(np.arange(j - i, dtype=np.int64) * self.width, np.diff(bounds))
            cells = np.zeros((j - i) * self.width, np.uint8)
            for n, table in enumerate(self.tables, 1):
                places = table[gram_codes(part, n)[:len(base)]]
                for back in range(1, n - 1):  # n-grams that would reach into the next text
                    places[np.minimum(bounds[1:] - back, len(places) - 1)] = 0
                cells[base[:len(places)] + places] = 1
            found = cells.reshape(j - i, self.width)
            found[:, 0] = 0
            yield found


def unit(rows: np.ndarray) -> np.ndarray:
    """Presence rows divided by the root of their number of n-grams; a row without any stays 0."""
    size = rows.sum(axis=1, dtype=np.float32)
    return rows.astype(np.float32) / np.sqrt(np.maximum(size, 1))[:, None]


class KernelModel:
    def __init__(self, languages: list[str], vocabulary: list[np.ndarray], weights: np.ndarray, bias: np.ndarray):
        self.languages, self.vocabulary, self.weights, self.bias = languages, vocabulary, weights, bias


def train(texts: list[bytes], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """Kernel ridge regression, one language against the rest, on Nyström features."""
    names = sorted(set(languages))
    chosen = [i for name in names for i in [k for k, x in enumerate(languages) if x == name][:landmarks]]

    def flattened(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])

    clean, _ = letters_only(*flattened([texts[i] for i in chosen]))
    vocabulary = [np.unique(gram_codes(clean, n)) for n in (1, 2, 3)]
    presence = Presence(vocabulary)
    rows = unit(np.concatenate(list(presence.rows(*flattened(texts)))))
    marks = rows[chosen]
    values, vectors = np.linalg.eigh(marks @ marks.T)
    good = values > 1e-6 * max(values[-1], 1e-12)
    whiten = vectors[:, good] / np.sqrt(values[good])  # landmark kernel to the power -1/2, on its range
    features = rows @ marks.T @ whiten
    mean = features.mean(axis=0)
    target = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    share = target.mean(axis=0)
    centred = features - mean
    gram = centred.T @ centred + ridge * len(texts) * np.eye(centred.shape[1]) / centred.shape[1]
    coefficients = np.linalg.solve(gram, centred.T @ (target - share))
    weights = marks.T @ (whiten @ coefficients)
    return KernelModel(names, vocabulary, weights.astype(np.float32), (share - mean @ coefficients).astype(np.float32))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_class: int = PER_CLASS) -> KernelModel | None:
    """The model of a bounded sample of the training fold, or None if that has no labelled text."""
    labelled = (docs.filter((id_remainder(doc_id, FOLDS) != TEST) & F.col(lang).isNotNull() & (F.octet_length(text) <= SAMPLE_TEXT_BYTES)
                            & F.col(text).rlike(r"\p{L}"))
                .select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")))
    rows = sample_per_class(labelled, "lang", "id", per_class).orderBy("lang", "id", "text").collect()
    return train([r["text"].encode() for r in rows], [r["lang"] for r in rows]) if rows else None


def identify(docs: DataFrame, model: KernelModel | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, a row for each row of ``docs``.

    A text that is null or has no letter is ``und`` with score 0, as is every
    text without a model. Whole texts are read; only the text decides. A tie goes to the
    language that is first in order. Repeated rows get equal results.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    known = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) if model else F.lit(False)

    def predict(batches):
        presence = Presence(model.vocabulary) if model else None
        for batch in blocks(batches, "text", BLOCK_BYTES):
            known = batch.column("known").to_numpy(zero_copy_only=False).astype(bool)
            languages, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if known.any():
                margins = np.concatenate([unit(r) @ model.weights + model.bias for r in presence.rows(*flat(batch.column("text")))])
                best = margins.argmax(axis=1)
                power = np.exp(SHARPNESS * (margins - margins.max(axis=1, keepdims=True)).astype(float))
                scores = np.where(known, 1 / power.sum(axis=1), 0.0)
                languages = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(languages), pa.array(scores, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    found = (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), known.alias("known"))
             .mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double"))
    return found.select("doc_id", held_out("doc_id", FOLDS, TEST).alias("held_out"), "lang_pred", "score")
