"""Quality classifier: votes of the nearest labelled neighbours in a latent semantic space.

A text's terms are the pairs of neighbouring byte classes and binned statistics of the whole text, with
weights of term frequency and inverse document frequency. A truncated singular value decomposition of
the labelled terms gives the latent space. The labelled vectors and the projection are broadcast, both
of a size that the parameters fix (4,096 x 48 and 2,159 x 48 floats: 1.2 MB); every document is compared
with all of them, block by block, exactly. The score is the mean label of the nearest, weighted by
similarity.

Labels are learned only from rows whose ``crc32`` of the key (as text) is not a multiple of 5, and at
most ``max_labelled`` of them, chosen by the hash of the key.

Defined results: a null text is an empty one and is scored like any other (its terms are its
statistics). Repeated rows score alike. Without usable labels every score is 0.5. A null key is
never held out and never learned from. Labels of one document that differ are averaged. An empty
table gives no rows.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows
from .quality_rules import COUNTS, count_text

MAX_LABELLED = 4096
DIMENSIONS = 48
NEIGHBOURS = 15
#: Votes weigh as the cosine to this power.
SHARPNESS = 8
THRESHOLD = 0.3
_BLOCK = 256


def _byte_classes() -> np.ndarray:
    """Each byte's class: letters alone, upper case together, marks of interest alone, the rest in groups."""
    out = np.full(256, 44, np.uint16)
    out[ord("a") : ord("z") + 1] = np.arange(26)
    out[ord("A") : ord("Z") + 1] = 26
    out[ord("0") : ord("9") + 1] = 27
    for i, group in enumerate([" ", "\n", "\t\r\x0b\x0c", ".", ",", "!", "?", "#*$%&", "|", "<>", "=/\\@_+~^", "'\"`", ":;-()[]{}"]):
        out[np.frombuffer(group.encode(), np.uint8)] = 28 + i
    out[0x80:0xC0], out[0xC0:0xE0], out[0xE0:] = 41, 42, 43
    return out


_CLASSES = _byte_classes()
_CLASS_COUNT = 45
_PAIRS = _CLASS_COUNT**2
_BINS = 12
_RATIOS = [("word_chars", "n_words", 12), ("n_symbols", "n_words", 2), ("n_dup_lines", "n_lines", 1), ("n_repeat_words", "n_words", 1), ("n_upper", "word_chars", 1), ("n_digits", "word_chars", 1), ("n_exclaims", "n_words", 1), ("n_words", "n_lines", 120), ("richness", None, 1), ("length", None, 12)]
TERMS = _PAIRS + _BINS * len(_RATIOS) + _BINS + 2


def term_vector(text: str | None) -> np.ndarray:
    """Term weights of a whole text before inverse document frequencies."""
    text = text or ""
    out = np.zeros(TERMS, np.float32)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) > 1:
        c = _CLASSES[raw]
        pairs = np.bincount(c[:-1] * _CLASS_COUNT + c[1:], minlength=_PAIRS).astype(np.float32)
        out[:_PAIRS] = np.sqrt(pairs / pairs.sum())  # of length 1
    counts = dict(zip(COUNTS, count_text(text)))
    n = counts["n_words"]
    counts["richness"] = math.log1p(counts["n_distinct_words"]) / math.log1p(n) if n else 0.0
    counts["length"] = math.log1p(n)
    # a statistic votes for two neighbouring bins, the nearer more
    weight = 0.6 / math.sqrt(len(_RATIOS))
    for i, (top, bottom, most) in enumerate(_RATIOS):
        value = counts[top] / max(1, counts[bottom]) if bottom else counts[top]
        place = min(1.0, value / most) ** 0.5 * (_BINS - 2)
        if top == "richness":
            place = min(1.0, max(0.0, (value - 0.5) * 2)) * (_BINS - 2)
        low = int(place)
        at = _PAIRS + i * _BINS + low
        out[at] += weight * math.sqrt(1 - (place - low))
        out[at + 1] += weight * math.sqrt(place - low)
    out[-1] = 0.05  # so that no text is without terms
    return out


@dataclasses.dataclass(frozen=True)
class Model:
    projection: np.ndarray  # TERMS x dimensions, inverse document frequencies included
    vectors: np.ndarray  # dimensions x labelled, of length 1
    labels: np.ndarray

    def scores(self, terms: np.ndarray, neighbours: int = NEIGHBOURS, sharpness: int = SHARPNESS) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(terms), 0.5)
        own = terms @ self.projection
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
        out = np.empty(len(terms))
        k = min(neighbours, len(self.labels))
        for a in range(0, len(own), _BLOCK):
            cosines = own[a : a + _BLOCK] @ self.vectors
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6).astype(np.float64) ** sharpness
            out[a : a + _BLOCK] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def latent(terms: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
    """The latent space of labelled term vectors, by a randomised SVD with a fixed start."""
    if not len(terms):
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((1, 0), np.float32), np.zeros(0))
    idf = np.log1p(len(terms) / (1.0 + (terms > 0).sum(0))).astype(np.float32)
    x = terms * idf
    size = min(dimensions + 16, *x.shape)
    basis = np.random.default_rng(7).standard_normal((x.shape[1], size)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
    projection = (idf[:, None] * (basis @ right[: min(dimensions, size)].T)).astype(np.float32)
    vectors = terms @ projection
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Model(projection, np.ascontiguousarray(vectors.T), labels.astype(np.float64))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.avg(label).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
        .select(F.col("doc_id").alias("k"), "y")
    )
    texts = docs.select(docs[key].alias("d"), docs[text].alias("t"))
    joined = texts.join(F.broadcast(chosen), F.col("d") == F.col("k")).groupBy("d").agg(F.min("t").alias("t"), F.max("y").alias("y"))

    def make():
        return lambda batch: {"v": [term_vector(t).tobytes() for t in batch]}

    # max_labelled rows of TERMS floats: 35 MB
    rows = map_rows(joined, make, "t", T.StructType([T.StructField("v", T.BinaryType())]), ["d", "y"]).collect()
    rows.sort(key=lambda r: r["d"])
    terms = np.frombuffer(b"".join(r["v"] for r in rows), np.float32).reshape(-1, TERMS)
    return latent(terms, np.array([r["y"] for r in rows], float))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: ``doc_id, held_out, score, predicted``."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.projection, model.vectors, model.labels))
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))

    def make():
        own = Model(*shipped.value)
        return lambda batch: {"score": own.scores(np.stack([term_vector(t) for t in batch])) if batch else []}

    scored = map_rows(rows, make, "text", T.StructType([T.StructField("score", T.DoubleType())]), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
