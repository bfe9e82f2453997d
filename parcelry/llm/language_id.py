"""Operator 4: language identification by string kernels.

Method.  The kernel of two texts is the number of character n-grams (length
2 to 4, blended) present in both, over the root of the product of their
numbers of n-grams.  Texts are lower-cased and every character that is no
letter becomes a space; n-grams are hashed to ``SLOTS`` slots.  Nyström:
landmark texts of every language span the feature space
K(x, L) K(L, L)^(-1/2), in which one-versus-rest kernel ridge regression is
solved.  A batch of texts is scored by two matrix products: presence by
landmark n-grams, then kernel values by coefficients.

The fit uses at most ``TRAIN_PER_LANG`` rows a language, the ones with the
smallest hash of their id, of which ``LANDMARKS_PER_LANG`` are landmarks;
every row and whole text is scored.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
with no row to learn from every text is ``und``; null ids and repeated rows
are rows like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelry.llm.common import held_out, release, slices, smallest_per_key

ORDERS = (2, 3, 4)
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
LANDMARKS_PER_LANG = 24
TRAIN_PER_LANG = 600
RIDGE = 1e-3
# Sharpness of the score (a softmax of the regression outputs).
SHARPNESS = 4.0
_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def gram_slots(text: str) -> np.ndarray | None:
    """Sorted distinct slots of the text's n-grams; None if it has no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    code = np.where(_LETTER[code], code, np.uint32(32))
    if not (code != 32).any():
        return None
    code = np.concatenate([[32], code, [32]]).astype(np.uint32)
    seen = np.zeros(SLOTS, bool)
    mixed = code * _ODD[0]
    for n in range(2, max(ORDERS) + 1):
        if len(code) < n:
            break
        mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * _ODD[n - 1] + code[n - 1 :] * _ODD[0]
        if n in ORDERS:
            seen[(mixed * _ODD[3]) >> np.uint32(32 - SLOT_BITS)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    """Landmark n-grams and the coefficients of the one-versus-rest regressions."""

    langs: list[str]
    column: np.ndarray  # slot -> column of ``marks``, or -1
    marks: np.ndarray  # landmark n-grams x landmarks, 0 or 1
    root: np.ndarray  # root of each landmark's number of n-grams
    weights: np.ndarray | None = None  # landmarks x languages
    bias: np.ndarray | None = None

    def kernel(self, grams: list[np.ndarray]) -> np.ndarray:
        """Kernel values of a batch of texts with the landmarks."""
        present = np.zeros((len(grams), len(self.marks)), np.float32)
        size = np.ones(len(grams), np.float64)
        for i, g in enumerate(grams):
            c = self.column[g]
            present[i, c[c >= 0]] = 1.0
            size[i] = max(1, len(g))
        return (present @ self.marks) / (np.sqrt(size)[:, None] * self.root)

    def predict(self, batch: list[str | None], block: int = 128) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(batch), [0.0] * len(batch)
        grams = [(i, gram_slots(t)) for i, t in enumerate(batch) if t]
        grams = [(i, g) for i, g in grams if g is not None]
        for lo in range(0, len(grams), block):
            part = grams[lo : lo + block]
            out = self.kernel([g for _, g in part]) @ self.weights + self.bias
            e = np.exp(SHARPNESS * (out - out.max(axis=1, keepdims=True)))
            p = e / e.sum(axis=1, keepdims=True)
            best = out.argmax(axis=1)
            for (i, _), b, s in zip(part, best.tolist(), p[np.arange(len(part)), best].tolist()):
                names[i], scores[i] = self.langs[b], s
        return names, scores


def _landmark_model(langs: list[str], slots: list[np.ndarray]) -> Model:
    used = np.unique(np.concatenate(slots))
    column = np.full(SLOTS, -1, np.int32)
    column[used] = np.arange(len(used))
    marks = np.zeros((len(used), len(slots)), np.float32)
    for j, s in enumerate(slots):
        marks[column[s], j] = 1.0
    return Model(langs, column, marks, np.sqrt(np.array([len(s) for s in slots], float)))


def train(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> Model | None:
    """Model fitted on rows that are not held out; None if there is none with a letter."""
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    learn = learn.filter(F.col("lang").isNotNull() & ~held_out("doc_id", modulus, remainder) & F.col("text").isNotNull())
    picked = smallest_per_key(learn.select("doc_id", "lang").distinct(), "lang", "doc_id", TRAIN_PER_LANG)
    # at most TRAIN_PER_LANG ids a language: the side's size is bounded
    sample = learn.join(F.broadcast(picked), ["doc_id", "lang"])

    def slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", max_rows=64, max_bytes=1 << 20):
                found = [gram_slots(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("place"), part.column("doc_id"), pa.array([g if g is None else g.astype(np.int32) for g in found], pa.list_(pa.int32()))], ["lang", "place", "doc_id", "slots"])

    marks = sample.filter(F.col("place") <= LANDMARKS_PER_LANG).select("lang", "place", "doc_id", "text").mapInArrow(slots_of, "lang string, place int, doc_id long, slots array<int>")
    rows = sorted((r for r in marks.collect() if r["slots"]), key=lambda r: (r["lang"], r["place"], r["doc_id"] or 0, r["slots"]))
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    model = _landmark_model(langs, [np.array(r["slots"], np.int64) for r in rows])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", max_rows=64, max_bytes=1 << 20):
                pairs = [(l, gram_slots(t)) for l, t in zip(part.column("lang").to_pylist(), part.column("text").to_pylist())]
                pairs = [(l, g) for l, g in pairs if g is not None]
                k = shared.value.kernel([g for _, g in pairs])
                yield pa.RecordBatch.from_arrays([pa.array([l for l, _ in pairs], pa.string()), pa.array(list(k), pa.list_(pa.float64()))], ["lang", "k"])

    found = [r for r in sample.select("lang", "text").mapInArrow(kernels, "lang string, k array<double>").collect() if r["lang"] in langs]
    found.sort(key=lambda r: (r["lang"], r["k"]))
    k = np.array([r["k"] for r in found])
    y = np.array([[1.0 if r["lang"] == l else -1.0 for l in langs] for r in found])
    own = model.kernel([np.flatnonzero(model.column >= 0)[model.marks[:, j] > 0] for j in range(model.marks.shape[1])])
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    phi = k @ root
    # every language weighs the same, however its rows are spread
    weight = np.array([1.0 / sum(r["lang"] == l for r in found) for l in langs])[[langs.index(r["lang"]) for r in found]]
    mean, target = weight @ phi / weight.sum(), weight @ y / weight.sum()
    centred = (phi - mean) * weight[:, None]
    w = np.linalg.solve(centred.T @ (phi - mean) + RIDGE * np.eye(phi.shape[1]), centred.T @ (y - target))
    model.weights, model.bias = root @ w, target - mean @ w
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from its whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for part in slices(batch, "text", max_rows=256, max_bytes=4 << 20):
                t = part.column("text").to_pylist()
                names, scores = fitted.predict(t) if fitted is not None else (["und"] * len(t), [0.0] * len(t))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language_id(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """The contract's rows."""
    found = identify(docs, train(docs, modulus, remainder))
    return found.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "lang_pred", "score")
