"""Operator 1: toxicity by maximum-scoring segments.

Method.  Tokens are words (letters only, lower case) with their prefixes of
four to seven letters as back-off.  A token's weight is its log-odds between
toxic and other labelled texts (number of texts that hold it, so one text
that repeats a word counts once) with a Dirichlet prior around the pooled
rates; only significant positive weights are kept, and every other token has
one small negative weight, so that clean text drifts down.  A linear-time scan finds all maximal scoring segments of a text (Ruzzo and
Tompa).  Segment scores follow an extreme-value law on clean text
(Karlin-Altschul): lambda solves sum p e^(lambda s) = 1 for the clean token
frequencies, and a segment's expected count in n tokens is K n e^(-lambda S).
A text's evidence is lambda S - ln(K n) of its best segment, the sum of it
over its significant segments, the weight met per token and the largest
single weight; a logistic curve fitted on the
sample turns it into a score from 0 to 1.

The fit uses at most ``TRAIN_PER_LABEL`` labelled rows of each label (those
with the smallest hash of their id) that are not held out, and at most
``MAX_TOKENS`` weighted tokens; every row and whole text is scored.

Defined cases: a null or empty text has no segments and scores like any text
without them; without labelled rows of both kinds every score is 0; a
doc_id labelled more than once counts as toxic if one label says so; null
labels are ignored; null ids and repeated rows are rows like any other.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelry.llm.common import held_out, release, slices, smallest_per_key, store, texts

TRAIN_PER_LABEL = 6_000
MAX_TOKENS = 50_000
PREFIXES = (4, 5, 6, 7)
# Weights of tokens that a task keeps at hand.
CACHE_ENTRIES = 150_000
MIN_TOXIC_COUNT = 4
MIN_Z = 3.5
MIN_WEIGHT = 1.5
# Dirichlet prior: a flat part for each token and a part around its pooled rate.
PRIOR_FLAT, PRIOR_POOLED = 0.5, 1.0
# Expected number of chance segments below which a segment is reported.
MAX_EXPECTED = 0.5
_TRIM = "\"'`.,;:!?()[]{}<>|*#%&$-_/\\=+~^@…«»“”‘’¿¡"


def bare(token: str) -> str:
    """Lower-case letters of a token without outer punctuation; empty if it is no word."""
    core = token.strip(_TRIM).lower()
    return core if core.isalpha() else ""


@dataclass
class Model:
    weights: dict[str, float]
    other: float
    lam: float = 1.0
    k: float = 0.1
    curve: np.ndarray = field(default_factory=lambda: np.zeros(5))
    cache: dict[str, float] = field(default_factory=dict)

    def weight(self, token: str) -> float:
        word = bare(token)
        if word:
            for unit in (word, *(word[:n] + "*" for n in reversed(PREFIXES) if len(word) > n)):
                w = self.weights.get(unit)
                if w is not None:
                    return w
        return self.other

    def scores(self, tokens: list[str]) -> np.ndarray:
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        out = list(map(cache.get, tokens))
        if None in out:
            for i, w in enumerate(out):
                if w is None:
                    out[i] = cache[tokens[i]] = self.weight(tokens[i])
        return np.array(out)

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float, float]]]:
        """Number of tokens, and (first, end, score, largest weight) of all maximal segments."""
        tokens = text.split()
        if not tokens:
            return 0, []
        s = self.scores(tokens)
        hits = np.flatnonzero(s > 0)
        return len(tokens), maximal_segments(hits.tolist(), s[hits].tolist(), self.other)

    def evidence(self, n: int, found: list[tuple[int, int, float, float]]) -> list[float]:
        """Best segment and sum of significant segments beyond chance, weight per token, largest weight."""
        if not found:
            return [0.0] * 4
        beyond = [self.lam * s - math.log(max(self.k * n, 1e-9)) for _, _, s, _ in found]
        keep = [b for b in beyond if -b < math.log(MAX_EXPECTED)]
        mass = sum(s for _, _, s, _ in found) / n
        return [max(beyond), math.log1p(sum(keep)), math.log1p(100.0 * mass), max(g for *_, g in found)]

    def score(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.curve[:-1] + self.curve[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _end(model: Model | None) -> None:
    """End of a task: the broadcast model stays in the worker, what the task added to it goes."""
    if model is not None:
        model.cache.clear()
    release()


def maximal_segments(at: list[int], gains: list[float], other: float) -> list[tuple[int, int, float, float]]:
    """All maximal scoring segments of a sequence that has ``gains`` at ``at`` and ``other`` elsewhere.

    Ruzzo and Tompa's scan: candidates (first, end, sum before, sum after,
    largest gain) are kept on a list; a new one is joined to the last
    candidate whose sum before it is lower, as long as that ends lower too.
    """
    kept: list[tuple[int, int, float, float, float]] = []
    total, last = 0.0, 0
    for i, g in zip(at, gains):
        low = total + other * (i - last)
        total, last = low + g, i + 1
        first, top = i, g
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j -= 1
            if j < 0 or kept[j][3] >= total:
                kept.append((first, i + 1, low, total, top))
                break
            first, low = kept[j][0], kept[j][2]
            top = max(top, *(c[4] for c in kept[j:]))
            del kept[j:]
    return [(a, b, hi - lo, top) for a, b, lo, hi, top in kept]


def _units(sample: DataFrame) -> DataFrame:
    """(unit, toxic, n): number of texts that hold a unit, per Arrow slice of (text, toxic).

    The unit ``''`` counts the texts, ``' '`` their tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", max_bytes=1 << 20):
                counts: tuple[Counter, Counter] = (Counter(), Counter())
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    tokens = text.split()
                    words = set(map(bare, set(tokens))) - {""}
                    units = words | {w[:p] + "*" for w in words for p in PREFIXES if len(w) > p}
                    counts[int(toxic)].update(units)
                    counts[int(toxic)].update({"": 1, " ": len(tokens)})
                for toxic, units in enumerate(counts):
                    yield pa.RecordBatch.from_pydict({"unit": pa.array(list(units), pa.string()), "toxic": pa.array([toxic] * len(units), pa.int32()), "n": pa.array(list(units.values()), pa.int64())})

    return sample.mapInArrow(run, "unit string, toxic int, n long")


def _weights(sample: DataFrame) -> tuple[dict[str, float], int]:
    """Weights of the significant units, and the number of clean tokens."""
    by = _units(sample).groupBy("unit").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    by = store(by.filter(F.col("unit").isin("", " ") | (F.col("t") >= MIN_TOXIC_COUNT)), "toxic-units")
    totals = {r["unit"]: (r["t"], r["c"]) for r in by.filter(F.col("unit").isin("", " ")).collect()}
    nt, nc = totals.get("", (0, 0))
    if not nt or not nc:
        return {}, 0
    prior = F.lit(PRIOR_FLAT) + F.lit(PRIOR_POOLED) * (F.col("t") + F.col("c")) / float(nt + nc)
    a, b = F.col("t") + prior, F.col("c") + prior
    spare = 2 * (PRIOR_FLAT + PRIOR_POOLED)
    odds = F.log(a / (nt + spare - a)) - F.log(b / (nc + spare - b))
    found = by.filter(~F.col("unit").isin("", " ")).select("unit", odds.alias("w"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"))
    found = found.filter((F.col("z") > MIN_Z) & (F.col("w") > MIN_WEIGHT)).orderBy(F.desc("z"), "unit").limit(MAX_TOKENS)
    return {r["unit"]: float(r["w"]) for r in found.collect()}, int(totals[" "][1])


def _chance(model: Model, clean: Counter, n: int) -> None:
    """Extreme-value parameters from the clean frequencies of the weights."""
    rates = [(w, c / n) for w, c in clean.items() if c]
    rest = 1.0 - sum(p for _, p in rates)
    lo, hi = 1e-6, 50.0
    value = lambda lam: rest * math.exp(lam * model.other) + sum(p * math.exp(min(600.0, lam * w)) for w, p in rates) - 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    model.lam = lo if rates else 1.0
    # K as the rate of hits: the expected number of ladder points per token
    model.k = max(1e-4, min(1.0, sum(p for _, p in rates)))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> Model | None:
    """Model fitted on labelled rows that are not held out; None if one of the labels is missing."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    marks = marks.filter(~held_out("doc_id", modulus, remainder))
    ids = texts(docs).select("doc_id").join(marks, "doc_id").distinct()
    picked = smallest_per_key(ids, "toxic", "doc_id", TRAIN_PER_LABEL).select("doc_id", "toxic")
    # at most 2 x TRAIN_PER_LABEL ids: the side's size is bounded
    sample = texts(docs).join(F.broadcast(picked), "doc_id").select("text", "toxic")
    sample = store(sample, "toxic-sample")
    weights, n_clean = _weights(sample)
    if not n_clean:
        return None
    model = Model(weights, -0.01)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for part in slices(batch, "text", max_bytes=1 << 20):
                out = {"toxic": [], "n": [], "at": [], "w": []}
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    tokens = text.split()
                    s = fitted.scores(tokens) if tokens else np.zeros(0)
                    at = np.flatnonzero(s > 0)
                    for name, v in (("toxic", int(toxic)), ("n", len(tokens)), ("at", at.tolist()), ("w", s[at].tolist())):
                        out[name].append(v)
                yield pa.RecordBatch.from_pydict(out, pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("at", pa.list_(pa.int64())), ("w", pa.list_(pa.float64()))]))
        _end(fitted)

    rows = sample.mapInArrow(hits, "toxic int, n long, at array<long>, w array<double>").collect()
    rows.sort(key=lambda r: (r["toxic"], r["n"], r["at"]))
    clean: Counter = Counter()
    for r in rows:
        if not r["toxic"]:
            clean.update(r["w"])
    # clean text must lose at least twice what it gains by chance
    model.other = min(-0.01, -2.0 * sum(w * n for w, n in clean.items()) / n_clean)
    _chance(model, clean, n_clean)
    x = np.array([model.evidence(r["n"], maximal_segments(r["at"], r["w"], model.other)) for r in rows])
    y = np.array([r["toxic"] for r in rows], float)
    model.curve = _logistic(x, y)
    model.cache = {}
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic curve by Newton steps (the last coefficient is the constant)."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxic_passages(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row: ``doc_id, score, n_segments, segments`` (``first:end`` token positions, comma-joined)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for part in slices(batch, "text", max_bytes=1 << 20):
                x, spans = [], []
                for text in part.column("text").to_pylist():
                    n, found = fitted.segments(text) if fitted else (0, [])
                    x.append(fitted.evidence(n, found) if fitted else [0.0] * 4)
                    floor = math.log(MAX_EXPECTED) if fitted else 0.0
                    spans.append([f"{a}:{b}" for a, b, s, _ in found if math.log(max(fitted.k * n, 1e-9)) - fitted.lam * s < floor])
                score = fitted.score(np.array(x)) if fitted else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array([len(s) for s in spans], pa.int64()), pa.array([",".join(s) for s in spans], pa.string())], ["doc_id", "score", "n_segments", "segments"])
        _end(fitted)

    return texts(docs).mapInArrow(run, "doc_id long, score double, n_segments long, segments string")


def op1_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """The contract's rows (and the significant passages)."""
    found = toxic_passages(docs, train(docs, labels, modulus, remainder))
    return found.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_segments", "segments")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic; columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for part in slices(batch, "text", max_bytes=1 << 20) if fitted else [batch]:
                if fitted:
                    x = np.array([fitted.evidence(*fitted.segments(t or "")) for t in part.column("text").to_pylist()])
                    part = part.filter(pa.array(fitted.score(x) < 0.5))
                yield part
        _end(fitted)

    return docs.mapInArrow(run, docs.schema)
