"""Operator 2: secrets, by fixed patterns and a linear-chain CRF.

Base spans are the leftmost non-overlapping matches of three patterns; a
match that is too short is dropped.  The CRF adds spans of its own (kind
``crf``) where no base span lies; it never removes one.

Method.  A token is a run without white space.  Each token gets a shape
class (key word, separator, hexadecimal, mixed letters and digits by length,
...) and a coarse kind.  The score of a label (begin, inside, outside) is a
sum of weights of the token's class and kind, the classes of its two neighbours and features of the
whole text (its share of separators, digits and long mixed tokens), plus a
transition weight; inside cannot follow outside.  Weights are fitted by
forward-backward gradients on windows whose labels are the base spans: of
all rows, the ``MAX_WINDOWS`` windows around a base span and as many at any
place of a text without one that have the smallest hash of id and place (at
most ``MARKS`` base spans a text, again by hash).  Decoding is Viterbi over
the whole text.  A text in which no labelled run can pay is all outside
without decoding: neither one token with both moves at a run's ends, nor a
further token with one move inside a run, has a positive gain.

Defined cases: a null or empty text has no spans (digest of the empty
string); if no row holds a base span the CRF adds nothing; null ids,
repeated rows and very long texts are rows like any other.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelry.llm.common import release, slices, store, texts

WINDOW = 48
MAX_WINDOWS = 400
MARKS = 4
# The three base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")

_KEY_WORD = re.compile(r"passw|passwd|pwd|secret|token|api_?key|credential|auth|bearer|private_key", re.IGNORECASE | re.ASCII)
_CLASSES = ["edge", "key", "key=", "sep", "akia", "hex32", "hex16", "digits"] + [
    f"{k}{n}" for k in ("mixed", "symbols") for n in ("-7", "8-15", "16-31", "32-")
] + ["address", "lower", "capital", "upper", "long-word", "punct", "other"]
CLASS = {c: i for i, c in enumerate(_CLASSES)}
N_CLASSES = len(_CLASSES)
# Coarse kind of each class, so that a shape that the sample lacks shares weight with its like.
_KINDS = {"key": 1, "key=": 1, "sep": 2, "akia": 3, "hex32": 3, "hex16": 3, "mixed16-31": 3, "mixed32-": 3, "symbols16-31": 3, "symbols32-": 3, "mixed8-15": 4, "symbols8-15": 4, "digits": 5}
KIND_OF = np.array([_KINDS.get(c, 0) for c in _CLASSES], np.int64)
N_FILE = 4
BEGIN, INSIDE, OUTSIDE = 0, 1, 2


def base_spans(text: str, longest: int) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, sorted; ``longest``: length of the longest token."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if longest >= HEX_LEAST:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(found)


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def token_class(token: str) -> int:
    """Shape class of a token."""
    if token in ("=", ":", ":=", "=>"):
        return CLASS["sep"]
    core = token.strip("\"'`,;.()[]{}<>*#%&$|!?")
    if not core:
        return CLASS["punct"]
    if len(core) < 32 and _KEY_WORD.search(core):
        return CLASS["key=" if token.rstrip("\"'")[-1:] in "=:" else "key"]
    if "@" in core or "://" in core:
        return CLASS["address"]
    n = len(core)
    if core.isalpha():
        if n >= 40:
            return CLASS["long-word"]
        return CLASS["lower" if core.islower() else "upper" if core.isupper() else "capital"]
    if core.isdigit():
        return CLASS["digits"]
    if core.startswith("AKIA") and n >= 12:
        return CLASS["akia"]
    if core.isascii():
        if n >= 16 and not core.strip("0123456789abcdef"):
            return CLASS["hex32" if n >= 32 else "hex16"]
        has_digit, has_letter = any(c.isdigit() for c in core), any(c.isalpha() for c in core)
        size = "-7" if n < 8 else "8-15" if n < 16 else "16-31" if n < 32 else "32-"
        if has_digit and has_letter:
            return CLASS["mixed" + size if core.isalnum() else "symbols" + size]
    return CLASS["other"]


# Classes of tokens that a task keeps at hand.
CACHE_ENTRIES = 150_000
_CACHE: dict[str, int] = {}


def classes(tokens: list[str]) -> np.ndarray:
    if len(_CACHE) > CACHE_ENTRIES:
        _CACHE.clear()
    get = _CACHE.get
    out = list(map(get, tokens))
    if None in out:
        for i, c in enumerate(out):
            if c is None:
                out[i] = _CACHE[tokens[i]] = token_class(tokens[i])
    return np.array(out, np.int64)


def file_features(cls: np.ndarray) -> np.ndarray:
    """Constant, and whether separators, digits or long mixed tokens are common in the text."""
    n = max(1, len(cls))
    count = np.bincount(cls, minlength=N_CLASSES)
    mixed = count[CLASS["mixed16-31"]] + count[CLASS["mixed32-"]] + count[CLASS["symbols16-31"]] + count[CLASS["symbols32-"]]
    return np.array([1.0, count[CLASS["sep"]] / n > 0.05, count[CLASS["digits"]] / n > 0.1, mixed / n > 0.1])


class Crf:
    """Weights of the linear chain: classes and kinds of the token and its neighbours, file features, transitions."""

    def __init__(self) -> None:
        self.weights = {k: np.zeros(s) for k, s in (("own", (N_CLASSES, 3)), ("kind", (6, 3)), ("prev", (N_CLASSES, 3)), ("prev_kind", (6, 3)), ("next", (N_CLASSES, 3)), ("next_kind", (6, 3)), ("file", (N_FILE, 3)), ("move", (3, 3)))}

    def moves(self) -> np.ndarray:
        t = self.weights["move"].copy()
        t[OUTSIDE, INSIDE] = -1e9
        return t

    def scores(self, own: np.ndarray, prev: np.ndarray, nxt: np.ndarray, file: np.ndarray) -> np.ndarray:
        w = self.weights
        near = w["prev"][prev] + w["prev_kind"][KIND_OF[prev]] + w["next"][nxt] + w["next_kind"][KIND_OF[nxt]]
        return w["own"][own] + w["kind"][KIND_OF[own]] + near + file @ w["file"]

    def fit(self, own, prev, nxt, file, labels, length, rounds: int = 200, rate: float = 0.5, decay: float = 1e-4) -> "Crf":
        """Gradient ascent (AdaGrad) on the conditional log-likelihood.

        Arrays are (sequence, place); ``length`` is each sequence's length.
        """
        s, n = own.shape
        real = np.arange(n) < length[:, None]
        sums = {k: np.full(v.shape, 1e-8) for k, v in self.weights.items()}
        hot = np.eye(3)[labels] * real[..., None]
        for _ in range(rounds):
            e, t = self.scores(own, prev, nxt, file[:, None, :]), self.moves()
            fwd, bwd = np.zeros((n, s, 3)), np.zeros((n, s, 3))
            start = np.array([0.0, -1e9, 0.0])
            fwd[0] = e[:, 0] + start
            for i in range(1, n):
                step = np.logaddexp.reduce(fwd[i - 1][:, :, None] + t, axis=1) + e[:, i]
                fwd[i] = np.where(real[:, i, None], step, fwd[i - 1])
            total = np.logaddexp.reduce(fwd[n - 1], axis=1)
            moved = np.zeros((3, 3))
            for i in range(n - 2, -1, -1):
                after = e[:, i + 1] + bwd[i + 1]
                step = np.logaddexp.reduce(t[None] + after[:, None, :], axis=2)
                pair = np.exp(np.minimum(0, fwd[i][:, :, None] + t + after[:, None, :] - total[:, None, None]))
                moved += (hot[:, i, :, None] * hot[:, i + 1, None, :] - pair * real[:, i + 1, None, None]).sum(axis=0)
                bwd[i] = np.where(real[:, i + 1, None], step, 0.0)
            mass = np.exp(np.minimum(0, fwd + bwd - total[None, :, None])).transpose(1, 0, 2) * real[..., None]
            diff = hot - mass
            grads = {k: np.zeros(v.shape) for k, v in self.weights.items()}
            for name, index in (("own", own), ("kind", KIND_OF[own]), ("prev", prev), ("prev_kind", KIND_OF[prev]), ("next", nxt), ("next_kind", KIND_OF[nxt])):
                np.add.at(grads[name], index[real], diff[real])
            grads["file"] = np.einsum("sf,snk->fk", file, diff)
            grads["move"] = moved
            for k, g in grads.items():
                g = g / s - decay * self.weights[k]
                sums[k] += g * g
                self.weights[k] += rate * g / np.sqrt(sums[k])
        return self

    def decode(self, cls: np.ndarray) -> list[int] | None:
        """Viterbi labels of a whole text; None if all are outside."""
        n = len(cls)
        edge = np.array([CLASS["edge"]])
        e = self.scores(cls, np.concatenate([edge, cls[:-1]]), np.concatenate([cls[1:], edge]), file_features(cls)[None, :])
        t = self.moves()
        over = t - t[OUTSIDE, OUTSIDE]
        # a run of m tokens has m - 1 moves inside and, but at the text's edges, one at either end
        ends = max(0.0, over[OUTSIDE, BEGIN]) + max(0.0, over[:2, OUTSIDE].max())
        if (e[:, :2].max(axis=1) - e[:, OUTSIDE]).max() + max(ends, over[:2, :2].max()) <= 0:
            return None
        (bb, bi, bo), (ib, ii, io), (ob, _, oo) = t.tolist()
        rows = e.tolist()
        b, i, o = rows[0][0], -1e18, rows[0][2]
        back = []
        for eb, ei, eo in rows[1:]:
            back.append((0 if b + bb >= i + ib and b + bb >= o + ob else 1 if i + ib >= o + ob else 2, 0 if b + bi >= i + ii else 1, 2 if o + oo >= b + bo and o + oo >= i + io else 0 if b + bo >= i + io else 1))
            b, i, o = max(b + bb, i + ib, o + ob) + eb, max(b + bi, i + ii) + ei, max(b + bo, i + io, o + oo) + eo
        at = 2 if o >= b and o >= i else 0 if b >= i else 1
        out = [at] * n
        for k in range(n - 2, -1, -1):
            at = back[k][at]
            out[k] = at
        return out if any(x != OUTSIDE for x in out) else None


_TOKEN = re.compile(r"\S+")


def crf_spans(text: str, labels: list[int]) -> list[tuple[int, int, int]]:
    """Runs of begin and inside tokens as (start, kind, end) without outer quotes and stops."""
    spans, start, end = [], -1, -1
    for m, y in zip(_TOKEN.finditer(text), labels):
        if y == BEGIN or y == OUTSIDE:
            if start >= 0:
                spans.append((start, 3, end))
            start = m.start() if y == BEGIN else -1
        end = m.end()
    if start >= 0:
        spans.append((start, 3, end))
    out = []
    for a, k, b in spans:
        while a < b and text[a] in "\"'`(<[{":
            a += 1
        while a < b and text[b - 1] in "\"'`,;.)>]}*#%&$|":
            b -= 1
        if a < b:
            out.append((a, k, b))
    return out


def scan(text: str, model: Crf | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, of a whole text."""
    tokens = text.split()
    base = base_spans(text, max(map(len, tokens), default=0))
    labels = model.decode(classes(tokens)) if model is not None and tokens else None
    if labels is None:
        return base, base
    more = [(a, k, b) for a, k, b in crf_spans(text, labels) if all(b <= x or a >= y for x, _, y in base)]
    return base, sorted(base + more)


def _draw(doc_id: int | None, place: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{doc_id}:{place}".encode(), digest_size=8).digest(), "little", signed=True)


def _window(text: str, lo: int, base: list[tuple[int, int, int]]) -> tuple:
    """Features and labels of the window of tokens that begins at token ``lo``."""
    places = [m.span() for m in _TOKEN.finditer(text)]
    cls = classes([text[a:b] for a, b in places])
    labels = _labels(places, base)[0]
    edge = np.array([CLASS["edge"]])
    prev, nxt = np.concatenate([edge, cls[:-1]]), np.concatenate([cls[1:], edge])
    if labels[lo] == INSIDE:
        lo += 1
    cut = slice(lo, lo + WINDOW)
    return (*(x[cut].tolist() for x in (cls, prev, nxt)), file_features(cls).tolist(), labels[cut].tolist())


def _labels(places: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> tuple[np.ndarray, list[int]]:
    """Labels of all tokens, and the first token of every base span."""
    starts = np.array([a for a, _ in places])
    labels, marks = np.full(len(places), OUTSIDE), []
    for a, _, b in base:
        lo, hi = int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b, "left"))
        if (labels[lo:hi] == OUTSIDE).all():
            labels[lo], labels[lo + 1 : hi] = BEGIN, INSIDE
            marks.append(lo)
    return labels, marks


def _labelled_windows(docs: DataFrame) -> list[tuple]:
    """Windows around base spans and at any place of texts without one, drawn by hash from all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task keeps the smallest hashes of either kind, negated: the largest of them is on top
        best: dict[bool, list[tuple]] = {True: [], False: []}
        for batch in batches:
            for part in slices(batch, "text", max_bytes=1 << 20):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    tokens = text.split()
                    if not tokens:
                        continue
                    base = base_spans(text, max(map(len, tokens)))
                    if base:
                        marks = _labels([m.span() for m in _TOKEN.finditer(text)], base)[1]
                        drawn = sorted((_draw(doc_id, m), max(0, m - WINDOW // 2)) for m in marks)[:MARKS]
                    else:
                        k = _draw(doc_id, -1)
                        drawn = [(k, _draw(doc_id, -2) % max(1, len(tokens) - WINDOW + 1))]
                    kept = best[bool(base)]
                    for k, lo in drawn:
                        if len(kept) < MAX_WINDOWS or -k >= kept[0][0]:
                            put = heapq.heappush if len(kept) < MAX_WINDOWS else heapq.heappushpop
                            put(kept, (-k, *_window(text, lo, base)))
        rows = [(-r[0], *r[1:], hit) for hit, kept in best.items() for r in kept]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _WINDOWS)], schema=_WINDOWS)
        _CACHE.clear()
        release()

    schema = "k long, own array<long>, prev array<long>, next array<long>, file array<double>, label array<long>, hit boolean"
    windows = store(docs.mapInArrow(run, schema), "windows")
    order = ["k", "own", "prev", "next", "file", "label"]
    hits = windows.filter("hit").orderBy(*order).limit(MAX_WINDOWS)
    plain = windows.filter("NOT hit").orderBy(*order).limit(MAX_WINDOWS)
    return [tuple(r)[1:] for r in hits.union(plain).collect()]


_WINDOWS = pa.schema([("k", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("own", "prev", "next")), ("file", pa.list_(pa.float64())), ("label", pa.list_(pa.int64())), ("hit", pa.bool_())])


def train(docs: DataFrame) -> Crf | None:
    """CRF fitted on a bounded sample; None if no row has a base span."""
    rows = _labelled_windows(texts(docs))
    if not any(r[5] for r in rows):
        return None
    rows.sort(key=lambda r: (r[0], r[4]))
    length = np.array([len(r[0]) for r in rows])
    pad = lambda k, fill: np.array([list(r[k]) + [fill] * (WINDOW - len(r[k])) for r in rows], np.int64)
    edge = CLASS["edge"]
    return Crf().fit(pad(0, edge), pad(1, edge), pad(2, edge), np.array([r[3] for r in rows]), pad(4, OUTSIDE), length)


def find_secrets(docs: DataFrame, model: Crf | None) -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, n_crf, base_spans, spans``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            for part in slices(batch, "text", max_bytes=1 << 20):
                found = [scan(t, crf) for t in part.column("text").to_pylist()]
                counts = [pa.array([sum(s[1] == k for s in every) for _, every in found], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts, pa.array([span_text(b) for b, _ in found], pa.string()), pa.array([span_text(e) for _, e in found], pa.string())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_spans", "spans"])
        _CACHE.clear()
        release()

    return texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base_spans string, spans string")


def op2_secrets(docs: DataFrame) -> DataFrame:
    """The contract's rows (and ``n_crf``)."""
    found = find_secrets(docs, train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_crf")
