"""Operator 10: benchmark passages in documents.

Words are runs without white space, lower-cased and stripped of outer
punctuation; words that become empty are left out.  A document leaks an item
if one of its windows of the item's number of words (the whole document if
it is shorter) has a weighted similarity of ``MIN_SIMILARITY`` (0.8) or more
with the item: the shared counts of five-word shingles over the joint counts.

Method.  A window that reaches the similarity holds a shingle of the item,
so only windows of the item's size around such shingles are looked at; no
window that could match is left out.  Each gets a 64-bit SimHash of its
shingles.  Items of that size are indexed by ten blocks of their SimHash:
of at most ``RADIUS`` (19) differing bits one block holds at most one
(pigeonhole), so filing each item's block under itself and its one-bit
neighbours finds every item within the radius.  The Hamming distance is then
checked, and the exact weighted similarity verifies what is left.

Items are read in passes of at most ``PASS_BYTES`` of text, and each pass's
index is broadcast: its size is bounded whatever the number of items.

Defined cases: an item with fewer than five words has no shingle and matches
nothing; a null or empty text leaks nothing; null ids and repeated rows are
rows like any other; an empty benchmark gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from parcelry.llm.common import release, slices, texts

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
RADIUS = 19
# Ten blocks that cut 64 bits: (first bit, width).
BLOCKS = tuple((sum([7, 7, 7, 7, 6, 6, 6, 6, 6, 6][:i]), w) for i, w in enumerate([7, 7, 7, 7, 6, 6, 6, 6, 6, 6]))
PASS_BYTES = 16 << 20
_PUNCT = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "…«»“”‘’„‚–—¿¡·"
_FACTORS = np.array([xxhash.xxh64_intdigest(bytes([i]), 5) | 1 for i in range(SHINGLE_WORDS)], np.uint64)
# Hashes of words that a task keeps at hand.
CACHE_ENTRIES = 150_000
_WORDS: dict[str, int] = {}


def _end() -> None:
    """End of a task: drop what it kept."""
    _WORDS.clear()
    release()


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of every normalised word that is not empty."""
    tokens = text.split()
    if len(_WORDS) > CACHE_ENTRIES:
        _WORDS.clear()
    found = list(map(_WORDS.get, tokens))
    if None in found:
        for i, h in enumerate(found):
            if h is None:
                core = tokens[i].strip(_PUNCT).lower()
                found[i] = _WORDS[tokens[i]] = xxhash.xxh64_intdigest(core) if core else 0
    h = np.array(found, np.uint64)
    return h[h != 0]


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    n = len(words) - SHINGLE_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = sum((words[i : n + i] * _FACTORS[i] for i in range(1, SHINGLE_WORDS)), words[:n] * _FACTORS[0])
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def window_fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` shingles at ``starts`` (sorted)."""
    out = np.empty(len(starts), np.uint64)
    for lo in range(0, len(starts), 2048):
        s = starts[lo : lo + 2048]
        # only the stretch around each run of starts is unpacked
        cuts = np.flatnonzero(np.diff(s) > size) + 1
        at = lo
        for run in np.split(s, cuts):
            first = run[0]
            sums = np.zeros((run[-1] + size - first + 1, 64), np.int32)
            np.cumsum(_bits(shingles[first : run[-1] + size]), axis=0, out=sums[1:])
            ones = sums[run - first + size] - sums[run - first]
            out[at : at + len(run)] = np.packbits(2 * ones > size, axis=1, bitorder="little").view(np.uint64)[:, 0]
            at += len(run)
    return out


class Items:
    """Index of one pass of benchmark items."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        items = [(i, shingle_hashes(word_hashes(t or ""))) for i, t in rows]
        items = [(i, s) for i, s in items if len(s)]
        self.ids = [i for i, _ in items]
        self.sizes = np.array([len(s) for _, s in items], np.int64)
        self.counts = [Counter(s.tolist()) for _, s in items]
        if not items:
            self.known = np.zeros(0, np.uint64)
            return
        self.fingerprints = np.array([window_fingerprints(s, np.zeros(1, np.int64), len(s))[0] for _, s in items], np.uint64)
        # (shingle, size) pairs, by shingle
        pairs = sorted({(x, len(s)) for _, s in items for x in s.tolist()})
        every = np.array([x for x, _ in pairs], np.uint64)
        self.known, self.first = np.unique(every, return_index=True)
        self.last = np.append(self.first[1:], len(every))
        self.pair_sizes = np.array([n for _, n in pairs], np.int64)
        # by size and block: block values (the item's own and its one-bit neighbours), and the items filed there
        self.blocks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for size in np.unique(self.sizes).tolist():
            own = np.flatnonzero(self.sizes == size)
            tables = []
            for bit, width in BLOCKS:
                value = ((self.fingerprints[own] >> np.uint64(bit)) & np.uint64((1 << width) - 1)).astype(np.int64)
                near = np.concatenate([value, *(value ^ (1 << b) for b in range(width))])
                order = np.argsort(near, kind="stable")
                tables.append((near[order], np.tile(own, width + 1)[order]))
            self.blocks[size] = tables

    def within_radius(self, fps: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all items of this size within the radius."""
        found = []
        for (bit, width), (values, items) in zip(BLOCKS, self.blocks[size]):
            v = ((fps >> np.uint64(bit)) & np.uint64((1 << width) - 1)).astype(np.int64)
            lo, hi = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
            n = hi - lo
            window = np.repeat(np.arange(len(fps)), n)
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            item = items[at]
            near = np.bitwise_count(fps[window] ^ self.fingerprints[item]) <= RADIUS
            found.append(window[near] * np.int64(len(self.ids)) + item[near])
        every = np.unique(np.concatenate(found))
        return every // len(self.ids), every % len(self.ids)

    def leaks(self, text: str | None, min_similarity: float = MIN_SIMILARITY) -> list[tuple[int | None, int, float]]:
        """(item_id, first word of the best window, similarity) of every leaked item."""
        if not text or not len(self.known):
            return []
        shingles = shingle_hashes(word_hashes(text))
        n = len(shingles)
        if not n:
            return []
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        hits = np.flatnonzero(self.known[at] == shingles)
        if not len(hits):
            return []
        reach: dict[int, list[int]] = {}
        for p, k in zip(hits.tolist(), at[hits].tolist()):
            for size in self.pair_sizes[self.first[k] : self.last[k]].tolist():
                reach.setdefault(size, []).append(p)
        best: dict[int, tuple[float, int]] = {}
        for size, places in reach.items():
            width = min(size, n)
            p = np.array(places, np.int64)
            spans = np.zeros(n - width + 2, np.int64)
            np.add.at(spans, np.clip(p - width + 1, 0, n - width), 1)
            np.add.at(spans, np.clip(p, 0, n - width) + 1, -1)
            starts = np.flatnonzero(np.cumsum(spans[:-1]) > 0)
            for lo in range(0, len(starts), 8192):
                part = starts[lo : lo + 8192]
                windows, items = self.within_radius(window_fingerprints(shingles, part, width), size)
                for w, i in zip(windows.tolist(), items.tolist()):
                    a = int(part[w])
                    s = similarity(Counter(shingles[a : a + width].tolist()), self.counts[i])
                    if s >= min_similarity and (i not in best or s > best[i][0]):
                        best[i] = (s, a)
        return [(self.ids[i], a, s) for i, (s, a) in sorted(best.items())]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two shingle counts."""
    shared = (a & b).total()
    return shared / (a.total() + b.total() - shared) if a or b else 0.0


def passes(benchmark: DataFrame) -> Iterator[Items]:
    """The items, in passes of bounded size."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / PASS_BYTES))
    for i in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        yield Items(sorted(((r[0], r[1]) for r in part), key=lambda r: (r[0] is None, r[0], r[1] or "")))


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``doc_id, item_id, start, similarity``: each leaked item of each document, with its best window."""
    src = texts(docs)
    schema = "doc_id long, item_id long, start long, similarity double"
    out = None
    for items in passes(benchmark):
        shared = src.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", max_bytes=1 << 20):
                    found = [(d, *x) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()) for x in shared.value.leaks(t, min_similarity)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "start", "similarity"])
            _end()

        here = src.mapInArrow(run, schema)
        out = here if out is None else out.unionByName(here)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Rows of ``docs`` that leak no item; columns unchanged."""
    for items in passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", max_bytes=1 << 20):
                    yield part.filter(pa.array([not shared.value.leaks(t, min_similarity) for t in part.column("text").to_pylist()], pa.bool_()))
            _end()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
