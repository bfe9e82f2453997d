"""Operator 3: SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints link at ``MAX_BITS`` (3) or fewer differing bits; the result is
one component per group of linked documents.

Method.  The 64 bits are cut into three segments of 23, 23 and 18 bits.  Of
at most three errors over three segments, at least two segments hold at most
one each (pigeonhole over the splits 3+0+0, 2+1+0 and 1+1+1).  Each segment
is decoded with the perfect binary Golay code [23, 12, 7] to the 12-bit index
of its nearest codeword; the indices of the word and of all its one-bit
neighbours (one or six of them) are its fuzzy keys.  If two segments differ
in at most one bit, the index of one is among the fuzzy keys of the other.
So a fingerprint is filed under three keys (one per pair of segments) and
asks under all combinations of its fuzzy keys per pair; every pair within
the radius meets, and the join condition counts the differing bits exactly.

Only distinct fingerprints enter the join: exact copies, however many, are
one row there.  Components are found on the links by repeated minimum and
pointer jumping until nothing changes; nothing is collected.

Defined cases: a null or empty text has fingerprint zero and links like any
other; a null ``doc_id`` sorts last and gets its group's smallest real id
(null if there is none); repeated rows are kept as they are; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelry.llm.common import fresh, release, slices, store, texts
from parcelry.llm.simhash import fingerprint
from parcelry.plans.guards import bounded_broadcast

SHINGLE_WORDS = 3
MAX_BITS = 3
# Fixed value: generator polynomial of the binary Golay code,
# x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
N_BITS = 23
CHECK_BITS = 11
# (first bit, width) of each segment; the short one is padded in its check bits.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word divided by the generator."""
    r = words.astype(np.uint32)
    for bit in range(N_BITS - 1, CHECK_BITS - 1, -1):
        r = np.where((r >> bit) & 1, r ^ np.uint32(GENERATOR << (bit - CHECK_BITS)), r)
    return r


def _error_patterns() -> np.ndarray:
    """Error of weight at most three for each of the 2048 syndromes (the code is perfect)."""
    one = [1 << i for i in range(N_BITS)]
    errors = [0, *one]
    errors += [one[i] | one[j] for i in range(N_BITS) for j in range(i)]
    errors += [one[i] | one[j] | one[k] for i in range(N_BITS) for j in range(i) for k in range(j)]
    table = np.zeros(1 << CHECK_BITS, np.uint32)
    e = np.array(errors, np.uint32)
    table[_syndrome(e)] = e
    return table


_ERRORS = _error_patterns()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the nearest Golay codeword of each 23-bit word."""
    return (words ^ _ERRORS[_syndrome(words)]) >> np.uint32(CHECK_BITS)


def segment(fps: np.ndarray, which: int) -> np.ndarray:
    first, width = SEGMENTS[which]
    part = (fps >> np.uint64(first)) & np.uint64((1 << width) - 1)
    return (part << np.uint64(N_BITS - width)).astype(np.uint32)


def fuzzy_keys(fps: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: the distinct codeword indices of a segment and its one-bit neighbours."""
    first, width = SEGMENTS[which]
    words = segment(fps, which)
    flips = np.concatenate([[0], 1 << np.arange(N_BITS - width, N_BITS)]).astype(np.uint32)
    keys = np.sort(codeword_index(words[:, None] ^ flips[None, :]), axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    rows, cols = np.nonzero(fresh)
    return rows, keys[rows, cols]


def _compose(pair: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (np.int64(pair) << 24) | (left.astype(np.int64) << 12) | right.astype(np.int64)


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        own = [codeword_index(segment(fp.view(np.uint64), s)) for s in range(3)]
        keys = np.concatenate([_compose(p, own[i], own[j]) for p, (i, j) in enumerate(PAIRS)])
        yield pa.RecordBatch.from_pydict({"key": keys, "b": np.tile(fp, len(PAIRS))})


def _asked(batches: Iterator[pa.RecordBatch], block: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_fp = batch.column("fp").to_numpy(zero_copy_only=False)
        for lo in range(0, len(all_fp), block):
            fp = all_fp[lo : lo + block]
            per = [fuzzy_keys(fp.view(np.uint64), s) for s in range(3)]
            counts = [np.bincount(rows, minlength=len(fp)) for rows, _ in per]
            firsts = [np.cumsum(c) - c for c in counts]
            for p, (i, j) in enumerate(PAIRS):
                rows, left = per[i]
                n = counts[j][rows]  # one output row per combination of the two segments' keys
                owner = np.repeat(rows, n)
                step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                right = per[j][1][firsts[j][owner] + step]
                yield pa.RecordBatch.from_pydict({"key": _compose(p, np.repeat(left, n), right), "a": fp[owner]})


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id``, a hash of the text (``text_hash``) and the signed 64-bit ``fp`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", max_bytes=2 << 20):
                texts_ = part.column("text").cast(pa.binary()).to_pylist()
                fp = np.fromiter((fingerprint(t, k) for t in texts_), np.uint64, len(texts_)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(fp)], ["doc_id", "text_hash", "fp"])
        release()

    return texts(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def links(distinct_fp: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints with at most ``max_bits`` (3 or fewer) differing bits."""
    if max_bits > MAX_BITS:
        raise ValueError("the segments guarantee at most three differing bits")
    asked = distinct_fp.mapInArrow(_asked, "key long, a long")
    filed = distinct_fp.mapInArrow(_filed, "key long, b long")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return asked.join(filed, (asked["key"] == filed["key"]) & near).select("a", "b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable over ``pairs`` (a, b).

    Each round takes the least label among a node and its neighbours
    (combined before the shuffle, so a hub is no hot key) and then jumps to
    the label's own label; it ends when a round changes nothing.
    """
    both = store(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low"))
        low = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("label", "low").alias("low"), F.col("label").alias("was"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("jump"))
        fresh = low.join(up, low["low"] == up["up"], "left").select("node", F.least("low", "jump").alias("label"), "was")
        fresh = store(fresh, "labels")
        changed = fresh.filter(F.col("label") != F.col("was")).limit(1).count()
        labels = fresh.select("node", "label")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``text_hash``, ``fp`` and ``component_id`` of every row of ``docs``."""
    fps = store(fingerprints(docs, k), "fingerprints")
    nodes = store(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fp")
    labels = components(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "first_id", F.coalesce("label", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    mapped = rooted.select("fp", "root").join(roots, "root").select(F.col("fp").alias("node"), "component_id")
    return fps.join(mapped, fps["fp"] == mapped["node"]).select("doc_id", "text_hash", "fp", "component_id")


def op3_simhash(docs: DataFrame) -> DataFrame:
    """The contract's rows: ``doc_id``, 16-digit hex ``fingerprint``, ``component_id``."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of its group; columns unchanged.

    Rows with a null id stay where the whole group has none; rows that
    repeat the smallest id with one text stay together.
    """
    found = near_duplicates(docs)
    key_id, key_hash = fresh(docs, "_id", "_hash")
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key_id), F.col("text_hash").alias(key_hash)).distinct()
    gone = bounded_broadcast(store(gone, "near-duplicates"))
    same = docs["doc_id"].eqNullSafe(gone[key_id]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone[key_hash])
    return docs.join(gone, same, "left_anti").select(docs.columns)
