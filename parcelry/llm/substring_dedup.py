"""Operator 9: repeated passages, by prefix-partitioned suffix groups.

Words are runs without white space (space, 0x09-0x0D).  A window is ``width``
(13) consecutive words of one document.  Every word covered by a window
whose word sequence also starts in a document with a smaller id is removed;
windows are judged on the input.

Method.  Each suffix (a word position with at least ``width`` words left) is
filed under a prefix of variable length: one word, or more while the prefix
is held by more than a group's worth of suffixes (``heavy_prefixes``), so a
group fits in memory.  Groups are dealt to partitions by that prefix.  Only
internal nodes at least ``width`` words deep matter, so a suffix's path to
that depth is kept as the 64-bit hash that its prefixes extend word by word;
sorting a group's paths gives its deep nodes (equal paths), and a node with
suffixes of several chunks is a repeat.  No tree is built: of a suffix tree
only its nodes at depth ``width`` decide a row, and equal hashes stand for
them without a check of the bytes.  Runs of neighbouring repeated
suffixes are the maximal repeats reported as ``repeats``.  Paths are not
stored as words: 13 words a suffix would be about ten times the input.

Exchange.  Documents are cut into chunks by ranges of ``doc_id``, so a chunk
with a smaller number holds smaller ids only; the borders are quantiles of
the ids weighted by bytes.  Rows without an id never repeat each other, so
they are dealt by a hash of their text (copies of one text stay together) to
chunks after all others.  A chunk sends each of its
distinct paths once to the path's group (a passage held by a third of all
documents is one entry per chunk there), and gets one bit back per entry: is
it in an earlier chunk?  Inside a chunk ids are compared directly.

Defined cases: a null or empty text has no words; a null ``doc_id`` sorts
after all others; rows with one id never repeat each other (no smaller id);
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from parcelry.llm.common import NULL_ID, slices, texts

WIDTH = 13
# Suffixes that one group (and one partition of groups) should hold.
GROUP_SUFFIXES = 1_000_000
# Text of a chunk.
CHUNK_BYTES = 8 << 20
# Rows of the table of heavy prefixes that is sent to every task; above it groups get larger.
MAX_HEAVY = 1_000_000
_xxh = xxhash.xxh64_intdigest


def _factors(width: int) -> np.ndarray:
    """Odd 64-bit factor of each word place."""
    return np.array([_xxh(i.to_bytes(4, "little"), 7) | 1 for i in range(width)], np.uint64)


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(_xxh, words), np.uint64, len(words))


def paths(hashes: list[np.ndarray], width: int) -> Iterator[np.ndarray]:
    """For depth 1 to ``width``: the path hash of every suffix to that depth, documents one after another."""
    factors = _factors(width)
    live = [h for h in hashes if len(h) >= width]
    total = np.zeros(sum(len(h) - width + 1 for h in live), np.uint64)
    for d in range(width):
        if live:
            total = total + np.concatenate([h[d : len(h) - width + 1 + d] for h in live]) * factors[d]
        yield total


def _counts(values: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(values, return_counts=True)
    return found[n >= least], n[n >= least]


def heavy_prefixes(docs: DataFrame, n_words: float, width: int, group: int) -> dict[int, np.ndarray]:
    """Prefixes (by depth) held by more than ``group`` suffixes, for routing only.

    A prefix that is heavy overall is heavy in proportion in some slice of
    the text, so each task reports those and their counts are added up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", max_rows=1 << 20):
                hashes = [word_hashes(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
                inside = None
                for depth, at in enumerate(paths(hashes, width), 1):
                    if depth == width:
                        break  # equal to the last word: cannot be split further
                    least = max(2.0, 0.5 * group * len(at) / max(n_words, 1))
                    found, n = _counts(at if inside is None else at[inside], least)
                    if not len(found):
                        break
                    yield pa.RecordBatch.from_pydict({"depth": np.full(len(found), depth, np.int32), "prefix": found.view(np.int64), "n": n.astype(np.int64)})
                    held = np.isin(at, found)
                    inside = held if inside is None else inside & held

    sums = docs.mapInArrow(run, "depth int, prefix long, n long").groupBy("depth", "prefix").agg(F.sum("n").alias("n"))
    sums = sums.filter(F.col("n") > group).orderBy(F.desc("n"), "depth", "prefix").limit(MAX_HEAVY)
    rows = sums.select("depth", "prefix").toPandas()
    return {int(d): np.sort(g["prefix"].to_numpy(np.int64).view(np.uint64)) for d, g in rows.groupby("depth")}


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def suffixes(hashes: list[np.ndarray], width: int, heavy: dict[int, np.ndarray], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Path to full depth and partition of every suffix."""
    route = moving = None
    path = np.zeros(0, np.uint64)
    for depth, path in enumerate(paths(hashes, width), 1):
        if route is None:
            route, moving = path.copy(), np.ones(len(path), bool)
        else:
            route[moving] = path[moving]
        table = heavy.get(depth)
        if table is None or not len(table):
            moving[:] = False
        elif moving.any():
            moving[moving] = _member(route[moving], table)
    mixed = route * np.uint64(0x9E3779B97F4A7C15)
    return path, ((mixed >> np.uint64(32)) % np.uint64(groups)).astype(np.int32)


class Chunk:
    """The suffixes of one chunk, in an order that does not depend on how its rows arrived."""

    def __init__(self, rows: pa.Table, width: int, heavy: dict[int, np.ndarray], groups: int):
        ids = pc_fill(rows.column("doc_id"))
        raw = rows.column("text").cast(pa.large_binary()).to_pylist()
        order = sorted(range(len(raw)), key=lambda i: (ids[i], raw[i]))
        self.ids = ids[order]
        self.raw = [raw[i] for i in order]
        self.null = np.array(rows.column("doc_id").is_null().to_numpy(), bool)[order]
        hashes = [word_hashes(t) for t in self.raw]
        self.n_words = [len(h) for h in hashes]
        self.n_suffixes = np.array([max(0, n - width + 1) for n in self.n_words], np.int64)
        path, part = suffixes(hashes, width, heavy, groups)
        # rows are in id order, so a path's first suffix has its smallest id
        self.distinct, first, self.entry = np.unique(path, return_index=True, return_inverse=True)
        self.part = part[first]
        owner = np.repeat(self.ids, self.n_suffixes)
        self.later = owner > owner[first][self.entry] if len(first) else np.zeros(0, bool)

    def by_part(self) -> Iterator[tuple[int, np.ndarray]]:
        """Partition and the positions of its entries, in partition order."""
        order = np.argsort(self.part, kind="stable")
        parts, starts = np.unique(self.part[order], return_index=True)
        for p, entries in zip(parts.tolist(), np.split(order, starts[1:])):
            yield p, entries


def pc_fill(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy()


def cut_chunks(src: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int, int, int]:
    """``src`` with its ``chunk``, the bytes of all texts, the number of chunks and the first chunk of rows without an id."""
    size = src.agg(F.sum(F.octet_length("text")).alias("b"), F.count("doc_id").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.octet_length("text"))).alias("null_b")).first()
    n_bytes, null_bytes, n_rows = int(size["b"] or 0), int(size["null_b"] or 0), int(size["n"])
    chunks, null_chunks = (max(1, math.ceil(n / chunk_bytes)) for n in (n_bytes - null_bytes, null_bytes))
    # chunk borders: one id per chunk, a table of 8 bytes each
    borders = np.array([], np.int64)
    if chunks > 1 and n_rows:
        at = [i / chunks for i in range(1, chunks)]
        # an id counts once for every quarter of the mean size that its text has
        share = F.ceil(F.octet_length("text") / F.lit(max(1.0, (n_bytes - null_bytes) / n_rows / 4))).cast("int")
        weighted = src.filter("doc_id IS NOT NULL").select("doc_id", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), share))))
        borders = np.unique(np.array(weighted.select(F.percentile_approx("doc_id", at, max(10_000, 20 * chunks)).alias("q")).first()["q"], np.int64))
    # number of the first chunk of rows without an id
    no_id = len(borders) + 1

    @F.pandas_udf("int")
    def chunk_of(ids: pd.Series, salt: pd.Series) -> pd.Series:
        at = np.searchsorted(borders, ids.fillna(NULL_ID).to_numpy(np.int64), side="left")
        return pd.Series(np.where(ids.isna(), no_id + salt, at).astype(np.int32))

    salt = F.pmod(F.xxhash64("text"), F.lit(null_chunks)).cast("int")
    return src.withColumn("chunk", chunk_of("doc_id", salt)), n_bytes, chunks + null_chunks * (null_bytes > 0), no_id


def find_repeats(docs: DataFrame, width: int = WIDTH, group: int = GROUP_SUFFIXES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_removed, kept, repeats``.

    ``kept`` is the remaining words joined by one space; ``repeats`` lists
    the maximal repeats as ``start:end`` word positions, comma-joined.
    """
    src = texts(docs)
    dealt, n_bytes, chunks, no_id = cut_chunks(src, chunk_bytes)
    n_words = n_bytes / 6.0
    heavy = heavy_prefixes(src, n_words, width, group)
    groups = max(1, math.ceil(n_words / group))
    dealt = dealt.repartition(chunks, "chunk")
    shared = src.sparkSession.sparkContext.broadcast((heavy, groups))

    def send(rows: pa.Table) -> pa.Table:
        chunk = Chunk(rows, width, *shared.value)
        parts = list(chunk.by_part())
        return pa.table({
            "part": pa.array([p for p, _ in parts], pa.int32()),
            "chunk": pa.array([rows.column("chunk")[0].as_py()] * len(parts), pa.int32()),
            "paths": pa.array([chunk.distinct[e].tobytes() for _, e in parts], pa.binary()),
        })

    def answer(rows: pa.Table) -> pa.Table:
        chunk = rows.column("chunk").to_numpy()
        blobs = [np.frombuffer(b, np.uint64) for b in rows.column("paths").to_pylist()]
        of = np.repeat(chunk, [len(b) for b in blobs])
        path = np.concatenate(blobs)
        order = np.lexsort((of, path))
        first = np.concatenate([[True], path[order][1:] != path[order][:-1]])
        lowest = of[order][first][np.cumsum(first) - 1]
        earlier = np.empty(len(path), bool)
        earlier[order] = lowest < np.minimum(of[order], no_id)  # each chunk names a path once
        ends = np.cumsum([len(b) for b in blobs])[:-1]
        bits = [np.packbits(x).tobytes() for x in np.split(earlier, ends)]
        return pa.table({"chunk": pa.array(chunk, pa.int32()), "part": rows.column("part"), "bits": pa.array(bits, pa.binary())})

    def finish(rows: pa.Table, bits: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("repeats", pa.string()))})
        chunk = Chunk(rows, width, *shared.value)
        known = dict(zip(bits.column("part").to_pylist(), bits.column("bits").to_pylist()))
        earlier = np.zeros(len(chunk.distinct), bool)
        for p, entries in chunk.by_part():
            earlier[entries] = np.unpackbits(np.frombuffer(known[p], np.uint8), count=len(entries)).astype(bool)
        repeated = earlier[chunk.entry] | chunk.later if len(chunk.entry) else np.zeros(0, bool)
        removed, kept, spans = [], [], []
        at = 0
        for raw, n, m in zip(chunk.raw, chunk.n_words, chunk.n_suffixes.tolist()):
            marks = np.nonzero(repeated[at : at + m])[0]
            at += m
            words = raw.split()
            if not len(marks):
                removed.append(0), kept.append(b" ".join(words)), spans.append("")
                continue
            steps = np.zeros(n + 1, np.int32)
            np.add.at(steps, marks, 1)
            np.add.at(steps, marks + width, -1)
            gone = np.cumsum(steps[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]))
            spans.append(",".join(f"{a}:{b}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())))
        return pa.table({
            "doc_id": pa.array(chunk.ids, pa.int64(), mask=chunk.null),
            "n_words": pa.array(chunk.n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()), "repeats": pa.array(spans, pa.string()),
        })

    sent = dealt.groupBy("chunk").applyInArrow(send, "part int, chunk int, paths binary")
    bits = sent.repartition(groups, "part").groupBy("part").applyInArrow(answer, "chunk int, part int, bits binary")
    out = "doc_id long, n_words long, n_removed long, kept string, repeats string"
    return dealt.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(finish, out)


def op9_substring_dedup(docs: DataFrame) -> DataFrame:
    """The contract's rows: ``doc_id, n_words, n_removed, kept_sha256``."""
    return find_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
