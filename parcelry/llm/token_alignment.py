"""Operator 11: alignment of two tokenizers' tokens over the same bytes.

Both tokenizers cut space+text.  Each tokenization is an incidence matrix of
tokens by bytes, in compressed sparse rows built here: ``indptr`` and
``indices``, no library.  The row products of A with the transpose of B
(Gustavson: row i of the product gathers the rows of B' that row i of A
names) hold a value for each pair of tokens that share bytes, the number of
bytes: the overlap links.  Byte offsets where a token of A and one of B both
end cut the tokens into groups; the product of the two incidence matrices of
tokens by groups holds the shared-group links.  That product has as many
entries as a group has token pairs, so it is only counted (the symbolic phase
of the row products) unless a caller asks for its rows, which then come in
bounded blocks.

Corpus-wide counts.  A block of documents (``BLOCK_LINKS`` links) keeps one
matrix of documents by distinct id pairs; a pair leaves a block once, with its
number of links there, however frequent it is.  The counts are summed by pair,
the highest of each B id marked, and both go back to the blocks, which are a
bucketed table, by a cogroup; a document's sums are products of its matrix row
with the counts.

A's file is read as ranks where it says just that (byte-level pattern, merges in
the order of their ids; ``as_ranks``), and encoded by the rank library, which
is several times faster than the file's own; any other file is left to its own
library.  A text
over ``PART`` characters is cut before single spaces between other characters,
where neither tokenizer joins (A's pattern starts a new match there, B's pieces
hold no marker behind another character).

Defined cases: texts that are null or empty, or whose tokens' bytes are not
those of space+text (a marker character in the text, for one), have no
tokens: zeros and an empty digest.  Null ids, ties and repeated rows are kept,
each counted for itself; an empty table gives an empty result; other columns
are not read.  A ``count_sum`` beyond 64 bits is an error.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from parcelry.llm.common import input_bytes, release, shared_path, slices, texts
from parcelry.llm.sentence_pieces import MARK, check_model, pack, ranges, read_model, unpack
from parcelry.plans.layout import write_bucketed

BLOCK_LINKS = 4_000_000
PART = 1 << 18
SLICE_BYTES = 1 << 20
MAX_FILE_BYTES = 64 << 20
ROWS_AT_ONCE = 1 << 16
# Fixed value: the pattern of byte-level pre-tokenizers.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = regex.compile(f"(?<=[^\\s{MARK}]) (?=[^\\s{MARK}])")
STATS = ["n_a", "n_b", "n_groups", "n_links", "n_group_links"]


class Rows:
    """A sparse matrix in compressed rows, every entry one."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, columns: int):
        self.indptr, self.indices, self.columns = indptr, indices, columns

    @classmethod
    def runs(cls, lengths: np.ndarray) -> Rows:
        """Row i holds the next ``lengths[i]`` columns: tokens by bytes."""
        indptr = np.concatenate([[0], np.cumsum(lengths)])
        return cls(indptr, np.arange(int(indptr[-1])), int(indptr[-1]))

    @classmethod
    def labels(cls, column: np.ndarray, columns: int) -> Rows:
        """Row i holds ``column[i]``: tokens by groups."""
        return cls(np.arange(len(column) + 1), column, columns)

    def transposed(self) -> Rows:
        row = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        if (self.indices[1:] < self.indices[:-1]).any():
            row = row[np.argsort(self.indices, kind="stable")]
        indptr = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.columns))])
        return Rows(indptr, row, len(self.indptr) - 1)


def product_sizes(a: Rows, b: Rows) -> np.ndarray:
    """Symbolic phase: how many terms each row of a·b gathers."""
    terms = np.concatenate([[0], np.cumsum(np.diff(b.indptr)[a.indices])])
    return terms[a.indptr[1:]] - terms[a.indptr[:-1]]


def row_products(a: Rows, b: Rows, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ``lo`` to ``hi`` of a·b as (row, column, value), by row, then column.

    Gustavson: each entry (i, k) of a adds row k of b to row i.
    """
    hi = len(a.indptr) - 1 if hi is None else hi
    k = a.indices[a.indptr[lo] : a.indptr[hi]]
    size = np.diff(b.indptr)[k]
    row = np.repeat(np.repeat(np.arange(lo, hi), np.diff(a.indptr[lo : hi + 1])), size)
    column = b.indices[ranges(b.indptr[k], size)]
    key = row * np.int64(b.columns) + column
    if len(key) and (np.diff(key) < 0).any():
        key = np.sort(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    value = np.diff(np.append(first, len(key)))
    key = key[first]
    return key // max(b.columns, 1), key % max(b.columns, 1), value


class Table:
    """Token bytes of one tokenizer by id, in one array."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        size = self.lengths[ids]
        return self.flat[ranges(self.starts[ids], size)].tobytes(), size


def byte_level_alphabet() -> dict[str, int]:
    """Byte of each character of byte-level entries: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


def as_ranks(data: bytes) -> dict[bytes, int] | None:
    """Ranks by token bytes, if the tokenizer file is plain byte-level BPE whose merges come in the order of their ids; else None."""
    spec = json.loads(data)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
             and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("dropout")
             and not model.get("ignore_merges") and not model.get("byte_fallback") and not model.get("continuing_subword_prefix")
             and not model.get("end_of_word_suffix"))
    if not plain:
        return None
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"].get("".join(m), -1) for m in merged]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    alphabet = byte_level_alphabet()
    names = [t for t in model["vocab"] if t not in special]
    single = sum(len(t) == 1 for t in names)
    # every longer entry has its merge, and a merge's place is its id's place
    if ids != sorted(ids) or len(set(ids)) != len(ids) or single != 256 or len(names) - single != len(ids) or any(c not in alphabet for t in names for c in t):
        return None
    return {bytes(alphabet[c] for c in t): model["vocab"][t] for t in names}


class Tokenizers:
    """Both tokenizers and their byte tables, made in a task from the files' bytes."""

    def __init__(self, json_data: bytes, model_data: bytes):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(json_data.decode())
        self.own.encode_special_tokens = True
        ranks = as_ranks(json_data)
        self.ranked = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.b = read_model(model_data)
        alphabet = byte_level_alphabet()
        names = [self.own.id_to_token(i) or "" for i in range(self.own.get_vocab_size())]
        self.bytes_a = Table([bytes(alphabet[c] for c in t) for t in names])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = Table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)])
        self.text_a = np.array([f"{i}{end}" for i in range(len(names)) for end in ",|"], object)
        self.text_b = np.array([f"{i}{end}" for i in range(len(pieces)) for end in ",;"], object)

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B, end to end, and how many each text has."""
        parts = [cut(t) for t in batch]
        flat = list(chain.from_iterable(parts))
        per = np.fromiter(map(len, parts), np.int64, len(parts))
        return *_flat([self._a(" " + p) for p in flat], per), *_flat(self.b.encode(flat, num_threads=1), per)

    def _a(self, text: str) -> list[int]:
        if self.ranked is not None:
            try:
                return self.ranked.encode_ordinary(text)
            except BaseException as e:  # noqa: BLE001 - its pattern engine gives up on very long runs of spaces, with a panic
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return self.own.encode(text, add_special_tokens=False).ids


def _flat(found: list[list[int]], per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.cumsum(per)
    return np.fromiter(chain.from_iterable(found), np.int64, int(total[-1])), total[ends] - total[ends - per]


def cut(text: str) -> list[str]:
    """Parts of a long text, each to be encoded with a space before it; [] for an empty one."""
    out, start = [], 0
    while len(text) - start > PART:
        at = _CUT.search(text, start + PART)
        if at is None:
            break
        out.append(text[start : at.start()])
        start = at.end()
    return [*out, text[start:]] if text else []


class Aligned:
    """The alignment of a list of texts: token arrays of all texts end to end."""

    def __init__(self, batch: list[str], tools: Tokenizers):
        a, n_a, b, n_b = tools.encode(batch)
        data_a, size_a = tools.bytes_a.join(a)
        data_b, size_b = tools.bytes_b.join(b)
        at_a = np.concatenate([[0], np.cumsum(size_a)])[np.concatenate([[0], np.cumsum(n_a)])].tolist()
        at_b = np.concatenate([[0], np.cumsum(size_b)])[np.concatenate([[0], np.cumsum(n_b)])].tolist()
        same = np.zeros(len(batch), bool)
        for i, text in enumerate(batch):
            want = b" " + text.encode() if text else b""
            same[i] = bool(text) and data_a[at_a[i] : at_a[i + 1]] == want and data_b[at_b[i] : at_b[i + 1]] == want
        keep_a, keep_b = np.repeat(same, n_a), np.repeat(same, n_b)
        self.tools, self.texts = tools, len(batch)
        self.a, self.b = a[keep_a], b[keep_b]
        self.n_a, self.n_b = np.where(same, n_a, 0), np.where(same, n_b, 0)
        self.size_a, self.size_b = size_a[keep_a], size_b[keep_b]
        self.doc_a = np.repeat(np.arange(self.texts), self.n_a)
        ends_a, ends_b = np.cumsum(self.size_a), np.cumsum(self.size_b)
        # the tokens that end where one of the other tokenizer ends
        near = np.searchsorted(ends_b, ends_a)
        last_a = np.flatnonzero(ends_b[near] == ends_a)
        last_b = near[last_a]
        self.n_shared = len(last_a)
        self.start_a, self.start_b = np.append(0, last_a + 1), np.append(0, last_b + 1)  # first token of each group
        self.group_a = np.repeat(np.arange(self.n_shared), np.diff(self.start_a))
        self.group_b = np.repeat(np.arange(self.n_shared), np.diff(self.start_b))
        self.n_groups = np.bincount(self.doc_a[last_a], minlength=self.texts)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token of A, token of B, shared bytes) of every overlap."""
        return row_products(Rows.runs(self.size_a), Rows.runs(self.size_b).transposed())

    def _groups(self) -> tuple[Rows, Rows]:
        return Rows.labels(self.group_a, self.n_shared), Rows.labels(self.group_b, self.n_shared).transposed()

    def n_group_links(self) -> np.ndarray:
        """Shared-group links of each text, counted without making them."""
        return np.bincount(self.doc_a, product_sizes(*self._groups()), self.texts).astype(np.int64)

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(tokens of A, tokens of B) of the shared-group links, in blocks of rows."""
        a, b = self._groups()
        ends, lo = np.cumsum(product_sizes(a, b)), 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + ROWS_AT_ONCE, "right")))
            rows, columns, _ = row_products(a, b, lo, hi)
            yield rows, columns
            lo = hi

    def group_texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        seq = np.empty(len(self.a) + len(self.b), object)
        key_a, key_b = 2 * self.a, 2 * self.b
        key_a[self.start_a[1:] - 1] += 1
        key_b[self.start_b[1:] - 1] += 1
        # a group's tokens of A stand behind the earlier groups' of B, its tokens of B behind its own of A
        seq[np.arange(len(self.a)) + self.start_b[self.group_a]] = self.tools.text_a[key_a]
        seq[np.arange(len(self.b)) + self.start_a[self.group_b + 1]] = self.tools.text_b[key_b]
        cuts = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        return ["".join(seq[lo:hi].tolist())[:-1] for lo, hi in zip(cuts, cuts[1:])]


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_FILE_BYTES + 1)
    if len(data) > MAX_FILE_BYTES:
        raise ValueError(f"{path}: over {MAX_FILE_BYTES} bytes")
    return data


def _aligned(docs: DataFrame, json_path: str, model_path: str, schema: str, give: Callable[[Iterator[tuple[list, Aligned]]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Rows that ``give`` makes of each task's aligned slices of documents."""
    data = _file(json_path), _file(model_path)
    check_model(read_model(data[1]))
    sent = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tools = Tokenizers(*sent.value)

        def found() -> Iterator[tuple[list, Aligned]]:
            for batch in batches:
                for part in slices(batch, "text", max_bytes=SLICE_BYTES):
                    yield part.column("doc_id").to_pylist(), Aligned(part.column("text").to_pylist(), tools)

        yield from give(found())
        del tools
        release()

    return texts(docs).mapInArrow(run, schema)


def groups(docs: DataFrame, json_path: str, model_path: str) -> DataFrame:
    """``doc_id`` and ``groups`` (``a1,a2|b1;a3|b2,b3``) of every text."""
    def give(found):
        for ids, al in found:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(al.group_texts(), pa.string())], ["doc_id", "groups"])

    return _aligned(docs, json_path, model_path, "doc_id long, groups string", give)


_LINK = ["doc_id", "a_pos", "b_pos", "a_id", "b_id"]


def _link_rows(ids: list, al: Aligned, row: np.ndarray, column: np.ndarray) -> list[pa.Array]:
    doc = al.doc_a[row]
    first_a, first_b = np.cumsum(al.n_a) - al.n_a, np.cumsum(al.n_b) - al.n_b
    numbers = (row - first_a[doc], column - first_b[doc], al.a[row], al.b[column])
    return [pa.array(ids, pa.int64()).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in numbers)]


def links(docs: DataFrame, json_path: str, model_path: str) -> DataFrame:
    """One row per overlap link: token positions and ids, and the ``bytes`` they share."""
    def give(found):
        for ids, al in found:
            row, column, value = al.links()
            for lo in range(0, len(row), ROWS_AT_ONCE):
                s = slice(lo, lo + ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([*_link_rows(ids, al, row[s], column[s]), pa.array(value[s], pa.int64())], [*_LINK, "bytes"])

    return _aligned(docs, json_path, model_path, ", ".join(f"{c} long" for c in [*_LINK, "bytes"]), give)


def group_links(docs: DataFrame, json_path: str, model_path: str) -> DataFrame:
    """One row per shared-group link (as many as a group has pairs: ask for bounded texts)."""
    def give(found):
        for ids, al in found:
            for row, column in al.group_links():
                yield pa.RecordBatch.from_arrays(_link_rows(ids, al, row, column), _LINK)

    return _aligned(docs, json_path, model_path, ", ".join(f"{c} long" for c in _LINK), give)


class Block:
    """Documents of one block: their figures and their links as (document, pair)."""

    def __init__(self):
        self.ids, self.stats, self.digests, self.docs, self.pairs, self.links = [], [], [], [], [], 0

    def add(self, ids: list, al: Aligned) -> None:
        row, column, _ = al.links()
        doc = al.doc_a[row]
        self.docs.append((doc + len(self.ids)).astype(np.int32))
        self.pairs.append(al.b[column] << 32 | al.a[row])
        self.links += len(row)
        self.stats.append(np.stack([al.n_a, al.n_b, al.n_groups, np.bincount(doc, minlength=al.texts), al.n_group_links()]))
        self.digests += [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in al.group_texts()]
        self.ids += ids

    def row(self, block: int) -> pa.RecordBatch:
        pairs, place = np.unique(np.concatenate(self.pairs), return_inverse=True)
        times = np.bincount(place, minlength=len(pairs))
        cell = np.concatenate(self.docs) * np.int64(len(pairs)) + place
        del place
        cell, value = np.unique(cell, return_counts=True)
        doc, column = np.divmod(cell, max(len(pairs), 1))
        stats = np.concatenate(self.stats, axis=1)
        per = np.bincount(doc, minlength=len(self.ids))
        one = lambda x, t: pa.array([x], pa.list_(t))
        return pa.RecordBatch.from_arrays([
            pa.array([block], pa.int64()), one(self.ids, pa.int64()), *(one(x, pa.int64()) for x in stats), one(self.digests, pa.string()),
            one(pairs, pa.int64()), one(times, pa.int64()), one(per, pa.int64()), pa.array([pack(column)], pa.binary()), pa.array([pack(value)], pa.binary()),
        ], _BLOCK)


_BLOCK = ["block", "doc_ids", *STATS, "groups_sha256", "pairs", "times", "cells", "columns", "counts"]
_BLOCK_SCHEMA = ("block long, doc_ids array<long>, " + ", ".join(f"{c} array<long>" for c in STATS)
                 + ", groups_sha256 array<string>, pairs array<long>, times array<long>, cells array<long>, columns binary, counts binary")


def align_blocks(docs: DataFrame, json_path: str, model_path: str) -> DataFrame:
    """One row per block: figures of its documents and its matrix of documents by id pairs."""
    def give(found):
        base, serial, block = TaskContext.get().partitionId() << 32, 0, Block()
        for ids, al in found:
            block.add(ids, al)
            if block.links >= BLOCK_LINKS:
                yield block.row(base + serial)
                serial, block = serial + 1, Block()
        if block.ids:
            yield block.row(base + serial)

    return _aligned(docs, json_path, model_path, _BLOCK_SCHEMA, give)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Corpus-wide links of each id pair (``pair`` is B id, then A id), and whether none of its B id has more."""
    total = pairs.groupBy("pair").agg(F.sum("times").alias("links"))
    # at most one row per id of A in a window
    most = F.max("links").over(Window.partitionBy(F.shiftright("pair", 32)))
    return total.select("pair", "links", (F.col("links") == most).alias("best"))


def _weigh(left: pa.Table, right: pa.Table) -> pa.Table:
    row = left.to_pylist()[0]
    place = right.column("place").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place] = right.column("links").to_numpy()
    best[place] = right.column("best").to_numpy()
    column, value = unpack(row["columns"]).astype(np.int64), unpack(row["counts"]).astype(np.int64)
    ends = np.cumsum(np.array(row["cells"], np.int64))
    if len(value) and float(count.max()) * float(value.sum()) > 2.0**62:
        count = count.astype(object)  # exact, and an error beyond 64 bits

    def times(x: np.ndarray) -> list:
        sums = np.concatenate([np.zeros(1, x.dtype), np.cumsum(value * x[column])])
        return np.diff(sums[np.concatenate([[0], ends])]).tolist()

    return pa.Table.from_arrays([
        pa.array(row["doc_ids"], pa.int64()), *(pa.array(row[c], pa.int64()) for c in STATS[:4]),
        pa.array(times(best), pa.int64()), pa.array(times(count), pa.int64()), pa.array(row["groups_sha256"], pa.string()), pa.array(row["n_group_links"], pa.int64()),
    ], ["doc_id", *STATS[:4], "n_best", "count_sum", "groups_sha256", "n_group_links"])


def op11_alignment(docs: DataFrame, json_path: str, model_path: str) -> DataFrame:
    """The contract's rows, and ``n_group_links``, the number of shared-group links."""
    size = input_bytes(docs, "text")
    path = shared_path(docs.sparkSession, "aligned-blocks")
    blocks = write_bucketed(align_blocks(docs, json_path, model_path), path, min(50_000, max(64, size >> 20)), ["block"])
    stored = docs.sparkSession.read.schema(blocks.schema).parquet(path)
    pairs = stored.select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "p"))
    pairs = pairs.select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counted = pairs.join(pair_counts(pairs), "pair").select("block", "place", "links", "best")
    left = blocks.drop("pairs", "times")
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in STATS[:4]) + ", n_best long, count_sum long, groups_sha256 string, n_group_links long"
    return left.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(_weigh, schema)
