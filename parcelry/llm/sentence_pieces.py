"""Operator 12: SentencePiece encoding and decoding by a table of distinct chunks.

A model whose pieces never hold a whitespace marker behind another character
cannot merge across the start of a marked word.  A text is cut there into
chunks (a run of markers and the characters up to the next run); each
distinct chunk is segmented once, and its ids are joined back by position.

Plan.  One pass over the documents cuts them into blocks of about
``BLOCK_BYTES`` of text.  A block keeps the position list of its chunks, as
numbers into its own list of distinct chunks, so a chunk leaves a block once
however often the block holds it.  The distinct chunks leave in bundles, one
for each hash class; the number of classes grows with the input.  Bundles are
dealt by class, so all copies of a chunk meet in one task, which segments it
once; that task holds the chunks of one class at a time.  A frequent chunk
costs one entry a block, never one an occurrence.  The answers go back to
their block by a cogroup on the block number; the position lists are a
bucketed table, so only the answers move.

The model is checked first (``check_model``): pieces as above, text kept as
it is but for the marker put before it and in place of spaces.  Other models
are refused.

Defined cases: a null or empty text has only the begin and end ids and
decodes to the empty text; a marker character in a text counts as a space, as
in the library; null ids, ties and repeated rows are kept; a very long text
is one row of one block; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from parcelry.llm.common import input_bytes, release, shared_path, slices, texts
from parcelry.plans.layout import write_bucketed

MARK = "▁"
BLOCK_BYTES = 32 << 20
BLOCK_CHUNKS = 2_000_000  # distinct chunks of a block
CLASS_BYTES = 16 << 20  # input bytes to a hash class
MAX_CLASSES = 1 << 20
MAX_BUCKETS = 50_000
MAX_MODEL_BYTES = 64 << 20
WORDS_AT_ONCE = 1 << 18

_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_PARTS = ("block long, class int, doc_ids array<long>, n_chunks array<long>, "
          "positions binary, classes binary, chunks binary")


def read_model(data: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=data)


def check_model(sp: sentencepiece.SentencePieceProcessor) -> None:
    """Raise ValueError unless chunks of this model can be segmented on their own."""
    if any(re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
        raise ValueError("a piece holds a whitespace marker behind another character")
    probe = " ①  a\téﬁ "
    if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError("the model changes text beyond marking spaces")


def chunks(text: str) -> list[str]:
    """The marked chunks of a text, in order."""
    return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def segment(sp: sentencepiece.SentencePieceProcessor, found: list[str]) -> list[list[int]]:
    """Ids of each chunk; the library puts the first marker back itself."""
    ids = sp.encode([c[1:] for c in found], num_threads=1)
    bare = [sp.piece_to_id(MARK)]
    return [x if len(c) > 1 else bare for c, x in zip(found, ids)]


class Numbers(dict):
    """Numbers keys in the order they are first met."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Block:
    """Documents of one block: their chunks by number."""

    def __init__(self):
        self.number, self.ids, self.counts, self.positions, self.bytes = Numbers(), [], [], [], 0

    def add(self, doc_ids: list, batch: list[str]) -> None:
        cut = [chunks(t) for t in batch]
        self.ids += doc_ids
        self.counts += map(len, cut)
        self.positions.append(np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.uint32))

    def rows(self, block: int, classes: int) -> pa.RecordBatch:
        """One row with the positions, and one bundle of distinct chunks a class."""
        positions = np.concatenate(self.positions)
        frequent = np.argsort(-np.bincount(positions, minlength=len(self.number)), kind="stable")
        number = np.empty(len(frequent), np.int64)
        number[frequent] = np.arange(len(frequent))
        words = list(self.number)
        raw = [words[i].encode() for i in frequent.tolist()]
        of = np.fromiter((zlib.crc32(w) % classes for w in raw), np.int64, len(raw))
        order = np.argsort(of, kind="stable")
        kinds, first = np.unique(of[order], return_index=True)
        last = np.append(first[1:], len(order))
        press = zstandard.ZstdCompressor(level=3)
        bundles = [press.compress(b"".join(raw[i] for i in order[a:b].tolist())) for a, b in zip(first, last)]
        none = [None] * len(kinds)
        return pa.RecordBatch.from_arrays([
            pa.array([block] * (len(kinds) + 1), pa.int64()), pa.array([-1, *kinds.tolist()], pa.int32()),
            pa.array([self.ids, *none], pa.list_(pa.int64())), pa.array([self.counts, *none], pa.list_(pa.int64())),
            pa.array([pack(number[positions]), *none], pa.binary()), pa.array([pack(of), *none], pa.binary()),
            pa.array([None, *bundles], pa.binary()),
        ], ["block", "class", "doc_ids", "n_chunks", "positions", "classes", "chunks"])


def cut_blocks(docs: DataFrame, classes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, serial, block = TaskContext.get().partitionId() << 32, 0, Block()
        for batch in batches:
            for part in slices(batch, "text", max_bytes=1 << 20):
                block.add(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                block.bytes += part.column("text").nbytes
                if block.bytes >= BLOCK_BYTES or len(block.number) >= BLOCK_CHUNKS:
                    yield block.rows(base + serial, classes)
                    serial, block = serial + 1, Block()
        if block.ids:
            yield block.rows(base + serial, classes)
        del block
        release()

    return texts(docs).mapInArrow(run, _PARTS)


class Segments(dict):
    """Ids (as bytes) of the chunks of one class."""

    def __init__(self, sp):
        super().__init__()
        self.sp = sp

    def learn(self, found: list[str]) -> None:
        fresh = [c for c in dict.fromkeys(found) if c not in self]
        for c, ids in zip(fresh, segment(self.sp, fresh)):
            self[c] = np.array(ids, "<u4").tobytes()


def segment_bundles(bundles: DataFrame, model) -> DataFrame:
    """Ids of every bundle's chunks; bundles come sorted by class within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, table, at = read_model(model.value), None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "class", "chunks")]
            for block, kind, data in zip(*columns):
                if kind != at:
                    table, at = Segments(sp), kind
                found = _CHUNK.findall(zstandard.ZstdDecompressor().decompress(data).decode())
                table.learn(found)
                ids = [table[c] for c in found]
                lengths = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                yield pa.RecordBatch.from_arrays([
                    pa.array([block], pa.int64()), pa.array([kind], pa.int32()),
                    pa.array([pack(lengths)], pa.binary()), pa.array([pack(np.frombuffer(b"".join(ids), "<u4"))], pa.binary()),
                ], ["block", "class", "lengths", "ids"])
        del table
        release()

    return bundles.mapInArrow(run, "block long, class int, lengths binary, ids binary")


def _join_back(begin: int, end: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = right.sort_by("class").to_pydict()
        row = left.to_pylist()[0]
        of = unpack(row["classes"])
        place = np.empty(len(of), np.int64)
        place[np.argsort(of, kind="stable")] = np.arange(len(of))
        lengths = np.concatenate([*map(unpack, answers["lengths"]), np.empty(0, np.uint32)]).astype(np.int64)
        flat = np.concatenate([*map(unpack, answers["ids"]), np.array([begin, end], np.uint32)]).astype(np.int32)
        starts = np.cumsum(lengths) - lengths
        # chunk numbers to their ids, and two more for the begin and the end
        n = len(of)
        starts = np.append(starts[place], [len(flat) - 2, len(flat) - 1])
        lengths = np.append(lengths[place], [1, 1])
        positions, counts = unpack(row["positions"]), np.array(row["n_chunks"], np.int64)
        ends = np.cumsum(counts)
        out, per, lo = [], [], 0
        while lo < len(counts):
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + WORDS_AT_ONCE, "right")))
            cut = np.concatenate([[0], ends[lo:hi] - before])
            at = np.stack([cut[:-1], cut[1:]], 1).ravel()
            seq = np.insert(positions[before : before + int(cut[-1])].astype(np.int64), at, np.tile([n, n + 1], hi - lo))
            size = lengths[seq]
            out.append(flat[ranges(starts[seq], size)])
            per.append(np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], cut[1:] + 2 * np.arange(1, hi - lo + 1)])]))
            lo = hi
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(per))])
        ids = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(np.concatenate(out))).cast(pa.list_(pa.int32()))
        return pa.Table.from_arrays([pa.array(row["doc_ids"], pa.int64()), ids], ["doc_id", "ids"])

    return run


def _sent(df: DataFrame, path: str):
    with open(path, "rb") as f:
        data = f.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{path}: model over {MAX_MODEL_BYTES} bytes")
    sp = read_model(data)
    check_model(sp)
    return sp, df.sparkSession.sparkContext.broadcast(data)


def _sizes(docs: DataFrame) -> tuple[int, int]:
    """Hash classes and block buckets for the input's size; results do not depend on them."""
    size = input_bytes(docs, "text")
    return min(MAX_CLASSES, max(32, size // CLASS_BYTES)), min(MAX_BUCKETS, max(64, 8 * size // BLOCK_BYTES))


def encode(docs: DataFrame, model_path: str, classes: int | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` of every whole text, with the begin and end ids."""
    sp, model = _sent(docs, model_path)
    auto, buckets = _sizes(docs)
    path = shared_path(docs.sparkSession, "sentence-blocks")
    parts = write_bucketed(cut_blocks(docs, classes or auto), path, buckets, ["block"])
    bundles = docs.sparkSession.read.schema(parts.schema).parquet(path).filter("class >= 0").select("block", "class", "chunks")
    answers = segment_bundles(bundles.repartition("class").sortWithinPartitions("class"), model)
    blocks = parts.filter("class < 0").select("block", "doc_ids", "n_chunks", "positions", "classes")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_join_back(sp.bos_id(), sp.eos_id()), "doc_id long, ids array<int>")


class Pieces:
    """The bytes of a model's pieces, in one array."""

    def __init__(self, sp: sentencepiece.SentencePieceProcessor):
        self.sp = sp
        n = range(sp.get_piece_size())
        unknown = sp.decode([sp.unk_id()]).encode()
        names = [sp.id_to_piece(i) for i in n]
        raw = [b"" if sp.is_control(i) else unknown if sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i)
               else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.silent = np.array([sp.is_control(i) for i in n])
        self.marked = np.array([p.startswith(MARK) for p in names])
        self.lengths = np.array([len(b) for b in raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray, per: np.ndarray) -> list[str]:
        """The text of each run of ``per`` ids."""
        size = self.lengths[ids]
        data = self.flat[ranges(self.starts[ids], size)].tobytes()
        ends, texts_ = np.concatenate([[0], np.cumsum(size)]), []
        cut = np.concatenate([[0], np.cumsum(per)])
        for a, b in zip(cut.tolist(), cut[1:].tolist()):
            lo, hi = int(ends[a]), int(ends[b])
            first = a
            while first < b and self.silent[ids[first]]:
                first += 1
            if first < b and self.marked[ids[first]]:
                lo += 1  # the marker put before the text
            try:
                texts_.append(data[lo:hi].decode())
            except UnicodeDecodeError:  # byte pieces that make no character
                texts_.append(self.sp.decode(ids[a:b].tolist()))
        return texts_


def _decoded(batch: pa.RecordBatch, pieces: Pieces, rows: int = 64) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[str]]]:
    for lo in range(0, batch.num_rows, rows):
        part = batch.slice(lo, rows)
        lists = part.column("ids")
        per = np.diff(lists.offsets.to_numpy())
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        yield part, np.split(ids, np.cumsum(per)[:-1]), pieces.decode(ids, per)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """All columns of ``encoded`` but ``ids``, which becomes ``decoded`` (its text)."""
    _, model = _sent(encoded, model_path)
    kept = [f for f in encoded.schema.fields if f.name != "ids"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["decoded string"])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(read_model(model.value))
        for batch in batches:
            for part, _, found in _decoded(batch, pieces):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found, pa.string())], [*names, "decoded"])
        release()

    return encoded.mapInArrow(run, schema)


def op12_sentencepiece(docs: DataFrame, model_path: str) -> DataFrame:
    """The contract's rows: counts and digests of the encoded ids and the decoded text."""
    _, model = _sent(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(read_model(model.value))
        for batch in batches:
            for part, ids, found in _decoded(batch, pieces):
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in found]),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        release()

    return encode(docs, model_path).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
