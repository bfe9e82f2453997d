"""Operator 6: byte-level BPE encoding and decoding.

Texts are cut by the tokenizer's pattern; each match is merged on its own by
the ranks of a rank file, without special tokens.

Method.  Over the byte positions of a match lies a segment tree whose leaf i
holds the rank of the pair (token starting at i, next live token), or
infinity.  The root gives the lowest rank and, among equal ranks, the
leftmost position.  A merge links the left token to the neighbour behind the
right one and updates three leaves (the merged token, its live neighbour to
the left, the token that went).  Many short matches of one length class are
merged side by side in numpy, one merge each per step, and the trees' levels
are renewed together; matches over ``LONG`` bytes run the same tree in a
loop, where an update takes logarithmic time.

The rank file is read on the driver (its path is a parameter) and sent to
the executors: its size is checked against ``MAX_RANK_BYTES``.  A task keeps
the ids of matches it met in a table of bounded size and drops it at its end.

Defined cases: a null or empty text has no ids and decodes to no bytes; null
ids and repeated rows are kept; a very long text is one row like any other.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from parcelry.llm.common import release, slices, texts

LONG = 64
CACHE_ENTRIES = 150_000
MAX_RANK_BYTES = 32 << 20
_INF = np.int64(1) << 62
_MIX = np.uint64(0x9E3779B97F4A7C15)  # 2 ** 64 over the golden ratio: spreads keys over a table


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file."""
    rows = (line.split() for line in data.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in rows}


def _runs(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one behind the other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Tokens:
    """The tokens' bytes of one rank file, in one array."""

    def __init__(self, data: bytes):
        ranks = read_ranks(data)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and the length of each id's token."""
        lengths = self.lengths[ids]
        return _runs(self.flat, self.starts[ids], lengths), lengths

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """Bytes of each list of ids."""
        parts = [pa.array([], pa.binary())]
        for lo in range(0, len(lists), 64):
            part = lists.slice(lo, 64)
            per = np.diff(part.offsets.to_numpy())
            data, lengths = self.decode(part.flatten().to_numpy(zero_copy_only=False))
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(per)])]
            parts.append(pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]))
        return pa.concat_arrays(parts)


class Vocabulary:
    """Ranks and merge table of one rank file, and the ids of the matches met so far."""

    def __init__(self, data: bytes):
        self.ranks = read_ranks(data)
        size = max(self.ranks.values()) + 1
        self.size = size
        self.merges = {
            (self.ranks[t[:i]], self.ranks[t[i:]]): r
            for t, r in self.ranks.items() if len(t) > 1
            for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks
        }
        self._table(np.fromiter((a * size + b for a, b in self.merges), np.int64, len(self.merges)), np.fromiter(self.merges.values(), np.int64, len(self.merges)))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.byte_pairs = self.pair_rank(self.byte_ids[:, None].repeat(256, 1).ravel(), np.tile(self.byte_ids, 256)).reshape(256, 256)
        self.forget()

    def forget(self) -> None:
        """Empty the table of matches: ``cache`` gives a match's place; its ids lie in one array."""
        self.cache: dict[str, int] = {}
        self._ids, self._starts, self._lengths = (np.zeros(0, t) for t in (np.int32, np.int64, np.int64))

    def _table(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing over the merges, at most a quarter full."""
        bits = max(4, (4 * len(keys)).bit_length())
        self._shift = np.uint64(64 - bits)
        self._keys, self._merged = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _INF, np.int64)
        at = self._slot(keys)
        while len(keys):
            _, first = np.unique(at, return_index=True)
            first = first[self._keys[at[first]] == -1]
            self._keys[at[first]], self._merged[at[first]] = keys[first], ranks[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, at = keys[rest], ranks[rest], self._next(at[rest])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _MIX >> self._shift).astype(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & (len(self._keys) - 1)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids; infinity if it is none."""
        key = left * self.size + right
        at = self._slot(key)
        rank, there = self._merged[at], self._keys[at]
        todo = np.nonzero((there != key) & (there != -1))[0]
        rank[there != key] = _INF
        while len(todo):
            at_ = self._next(at[todo])
            at[todo] = at_
            there = self._keys[at_]
            hit = there == key[todo]
            rank[todo[hit]] = self._merged[at_[hit]]
            todo = todo[~hit & (there != -1)]
        return rank

    def merge_batch(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Ids of pieces of at most ``width`` bytes (a power of two), merged side by side."""
        flat, per = self._merge_side_by_side(pieces, width)
        return [part.tolist() for part in np.split(flat, np.cumsum(per)[:-1])]

    def _merge_side_by_side(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and their number by piece.  A column of the arrays is
        a piece; the trees' levels are renewed for all pieces at once."""
        rows, n = len(pieces), width
        sizes = np.fromiter(map(len, pieces), np.int64, rows)
        pos = np.arange(n)[:, None]
        alive = pos < sizes
        raw = np.zeros((rows, n), np.uint8)
        raw[alive.T] = np.frombuffer(b"".join(pieces), np.uint8)
        raw = np.ascontiguousarray(raw.T)
        ids = np.zeros((n + 1, rows), np.int64)
        ids[:n] = self.byte_ids[raw]
        behind = np.where(pos + 1 < sizes, pos + 1, n)
        before = np.zeros((n + 1, rows), np.int64)
        before[:n] = pos - 1
        tree = np.full((2 * n, rows), _INF, np.int64)
        rank = self.byte_pairs[raw[:-1], raw[1:]]
        tree[n : 2 * n - 1] = np.where((behind[:-1] < n) & (rank < _INF), rank * n + pos[:-1], _INF)
        # by place in the array: position times number of pieces, plus piece
        ids_, behind_, before_, alive_, leaves = ids.ravel(), behind.ravel(), before.ravel(), alive.ravel(), tree[n:].ravel()
        r = np.arange(rows)
        while True:
            k = n // 2
            while k:
                np.minimum(tree[2 * k : 4 * k : 2], tree[2 * k + 1 : 4 * k : 2], out=tree[k : 2 * k])
                k //= 2
            best = tree[1][r]
            r, best = r[best < _INF], best[best < _INF]
            if not len(r):
                break
            at, merged = best % n, best // n
            here = at * rows + r
            there = behind_[here] * rows + r
            after = behind_[there]
            beyond = after * rows + r
            ids_[here], behind_[here], before_[beyond], alive_[there] = merged, after, at, False
            # point updates: the merged token's leaf, the one that went, the one to its left
            with_next = self.pair_rank(merged, ids_[beyond])
            leaves[here] = np.where((after < n) & (with_next < _INF), with_next * n + at, _INF)
            leaves[there] = _INF
            left = before_[here]
            some = left >= 0
            left = left[some]
            last = left * rows + r[some]
            with_last = self.pair_rank(ids_[last], merged[some])
            leaves[last] = np.where(with_last < _INF, with_last * n + left, _INF)
        return ids[:n].T[alive.T], alive.sum(axis=0)

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one long piece by the same segment tree."""
        size = len(piece)
        n = 1 << (size - 1).bit_length()
        inf = int(_INF)
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        behind, before = list(range(1, size + 1)), list(range(-1, size - 1))
        alive = [True] * size
        find = self.merges.get
        tree = [inf] * (2 * n)
        for i in range(size - 1):
            r = find((ids[i], ids[i + 1]))
            if r is not None:
                tree[n + i] = r * n + i
        for node in range(n - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = n + i
            tree[node] = value
            node >>= 1
            while node:
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    return
                tree[node] = low
                node >>= 1

        while tree[1] < inf:
            merged, at = divmod(tree[1], n)
            gone = behind[at]
            after = behind[gone]
            ids[at], behind[at], alive[gone] = merged, after, False
            put(gone, inf)
            r = None
            if after < size:
                before[after] = at
                r = find((merged, ids[after]))
            put(at, inf if r is None else r * n + at)
            left = before[at]
            if left >= 0:
                r = find((ids[left], merged))
                put(left, inf if r is None else r * n + left)
        return [t for t, live in zip(ids, alive) if live]

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of ``pieces``, none of them known, into the worker's table."""
        texts_ = list(pieces)
        raws = [t.encode() for t in texts_]
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        whole = np.fromiter((self.ranks.get(raw, -1) for raw in raws), np.int64, len(raws))
        found = [(np.nonzero(whole >= 0)[0], whole[whole >= 0], np.ones(int((whole >= 0).sum()), np.int64))]
        sizes[whole >= 0] = 0
        for i in np.nonzero(sizes > LONG)[0]:
            ids = self.merge_long(raws[i])
            found.append((np.array([i]), np.array(ids), np.array([len(ids)])))
        width = 2
        while width <= LONG:
            group = np.nonzero((sizes > width // 2) & (sizes <= width))[0]
            for lo in range(0, len(group), 8192):
                part = group[lo : lo + 8192]
                found.append((part, *self._merge_side_by_side([raws[i] for i in part], width)))
            width *= 2
        starts, lengths = np.zeros(len(raws), np.int64), np.zeros(len(raws), np.int64)
        total = len(self._ids)
        for which, ids, per in found:
            lengths[which] = per
            starts[which] = total + np.cumsum(per) - per
            total += len(ids)
        self.cache.update(zip(texts_, range(len(self.cache), len(self.cache) + len(texts_))))
        self._ids = np.concatenate([self._ids, *(ids.astype(np.int32) for _, ids, _ in found)])
        self._starts, self._lengths = np.concatenate([self._starts, starts]), np.concatenate([self._lengths, lengths])

    def encode_flat(self, batch: list[str], pattern: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row and where each text's end (from 0 on); the
        new matches of the whole batch are merged together."""
        cut = [pattern.findall(t) for t in batch]
        fresh = set().union(*cut).difference(self.cache)
        if len(self.cache) + len(fresh) > CACHE_ENTRIES:
            self.forget()
            fresh = set().union(*cut)
        self.learn(fresh)
        upto = np.concatenate([[0], np.cumsum([len(pieces) for pieces in cut], dtype=np.int64)])
        places = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(cut)), np.int64, int(upto[-1]))
        per = self._lengths[places]
        return _runs(self._ids, self._starts[places], per), np.concatenate([[0], np.cumsum(per)])[upto]

    def encode(self, batch: list[str], pattern: regex.Pattern) -> list[list[int]]:
        """Ids of each text."""
        flat, ends = self.encode_flat(batch, pattern)
        return [flat[lo:hi].tolist() for lo, hi in zip(ends[:-1], ends[1:])]


def _sent(df: DataFrame, path: str):
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path}: rank file over {MAX_RANK_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(data)


def encode(docs: DataFrame, rank_path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` (array of token ids) of every whole text.

    With ``decoded``, also the bytes that the ids decode to: the same worker
    makes them, where a step of its own would keep a second one beside it.
    """
    ranks = _sent(docs, rank_path)
    names = ["doc_id", "ids", *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, compiled = Vocabulary(ranks.value), regex.compile(pattern)
        tokens = Tokens(ranks.value) if decoded else None
        for batch in batches:
            for part in slices(batch, "text", max_bytes=1 << 20):
                flat, ends = vocab.encode_flat(part.column("text").to_pylist(), compiled)
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                back = [tokens.decode_lists(ids)] if tokens else []
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, *back], names)
        del vocab, tokens
        release()

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>" + (", decoded binary" if decoded else ""))


def decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """All columns of ``encoded`` but ``ids``, which becomes ``decoded`` (its bytes)."""
    ranks = _sent(encoded, rank_path)
    kept = [f for f in encoded.schema.fields if f.name != "ids"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["decoded binary"])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(ranks.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), tokens.decode_lists(part.column("ids"))], [*names, "decoded"])
        release()

    return encoded.mapInArrow(run, schema)


def op6_bpe(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """The contract's rows: counts and digests of the encoded ids and decoded bytes."""
    ids_text = F.array_join(F.col("ids"), " ")
    both = encode(docs, rank_path, pattern, decoded=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_text.cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
