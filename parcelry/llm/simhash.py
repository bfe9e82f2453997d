"""Operator 3, fingerprint half: 64-bit SimHash over word shingles.

A shingle is ``k`` consecutive words joined by one space (fewer words: the
whole sequence); its hash is XXH64 of the UTF-8 bytes with seed 42.  A bit of
the fingerprint is 1 if it is set in more than half of the shingle hashes,
repeats included.  A text without words has fingerprint zero.
"""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
_xxh = xxhash.xxh64_intdigest
# Shingles whose bits are counted at once (64 bytes each).
_BLOCK = 16_384


def word_spans(text: bytes) -> tuple[bytes, list[int], list[int]]:
    """Text with A-Z lowered and words joined by one space; start and end of each word."""
    words = text.lower().split()
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    if len(words):
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
    return joined, starts.tolist(), ends.tolist()


def bit_majority(hashes: np.ndarray) -> int:
    """Fingerprint of the shingle hashes: bit set in over half of them."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, n, _BLOCK):
        part = np.ascontiguousarray(hashes[i : i + _BLOCK]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, k: int = 3) -> int:
    """SimHash of UTF-8 ``text`` over ``k``-word shingles (unsigned 64 bits).

    ``bytes.lower`` lowers A-Z only and ``bytes.split`` cuts at exactly
    space and 0x09-0x0D, which are the contract's rules.
    """
    joined, starts, ends = word_spans(text)
    n = len(starts)
    if not n:
        return 0
    if n <= k:
        return _xxh(joined, SEED)
    hashes = np.fromiter((_xxh(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])), np.uint64, n - k + 1)
    return bit_majority(hashes)
