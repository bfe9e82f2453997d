"""Operators 3, 5 and 9 against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from parcelry.llm import exact_dedup, near_dedup, substring_dedup
from parcelry.llm.simhash import fingerprint

ID = lambda d: (d is None, d or 0)


def test_exact_duplicates(docs, doc_rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for d, t, *_ in doc_rows:
        groups[norm(t)].append(d)
    want = Counter()
    for n, ids in groups.items():
        keep = min(ids, key=ID)
        sha = hashlib.sha256(n.encode()).hexdigest()
        first = True
        for d in sorted(ids, key=ID):
            want[(d, keep, len(ids), d == keep and first, sha)] += 1
            first = False
    for bucket in (1, 1_000_000):  # with one entry a bucket the directory doubles to its full depth
        got = exact_dedup.exact_duplicates(docs, bucket_rows=bucket, max_depth=8)
        assert Counter(map(tuple, got.collect())) == want


def test_extendible_directory(docs):
    index = exact_dedup.build_index(docs, bucket_rows=8, max_depth=12).toPandas()
    assert index.groupby("bucket").size().max() <= 8 and index["depth"].nunique() > 1
    assert not index.duplicated(["h", "sha"]).any() and (index["chain"] == 1).all()


def test_exact_duplicates_are_dropped(docs, doc_rows, no_docs):
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in doc_rows})
    assert sum(r["doc_id"] == 5 for r in rows) == 1
    assert exact_dedup.exact_duplicates(no_docs).count() == 0 and exact_dedup.drop_exact_duplicates(no_docs).count() == 0


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs):
    """(id, fingerprint) -> smallest id reachable, by union-find over all pairs."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    low = {}
    for d, f in pairs:
        r = find(f)
        low[r] = min(low.get(r, d), d, key=ID)
    return {(d, f): low[find(f)] for d, f in pairs}


def test_simhash_rows(docs, doc_rows, no_docs):
    pairs = [(d, slow_fingerprint(t)) for d, t, *_ in doc_rows if t is None or len(t) < 20_000]
    for d, t, *_ in doc_rows:
        if t and len(t) >= 20_000:
            pairs.append((d, fingerprint(t.encode())))
    low = slow_components(pairs)
    got = Counter(map(tuple, near_dedup.op3_simhash(docs).collect()))
    assert got == Counter((d, f"{f:016x}", low[d, f]) for d, f in pairs)
    assert near_dedup.op3_simhash(no_docs).count() == 0


def test_every_link_is_found(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(6):  # chains of flips, some within three bits, some beyond
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
            fps.add(x)
    signed = np.array(sorted(fps), np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long").repartition(4)
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed.tolist()) for b in signed.tolist()[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert set(map(tuple, near_dedup.links(df).collect())) == want and len(want) > 100
    labels = {r["node"]: r["label"] for r in near_dedup.components(near_dedup.links(df)).collect()}
    assert all(labels[a] == labels[b] for a, b in want) and all(labels[x] <= x for x in labels)


def test_golay_code_is_perfect():
    words = np.arange(1 << 12, dtype=np.uint32) << np.uint32(11)
    codewords = words | near_dedup._syndrome(words)
    weights = Counter(np.bitwise_count(codewords).tolist())
    assert weights == {0: 1, 7: 253, 8: 506, 11: 1288, 12: 1288, 15: 506, 16: 253, 23: 1}
    flipped = codewords[1234] ^ np.array([0, 1, 1 << 22, 0b11 << 9, 0b111], np.uint32)
    assert (near_dedup.codeword_index(flipped) == 1234).all()


def test_one_document_of_each_group_stays(docs, doc_rows, no_docs):
    out = near_dedup.one_per_group(docs)
    assert out.columns == docs.columns
    pairs = [(d, fingerprint((t or "").encode())) for d, t, *_ in doc_rows]
    low = slow_components(pairs)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(d for d, f in pairs if low[d, f] == d)
    assert near_dedup.one_per_group(no_docs).count() == 0


def slow_repeats(rows, width):
    first = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    key = lambda d: (1 << 63) - 1 if d is None else d
    for d, w in words:
        for i in range(len(w) - width + 1):
            s = tuple(w[i : i + width])
            first[s] = min(first.get(s, key(d)), key(d))
    out = Counter()
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < key(d):
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[(d, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_repeated_passages(docs, doc_rows, no_docs):
    want = slow_repeats([r[:2] for r in doc_rows], 13)
    assert Counter(map(tuple, substring_dedup.op9_substring_dedup(docs).collect())) == want
    assert substring_dedup.op9_substring_dedup(no_docs).count() == 0


def test_repeats_over_many_chunks_and_groups(spark):
    rng = random.Random(11)
    vocabulary = ["a", "b", "c"]  # few words: many repeats and heavy prefixes
    rows = [(i % 50, " ".join(rng.choices(vocabulary, (8, 3, 1), k=rng.randrange(0, 60)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = substring_dedup.find_repeats(df, width=4, group=20, chunk_bytes=400)
    found = Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got.collect())
    assert found == slow_repeats(rows, 4)


def test_chunks_hold_even_bytes_and_rows_without_ids_spread(spark):
    rng = random.Random(12)
    vocabulary = ["a", "b", "c", "d"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=200 if i < 40 else 3))) for i in range(400)]
    rows += [(None, " ".join(rng.choices(vocabulary, k=20))) for _ in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt, _, _, no_id = substring_dedup.cut_chunks(substring_dedup.texts(df), 1_000)
    size = Counter()
    for r in dealt.collect():
        assert (r["doc_id"] is None) == (r["chunk"] >= no_id)
        size[r["chunk"]] += len(r["text"])
    assert max(size.values()) < 3_000 and sum(c >= no_id for c in size) > 4
    got = substring_dedup.find_repeats(df, width=4, group=100, chunk_bytes=1_000)
    found = Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got.collect())
    assert found == slow_repeats(rows, 4)


def test_heavy_prefixes_split_groups():
    text = ("the " * 300 + "stone river paper " * 50).encode()
    hashes = [substring_dedup.word_hashes(text)]
    path, one = substring_dedup.suffixes(hashes, 13, {}, 64)
    heavy = {1: np.sort(np.unique(hashes[0] * substring_dedup._factors(13)[0]))}
    again, two = substring_dedup.suffixes(hashes, 13, heavy, 64)
    assert (path == again).all() and len(np.unique(two)) >= len(np.unique(one))
    for p in np.unique(path):  # equal suffixes always share a group
        assert len(np.unique(two[path == p])) == 1
