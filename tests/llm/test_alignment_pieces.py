"""Operators 11 and 12 against the tokenizers' own libraries on whole texts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from parcelry.llm import sentence_pieces as sp_op
from parcelry.llm import token_alignment as al

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["▁ mark", "a▁b", "<s>hi</s> <|endoftext|>", " lead", "trail  ", "tab\tline\r\n\nend", "\x00 zero", "ａ①é ﬁ ﻿", "a\xa0b　c", "🏳️‍🌈 👩‍👩‍👧 x", "don't we'll 'S", "   ", "é" * 40, "1234567 89,0 ++ --"]


@pytest.fixture(scope="module")
def rows(doc_rows):
    return [r[:2] for r in doc_rows] + [(1000 + i, t) for i, t in enumerate(ODD)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    from tests.llm.conftest import CLASH, DOC_SCHEMA

    return spark.createDataFrame([(i, t, "en", "s", 1) + CLASH for i, t in rows], DOC_SCHEMA).repartition(3)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def pieces_expected(rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, t in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        yield i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids).encode())


def test_pieces_equal_library(docs, rows):
    got = sp_op.op12_sentencepiece(docs, MODEL)
    assert Counter(map(tuple, got.collect())) == Counter(pieces_expected(rows))
    plan = got._jdf.queryExecution().executedPlan().toString()
    cogroup = plan.split("FlatMapCoGroupsInArrow", 1)[1]
    assert "Bucketed: true" in cogroup.split("Exchange", 1)[0], "the position lists stay where they are"


def test_pieces_small_blocks_and_many_classes(docs, rows, monkeypatch):
    monkeypatch.setattr(sp_op, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(sp_op, "WORDS_AT_ONCE", 64)
    got = sp_op.encode(docs, MODEL, classes=977)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = Counter((i, tuple(sp.encode(t or "", add_bos=True, add_eos=True))) for i, t in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == want


def test_pieces_no_rows(no_docs):
    assert sp_op.op12_sentencepiece(no_docs, MODEL).collect() == []


def test_decode_any_ids(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = np.random.default_rng(5)
    runs = [[], [1], [1, 2], [0], [3 + 0xC3], [1, 3 + 0xC3, 3 + 0xA9, 2], [3 + 0x20, 300], [1, 3 + 0xFF, 400, 2]]
    runs += [rng.integers(0, 32_000, n).tolist() for n in (1, 2, 5, 50)] + [rng.integers(0, 270, 30).tolist() for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(runs)), "ids_of long, ids array<int>")
    got = dict(map(tuple, sp_op.decode(df, MODEL).collect()))
    assert got == {i: sp.decode(r) for i, r in enumerate(runs)}


def test_models_that_join_across_markers_are_refused():
    class Joins:
        get_piece_size = staticmethod(lambda: 1)
        id_to_piece = staticmethod(lambda i: "a▁b")

    with pytest.raises(ValueError):
        sp_op.check_model(Joins())


# ------------------------------------------------------------ alignment

def alignment_expected(rows):
    """By definition, one token at a time."""
    a_tok = Tokenizer.from_file(JSON)
    a_tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    alphabet = al.byte_level_alphabet()
    docs, links, count = [], [], Counter()
    for i, t in rows:
        a = a_tok.encode(" " + (t or ""), add_special_tokens=False).ids
        b = sp.encode(t or "")
        bytes_a = [bytes(alphabet[c] for c in a_tok.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [sp.id_to_piece(x)]]
        want = (" " + (t or "")).encode()
        if not t or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            docs.append((i, [], [], [], []))
            links.append([])
            continue
        end_a, end_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        found, j = [], 0
        for k, end in enumerate(end_a):
            start = end - len(bytes_a[k])
            while end_b[j] <= start:
                j += 1
            m = j
            while m < len(b) and end_b[m] - len(bytes_b[m]) < end:
                found.append((k, m, min(end, end_b[m]) - max(start, end_b[m] - len(bytes_b[m]))))
                m += 1
        both = sorted(set(end_a) & set(end_b))
        groups, x, y = [], 0, 0
        for e in both:
            x2, y2 = end_a.index(e, x) + 1, end_b.index(e, y) + 1
            groups.append((a[x:x2], b[y:y2]))
            x, y = x2, y2
        docs.append((i, a, b, groups, found))
        links.append([(a[k], b[m]) for k, m, _ in found])
        count.update(links[-1])
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    for (i, a, b, groups, found), pairs in zip(docs, links):
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        yield (i, len(a), len(b), len(groups), len(pairs), sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs),
               sha(text.encode()) if a else "", sum(len(g) * len(h) for g, h in groups)), text, a, b, found


def test_alignment_by_definition(docs, rows):
    got = al.op11_alignment(docs, JSON, MODEL)
    assert Counter(map(tuple, got.collect())) == Counter(x[0] for x in alignment_expected(rows))


def test_alignment_small_blocks_and_parts(docs, rows, monkeypatch):
    monkeypatch.setattr(al, "BLOCK_LINKS", 500)
    monkeypatch.setattr(al, "PART", 40)
    got = al.op11_alignment(docs, JSON, MODEL)
    assert Counter(map(tuple, got.collect())) == Counter(x[0] for x in alignment_expected(rows))


def test_alignment_no_rows(no_docs):
    assert al.op11_alignment(no_docs, JSON, MODEL).collect() == []


def test_links_groups_and_shared_group_links(spark, rows, monkeypatch):
    monkeypatch.setattr(al, "ROWS_AT_ONCE", 100)
    few = [(i, t) for i, t in rows if i is not None and len(t or "") < 2_000 and i not in (5, 6)]
    df = spark.createDataFrame(few, "doc_id long, text string")
    want = {x[0][0]: x for x in alignment_expected(few)}
    assert {r.doc_id: r.groups for r in al.groups(df, JSON, MODEL).collect()} == {i: x[1] for i, x in want.items()}
    links = Counter(map(tuple, al.links(df, JSON, MODEL).collect()))
    assert links == Counter((i, k, m, x[2][k], x[3][m], n) for i, x in want.items() for k, m, n in x[4])
    shared = Counter(r.doc_id for r in al.group_links(df, JSON, MODEL).collect())
    assert shared == Counter({i: x[0][8] for i, x in want.items() if x[0][8]})


def test_row_products_equal_dense():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = rng.random((7, 9)) < 0.3, rng.random((9, 5)) < 0.3
        rows_of = lambda m: al.Rows(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1], m.shape[1])
        row, column, value = al.row_products(rows_of(x), rows_of(y))
        dense = np.zeros((7, 5), int)
        dense[row, column] = value
        assert (dense == x.astype(int) @ y.astype(int)).all()
        assert (al.product_sizes(rows_of(x), rows_of(y)) == x.astype(int) @ y.sum(1)).all()
        t = rows_of(x).transposed()
        assert (t.indices == np.nonzero(x.T)[1]).all()


def test_ranks_equal_the_file_on_every_character():
    """The rank library and the tokenizer file's own agree on every code point, beside letters, digits, signs and spaces."""
    own = Tokenizer.from_file(JSON)
    own.encode_special_tokens = True
    with open(JSON, "rb") as f, open(MODEL, "rb") as m:
        tools = al.Tokenizers(f.read(), m.read())
    assert tools.ranked is not None
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(chars), 20_000):
        for text in (" ".join(chars[lo : lo + 20_000]), "".join(f"a{c}1{c}.{c} {c}b" for c in chars[lo : lo + 20_000 : 7])):
            assert tools.ranked.encode_ordinary(text) == own.encode(text, add_special_tokens=False).ids
    for text in [" " * 300_000, "\n" * 300_000 + "x", "x" * 300_000, " <|endoftext|> don't 'S", "\t \r\n"]:
        assert tools._a(text) == own.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_are_left_to_their_own_library():
    import json

    with open(JSON, "rb") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][1:] + spec["model"]["merges"][:1]
    assert al.as_ranks(json.dumps(spec).encode()) is None
    spec["pre_tokenizer"]["add_prefix_space"] = True
    assert al.as_ranks(json.dumps(spec).encode()) is None
