"""Operators 6, 7 and 8: exact round trips and brute force."""

import base64
import hashlib
import json
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from parcelry.llm import bpe, html_extract, warc
from parcelry.llm.common import shared_path

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library(reference):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdeéñ \n\t1230.,ß漢😀'stre") for _ in range(rng.randrange(200))) for _ in range(400)]
    texts += ["a" * 5_000, " " * 3_000 + "x", "ab" * 4_000, "日本語" * 500, "<|endoftext|> hi", "", "é" * 200, "aaaa" * 17]
    vocab = bpe.Vocabulary(open(RANKS, "rb").read())
    got = vocab.encode(texts, regex.compile(public_tokenizers.PATTERN))
    assert got == [reference.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("size", [2, 3, 17, 64, 65, 200])
def test_long_and_batched_merges_agree(size):
    vocab = bpe.Vocabulary(open(RANKS, "rb").read())
    piece = bytes(random.Random(size).choices(b"abcdetion", k=size))
    width = 1 << (size - 1).bit_length()
    assert vocab.merge_batch([piece], width)[0] == vocab.merge_long(piece)


def test_bpe_rows(docs, doc_rows, no_docs, reference):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for d, t, *_ in doc_rows:
        ids = reference.encode_ordinary(t or "")
        want[(d, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))] += 1
    assert Counter(map(tuple, bpe.op6_bpe(docs, RANKS, public_tokenizers.PATTERN).collect())) == want
    assert bpe.op6_bpe(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_keeps_one_worker_a_task(docs):
    """Ids are made and decoded by one Python step: a second one would keep a worker of its own beside it."""
    df = bpe.op6_bpe(docs, RANKS, public_tokenizers.PATTERN)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_decode_step_gives_the_same_bytes(docs):
    both = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded=True)
    apart = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    rows = lambda df: Counter((r["doc_id"], bytes(r["decoded"])) for r in df.collect())
    assert rows(both) == rows(apart)


def test_cache_is_bounded(monkeypatch, reference):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50)
    vocab = bpe.Vocabulary(open(RANKS, "rb").read())
    pattern = regex.compile(public_tokenizers.PATTERN)
    for i in range(30):
        text = " ".join(f"w{i}x{j}" for j in range(20))
        assert vocab.encode([text], pattern) == [reference.encode_ordinary(text)]
        assert len(vocab.cache) <= 50 + 60


def test_pairs_and_ids_come_from_arrays(reference):
    """Every merge and nothing else is found without a search; the ids of known matches lie in one array."""
    vocab = bpe.Vocabulary(open(RANKS, "rb").read())
    left, right = map(np.array, zip(*vocab.merges))
    assert vocab.pair_rank(left, right).tolist() == list(vocab.merges.values())
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, vocab.size, (2, 50_000))
    assert vocab.pair_rank(a, b).tolist() == [vocab.merges.get(pair, int(bpe._INF)) for pair in zip(a.tolist(), b.tolist())]
    assert vocab.byte_pairs.shape == (256, 256)
    texts = ["whole wordish words", "", "qzx" * 30 + " wordish", "x"]
    for _ in range(2):  # new matches, then known ones
        flat, ends = vocab.encode_flat(texts, regex.compile(public_tokenizers.PATTERN))
        assert [flat[lo:hi].tolist() for lo, hi in zip(ends, ends[1:])] == [reference.encode_ordinary(t) for t in texts]
    assert flat.dtype == np.int32 and sorted(vocab.cache.values()) == list(range(len(vocab.cache)))


def slow_warc(rows):
    payload = lambda h: (h or "").encode()
    out = Counter()
    for d, _, h in rows:
        p = payload(h)
        ids = [x for x, _, g in rows if payload(g) == p]
        top = max((x for x in ids if x is not None), default=None)
        revisit = len(p) >= 1_000 and d != top
        out[(d, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", top if revisit else None)] += 1
    return out


def test_warc_rows(pages, page_rows, no_pages):
    got = [tuple(r) for r in warc.op7_warc(pages).collect()]
    assert Counter(got) == slow_warc(page_rows)
    assert warc.op7_warc(no_pages).count() == 0


def test_archives_are_warc_and_index_is_ordered(spark, pages, page_rows):
    path = shared_path(spark, "test-warc")
    warc.write_archives(pages, path, records_per_archive=2)
    raw = b"".join(bytes(r[0]) for r in spark.read.format("binaryFile").load(f"{path}/*.gz").select("content").collect())
    assert raw[:2] == b"\x1f\x8b"
    index = warc.merge_index(warc.read_archives(spark, path).repartition(3)).collect()
    keys = [warc._order(r) for r in index]
    assert keys == sorted(keys) and len(keys) == len(page_rows)
    assert len({r["archive"] for r in index}) >= len(page_rows) // 2


def test_a_damaged_archive_is_an_error():
    reader = warc.Captures("x")
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: d\r\nWARC-Payload-Digest: sha1:00\r\nContent-Length: %d"
    reader.add(head % 30)
    with pytest.raises(ValueError):
        reader.add(b"H" * 31)
    reader = warc.Captures("x")
    reader.add(head % len(b"Content-Length: 3\r\n\r\nabc"))
    with pytest.raises(ValueError):
        reader.add(b"Content-Length: 3")
        reader.add(b"abc")


def test_loser_tree_merges():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [
                sorted([(str(rng.randrange(20)), "t", rng.choice([None, 1, 2])) for _ in range(rng.randrange(12))], key=warc._order) for _ in range(k)]
        merged = list(warc.LoserTree(runs))
        assert [warc._order(r) for r in merged] == sorted(warc._order(r) for run in runs for r in run)


def test_url_key():
    assert warc.url_key("http://WWW.Example.org:80/a?b#c") == "org,example,www)/a?b"
    assert warc.url_key("https://x.org:8080") == "org,x:8080)/" and warc.url_key("") == ""


def test_warc_sql_matches(spark, pages, page_rows):
    rows = [r for r in page_rows if r[0] is not None and r[0] != 8]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    got = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.SQL})").fetchall()
    assert Counter(got) == slow_warc(rows)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">{nav}</a></li></ul></nav><!-- ad --><div class="ad">Buy {nav}</div><div id="cookie-notice">We use cookies</div>
<div class="wrap"><div class="content"><h1>Title {n}</h1><p>First &amp; second &lt;{n}&gt;<br>line&nbsp;two<p>Open paragraph {n}
<form><input name=q><p>Search</p></form><blockquote>Said <b>{n}</b></blockquote><p class="legal">Always the same words</p></div>
<aside>Side {n}</aside><section class="comments"><p>I agree {n}</p></section></div><footer>&copy; {nav}</footer></body></html>"""


def story(i):
    return " ".join([f"number {i} of the long story"] * 3)


def text_of(n):
    return f"Title {n}\n\nFirst & second <{n}> line two\n\nOpen paragraph {n}\n\nSaid {n}"


def test_wrapper_finds_content_and_template(spark):
    rows = [(i, f"http://host{i % 2}.example.org/{i}", PAGE.format(n=story(i), nav=f"menu {i}")) for i in range(12)]
    rows += [(None, None, None), (20, "http://host0.example.org/none", ""), (21, "http://other.example.org/", "just text &eacute; < 3"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r for r in html_extract.op8_html_text(df).collect()}
    for i in range(12):
        assert got[i]["text"] == text_of(story(i))
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert got[None]["text"] == "" and got[20]["text"] == "" and got[21]["text"] == "just text é < 3"
    assert html_extract.op8_html_text(df).count() == len(rows)


def test_pages_of_the_shared_shape(spark, pages, page_rows, no_pages):
    got = Counter((r["page_id"], r["n_chars"]) for r in html_extract.op8_html_text(pages).collect())
    assert got[(1, len("word " * 400) - 1)] == 1 and sum(got.values()) == len(page_rows)
    assert html_extract.op8_html_text(no_pages).count() == 0


def test_article_text_is_never_template():
    same = "<html><body><nav>N</nav><article><h1>H</h1><p>Same on all pages.</p><p>{}</p></article></body></html>"
    wrapper = json.loads(html_extract.induce([same.format(i) for i in range(5)]))
    wrapper["set"] = frozenset(map(tuple, wrapper["template"]))
    assert html_extract.extract(same.format("x"), wrapper) == "H\n\nSame on all pages.\n\nx"


def test_tree_matching_sizes():
    a = html_extract.tree("<body><div><p>a</p><p>b</p></div><ul><li>x</li></ul></body>")
    b = html_extract.tree("<body><div><p>a</p></div><ul><li>y</li><li>z</li></ul></body>")
    pairs = []
    assert html_extract.match(a, b) == html_extract.match(a, b, pairs) == len(pairs) == 6
    assert re.sub(r"[^>]", "", pairs[-1][0].path)


def read_all(layout_pages):
    wrapper = json.loads(html_extract.induce(layout_pages))
    wrapper["set"] = frozenset(map(tuple, wrapper["template"]))
    return wrapper, [html_extract.extract(p, wrapper) for p in layout_pages]


def test_short_blocks_beside_long_paragraphs_stay():
    page = "<html><body><div class='content'><h1>T{0}</h1><p>{1}</p><ul><li>one {0}</li></ul><blockquote>q{0}</blockquote><table><tr><td>c{0}</td></tr></table><p>{1}</p></div><div>Terms of use</div></body></html>"
    wrapper, texts = read_all([page.format(i, story(i) * 20) for i in range(6)])
    assert wrapper["root"] == ">html>body>div.content"
    assert texts[2].split("\n\n") == ["T2", story(2) * 20, "one 2", "q2", "c2", story(2) * 20]


def test_article_elements_are_only_a_hint():
    page = "<html><body><div class='story'><h1>T{0}</h1><p>{1}</p></div><article class='teaser'><p>Buy our book</p></article><article class='comment'><p>I agree {0}</p></article><article class='post comments-open'><p>Note {0}</p><p>Same note</p></article></body></html>"
    _, texts = read_all([page.format(i, story(i)) for i in range(6)])
    assert texts[4].split("\n\n") == ["T4", story(4), "Note 4", "Same note"]


def test_every_layout_of_a_host_has_its_wrapper(spark):
    a = "<html><body><div class='a'><h1>T{0}</h1><p>{1}</p><p>Read more of this</p></div><div class='low'>Terms of use</div></body></html>"
    b = "<html><body><div class='left'>Our motto</div><div class='b'><p>{1}</p><p>{2}</p></div></body></html>"
    rows = [(i, f"http://one.example.org/{i}", (b if i % 3 else a).format(i, story(i), "Seen on a few" if i < 20 else f"End {i}")) for i in range(60)]
    rows += [(i, *rows[3][1:]) for i in range(100, 200)]  # copies of one page count once
    got = {r["page_id"]: r["text"] for r in html_extract.op8_html_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    for i in range(60):
        assert got[i].split("\n\n") == ([story(i), "Seen on a few" if i < 20 else f"End {i}"] if i % 3 else [f"T{i}", story(i)])
    assert got[150] == got[3]


def test_heaviest_order_keeping_match():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randrange(1, 8)
        common = list(zip(rng.sample(range(20), n), rng.choices(range(1, 6), k=n)))
        kept = html_extract._heaviest(common)
        runs = [[i for i in range(n) if m >> i & 1] for m in range(1 << n)]
        best = max(sum(common[i][1] for i in r) for r in runs if all(common[x][0] < common[y][0] for x, y in zip(r, r[1:])))
        assert sum(common[i][1] for i in kept) == best
        assert all(common[x][0] < common[y][0] for x, y in zip(kept, kept[1:]))


def test_a_packed_tree_aligns_like_its_page():
    pages = [PAGE.format(n=story(i), nav="m") for i in (1, 2)]
    x, y = map(html_extract.tree, pages)
    plain = [html_extract.key(n.path, t) for n, t in html_extract.shared(x, y)]
    assert plain and plain == [k for _, k in html_extract.shared(*(html_extract.unpack(html_extract.pack(t)) for t in (x, y)))]


ENDS = ["\r", "\n", "\r\n", "\n\r", "\r\n\r", "\n\r\n", "\r\n\r\n", "\r\n\r\n\r", "\r\n\r\n\r\n", "\r\n\r\n\r\n\r\n"]


@pytest.mark.parametrize("size", [1, 3, 100])
def test_payloads_may_end_in_line_ends(spark, size):
    rows = [(i, f"http://a.example.org/{i}", body + end) for i, (body, end) in enumerate((b, e) for b in ("", "<p>x</p>", "\r\n<p>é\r\n\r\n" * 200) for e in ENDS)]
    path = shared_path(spark, "test-line-ends")
    warc.write_archives(spark.createDataFrame(rows + rows[-4:], "page_id long, url string, html string").coalesce(1), path, records_per_archive=size)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, path).collect())
    assert got == slow_warc(rows + rows[-4:])


def test_a_cut_archive_is_an_error():
    block = b"Content-Length: 5\r\n\r\nabc\r\n"
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: d\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d"
    whole = head % (hashlib.sha1(b"abc\r\n").hexdigest().encode(), len(block)) + b"\r\n\r\n" + block + b"\r\n\r\n"
    for cut in range(1, len(whole) + 1):
        reader = warc.Captures("x")
        pieces = whole[:cut].split(b"\r\n\r\n")
        try:
            for piece in pieces:
                reader.add(piece)
            ok = len(reader.run()) == 1
        except ValueError:
            ok = False
        assert ok == (cut in (len(whole), len(whole) - 4)), cut


def test_classes_of_state_do_not_delete_what_they_wrap(spark):
    from parcelry.llm.html_extract import op8_html_text

    names = ["has-sidebar", "no-sidebar", "with-sidebar", "comments-open"]
    page = "<html><body><div class='menu'>Menu line</div><div class='{0}'><h1>Title {1}</h1><p>{2}</p></div><div class='sidebar'>Side {1}</div></body></html>"
    rows = [(10 * k + i, f"http://{n}.example.org/{i}", page.format(n, i, story(i))) for k, n in enumerate(names) for i in range(4)]
    got = {r.page_id: r.text for r in op8_html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {10 * k + i: f"Title {i}\n\n{story(i)}" for k in range(len(names)) for i in range(4)}
