"""Operator 8: main text of pages by wrapper induction.

Method.  Pages of one host come from a few templates.  Every page is parsed to
a tree in which siblings of one step (tag, id, classes) are one node.  The
pages of a host that share a layout (the node with most text, and the layout
nodes beside and above it) form a cluster; one of them is its seed, and every
other page is aligned with the seed by simple tree matching.  A text that
stands at one aligned node on ``TEMPLATE_SHARE`` of the distinct pages of its
cluster is template; all other texts fill slots.  The content node is the
lowest common ancestor of all slots, so every slot lies in it and it cuts
nothing.  The text of a page is what fills its slots, without menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments.

Article and main elements are a hint only: a template text is kept if the
nearest of them around it also holds a slot on that page, so a passage that
articles of a host share stays, and an article that is the same everywhere
goes.  A page with no slot at all is read whole.  Clusters of fewer than
``MIN_PAGES`` distinct pages have no template.

No page is left out.  Trees travel as hashes of their texts (64 bits, no byte
check) and are counted once per distinct page; the counts are combined before
they are shuffled.  Seeds and templates go to the pages by a broadcast only if
their number is checked to be small, else by a shuffle join that Spark may
split.

Defined cases: a null or empty html has the empty text; a null url is a host
of its own; null ids and repeated rows are rows like any other.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelry.llm.common import release, slices, store
from parcelry.plans.guards import bounded_broadcast

MIN_PAGES = 3
TEMPLATE_SHARE = 0.9
MAX_BROADCAST_WRAPPERS = 100_000

_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td template tfoot th thead title tr ul".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("head nav header footer aside form script style noscript template iframe textarea title svg math canvas button select option datalist dialog menu object audio video map noembed noframes search".split())
_MAIN = frozenset(("article", "main"))
_LAYOUT = frozenset("html body div section article main center".split())
_DROPPED_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login comment comments commentlist disqus respond replies share sharing social related recommended pagination pager skip toolbar".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
# Parts of class names that speak of a state of what they wrap, not of its kind (comments-open, has-sidebar).
_STATES = frozenset("open closed on off enabled disabled no has with without is".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set())}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.DOTALL)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+|[0-9]+")


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(raw)} if raw and "=" in raw or "hidden" in raw.lower() else {}


def _dropped(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element and all in it is no article text."""
    if tag in _DROPPED:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    if attrs.get("role") in _DROPPED_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    names = (attrs.get("class", "") + " " + attrs.get("id", "")).split()
    words = [w for x in map(_WORD.findall, names) if _STATES.isdisjoint(x) for w in x]
    return not _DROPPED_WORDS.isdisjoint(words)


def _name(tag: str, attrs: dict[str, str]) -> str:
    """Step of an element in a path: tag, id and classes without numbers."""
    return "".join([tag, *("#" + w for w in attrs.get("id", "").split() if w.isalpha()), *("." + w for w in attrs.get("class", "").split() if w.isalpha())])


class Element:
    __slots__ = ("tag", "step", "path", "dropped", "main")

    def __init__(self, tag: str, step: str, path: str, dropped: bool, main: bool):
        # main: is itself an article or main element
        self.tag, self.step, self.path, self.dropped, self.main = tag, step, path, dropped, main


def blocks(page: str) -> Iterator[tuple[Element, tuple[Element, ...], str]]:
    """(element, its ancestors and itself, text) of every text block in page order.

    Inline elements are transparent unless their class or role drops them.
    """
    stack = [Element("", "", "", False, False)]
    text: list[str] = []
    at, size = 0, len(page)

    def flush():
        joined = " ".join(_html.unescape("".join(text)).split())
        text.clear()
        return [(stack[-1], tuple(stack), joined)] if joined else []

    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in _BLOCKS
        if m.group(1):
            if tag in ("html", "body") or tag in _VOID:
                continue
            depth = len(stack) - 1
            while depth and stack[depth].tag != tag:
                if not block and stack[depth].tag in _BLOCKS:
                    depth = 0
                    break
                depth -= 1
            if depth:
                yield from flush()
                del stack[depth:]
            elif block:
                yield from flush()
            continue
        if tag == "br" or tag == "img":
            text.append(" ")
            continue
        attrs = _attributes(m.group(3))
        gone = _dropped(tag, attrs)
        if not block and not gone:
            continue
        if tag == "hr":
            yield from flush()
            continue
        if tag in _VOID:
            continue
        yield from flush()
        if block:
            if stack[-1].tag == "p":
                stack.pop()
            closes = _CLOSES.get(tag)
            if closes:
                depth = len(stack) - 1
                while depth and stack[depth].tag not in closes[1]:
                    if stack[depth].tag in closes[0]:
                        del stack[depth:]
                    depth -= 1
        top = stack[-1]
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
            if end is None:
                at = size
            else:
                close = page.find(">", end.start())
                at = size if close < 0 else close + 1
            continue
        if m.group(3).endswith("/") and not block:
            continue
        step = _name(tag, attrs)
        stack.append(Element(tag, step, f"{top.path}>{step}", top.dropped or gone, tag in _MAIN or attrs.get("role") == "main"))
    yield from flush()


class Node:
    """Tree node for alignment: step name, own block texts (or their keys), children by step."""

    __slots__ = ("step", "path", "texts", "children")

    def __init__(self, step: str, path: str):
        self.step, self.path = step, path
        self.texts: list = []
        self.children: dict[str, Node] = {}


def tree(page: str) -> Node:
    """Tree of the elements that hold text not dropped by the rules; siblings of one step are one node."""
    root = Node("", "")
    for element, chain, text in blocks(page):
        if element.dropped:
            continue
        at = root
        for e in chain[1:]:
            node = at.children.get(e.step)
            if node is None:
                node = at.children[e.step] = Node(e.step, e.path)
            at = node
        at.texts.append(text)
    return root


def _nodes(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    found = [root]
    for node in found:
        found.extend(node.children.values())
    return found


def _heaviest(common: list[tuple[int, int]]) -> list[int]:
    """Indices of the heaviest run of (rank, weight) with rising ranks; ranks are distinct."""
    if all(x[0] < y[0] for x, y in zip(common, common[1:])):
        return list(range(len(common)))
    ranks: list[int] = []  # ends of runs, by rank; heavier ones only
    ends: list[tuple[int, int]] = []  # (weight of the run, index of its last)
    before = [-1] * len(common)
    for i, (rank, weight) in enumerate(common):
        at = bisect_right(ranks, rank)
        total = weight
        if at:
            total, before[i] = ends[at - 1][0] + weight, ends[at - 1][1]
        end = at
        while end < len(ranks) and ends[end][0] <= total:
            end += 1
        ranks[at:end], ends[at:end] = [rank], [(total, i)]
    out, i = [], ends[-1][1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def match(a: Node, b: Node, pairs: list[tuple[Node, Node]] | None = None) -> int:
    """Simple tree matching: size of the largest order-keeping match of two trees.

    With ``pairs`` the matched nodes are appended to it.  Steps of siblings
    are distinct, so a child has at most one partner.
    """
    if a.step != b.step:
        return 0
    order = [(a, b)]
    for x, y in order:
        order.extend((c, y.children[s]) for s, c in x.children.items() if s in y.children)
    size: dict[int, int] = {}
    chosen: dict[int, list[tuple[Node, Node]]] = {}
    for x, y in reversed(order):
        rank = {s: i for i, s in enumerate(y.children)}
        common = [(c, y.children[s]) for s, c in x.children.items() if s in rank]
        kept = _heaviest([(rank[c.step], size[id(c)]) for c, _ in common])
        chosen[id(x)] = [common[i] for i in kept]
        size[id(x)] = 1 + sum(size[id(c)] for c, _ in chosen[id(x)])
    if pairs is not None:
        found = [(a, b)]
        for x, _ in found:
            found.extend(chosen[id(x)])
        pairs.extend(found)
    return size[id(a)]


def key(path: str, text: str) -> int:
    """64-bit key of a text at a path."""
    return int.from_bytes(hashlib.blake2b(f"{path}\0{text}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def layout(root: Node) -> str:
    """Structural signature: the layout node with most text of its own, and the layout nodes that are not below it."""
    mass: dict[str, int] = defaultdict(int)
    holder = {id(root): ""}
    seen = [(root, True)]
    for node, open_ in seen:
        own = holder[id(node)]
        mass[own] += sum(map(len, node.texts))
        for c in node.children.values():
            inside = open_ and re.match("[a-z]*", c.step).group() in _LAYOUT
            holder[id(c)] = c.path if inside else own
            seen.append((c, inside))
    top = max(mass, key=lambda p: mass[p])
    rest = sorted(p for p in mass if not p.startswith(top + ">")) if top else []
    return hashlib.blake2b("\n".join([top, *rest]).encode("utf-8", "replace"), digest_size=12).hexdigest()


def pack(root: Node) -> str:
    """A tree as JSON: parent, step and text keys of every node."""
    nodes = _nodes(root)
    at = {id(n): i for i, n in enumerate(nodes)}
    parent = {id(c): at[id(n)] for n in nodes for c in n.children.values()}
    return json.dumps([[parent.get(id(n), -1), n.step, [key(n.path, t) for t in dict.fromkeys(n.texts)]] for n in nodes])


def unpack(packed: str) -> Node:
    nodes: list[Node] = []
    for up, step, keys in json.loads(packed):
        node = Node(step, "")
        node.texts = keys
        if up >= 0:
            nodes[up].children[step] = node
        nodes.append(node)
    return nodes[0]


def shared(seed: Node, other: Node) -> list:
    """Texts (or keys) that stand at aligned nodes of both trees."""
    pairs: list[tuple[Node, Node]] = []
    match(seed, other, pairs)
    found = []
    for x, y in pairs:
        have = set(y.texts)
        found += [(x, t) for t in dict.fromkeys(x.texts) if t in have]
    return found


def induce(pages: list[str]) -> str:
    """Wrapper of pages of one cluster, as JSON: content node and template texts."""
    trees = [tree(p) for p in dict.fromkeys(pages)]
    trees = [t for t in trees if t.children or t.texts]
    count: Counter = Counter()
    for other in trees:
        count.update((x.path, t) for x, t in shared(trees[0], other))
    template = {k for k, n in count.items() if len(trees) >= MIN_PAGES and n >= TEMPLATE_SHARE * len(trees)}
    # a slot's text block itself is never the content node
    paths = {n.path.rpartition(">")[0] for t in trees for n in _nodes(t) if any((n.path, x) not in template for x in n.texts)}
    steps = [p.split(">") for p in paths]
    same = 0
    while steps and all(len(s) > same for s in steps) and len({s[same] for s in steps}) == 1:
        same += 1
    return json.dumps({"root": ">".join(steps[0][:same]) if steps else None, "template": [list(k) for k in sorted(template)]})


class Keys:
    """Template texts known by their keys."""

    def __init__(self, keys):
        self.keys = frozenset(keys)

    def __contains__(self, place: tuple[str, str]) -> bool:
        return key(*place) in self.keys


def extract(page: str | None, wrapper: dict | None) -> str:
    """Main text of a page."""
    if not page:
        return ""
    template = wrapper["set"] if wrapper else frozenset()
    found = [(chain, text, (element.path, text) in template) for element, chain, text in blocks(page) if not element.dropped]
    live = {id(e) for chain, _, same in found if not same for e in chain if e.main}
    out = [text for chain, text, same in found if not same or id(next((e for e in reversed(chain) if e.main), None)) in live]
    return "\n\n".join(out or [text for _, text, _ in found])


def _trees(pages: DataFrame) -> DataFrame:
    """(host, h, layout, tree) of every distinct page that holds text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", max_bytes=4 << 20):
                rows = []
                for host, h, page in zip(*(c.to_pylist() for c in part.columns)):
                    root = tree(page)
                    if root.children or root.texts:
                        rows.append((host, h, layout(root), pack(root)))
                if rows:
                    host, h, sign, packed = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(h, pa.int64()), pa.array(sign, pa.string()), pa.array(packed, pa.string())], ["host", "h", "layout", "tree"])
        release()

    src = pages.filter(F.length("html") > 0).select("host", F.xxhash64("html").alias("h"), "html")
    parsed = src.mapInArrow(run, "host string, h long, layout string, tree string")
    # equal pages have equal rows
    return store(parsed.dropDuplicates(["host", "h"]), "page-trees")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, layout, template keys) of every cluster that has a template."""
    trees = _trees(pages)
    sizes = trees.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("h").alias("h")).filter(F.col("n") >= MIN_PAGES)
    seeds = sizes.join(trees.select("host", "h", F.col("tree").alias("seed")), ["host", "h"]).select("host", "layout", "n", "seed")
    known = bounded_broadcast(store(seeds, "seeds"), MAX_BROADCAST_WRAPPERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, Node] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = []
                for packed, seed in zip(part.column("tree").to_pylist(), part.column("seed").to_pylist()):
                    if seed not in loaded:
                        if len(loaded) > 1_000:
                            loaded.clear()
                        loaded[seed] = unpack(seed)
                    found.append([k for _, k in shared(loaded[seed], unpack(packed))])
                yield pa.RecordBatch.from_arrays([part.column("host"), part.column("layout"), part.column("n"), pa.array(found, pa.list_(pa.int64()))], ["host", "layout", "n", "keys"])
        release()

    joined = trees.join(known, ["host", "layout"]).select("host", "layout", "n", "tree", "seed")
    aligned = joined.mapInArrow(run, "host string, layout string, n long, keys array<long>").select("host", "layout", "n", F.explode("keys").alias("k"))
    counted = aligned.groupBy("host", "layout", "k").agg(F.count("*").alias("pages"), F.first("n").alias("n"))
    template = counted.filter(F.col("pages") >= TEMPLATE_SHARE * F.col("n"))
    return store(template.groupBy("host", "layout").agg(F.collect_list("k").alias("keys")), "wrappers")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every page."""
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    known = bounded_broadcast(wrappers(src), MAX_BROADCAST_WRAPPERS)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", max_bytes=4 << 20):
                signs = [layout(tree(page)) if page else None for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(signs, pa.string())], [*part.schema.names, "layout"])
        release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[tuple, dict] = {}
        for batch in batches:
            for part in slices(batch, "html", max_bytes=4 << 20):
                found = []
                for page, host, sign, keys in zip(*(part.column(c).to_pylist() for c in ("html", "host", "layout", "keys"))):
                    if keys is not None and (host, sign) not in loaded:
                        if len(loaded) > 1_000:
                            loaded.clear()
                        loaded[host, sign] = {"set": Keys(keys)}
                    found.append(extract(page, loaded[host, sign] if keys is not None else None))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"])
        release()

    signed = src.mapInArrow(sign, "page_id long, url string, html string, host string, layout string")
    joined = signed.join(known, ["host", "layout"], "left").select("page_id", "url", "html", "host", "layout", "keys")
    return joined.mapInArrow(run, "page_id long, url string, text string")


def op8_html_text(pages: DataFrame) -> DataFrame:
    """The contract's rows."""
    return main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
