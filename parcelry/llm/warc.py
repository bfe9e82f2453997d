"""Operator 7: WARC archives of pages and their merged capture index.

Writing.  One record per page.  Of pages with equal payloads of at least
``MIN_REVISIT_BYTES`` bytes the one with the largest id is a response and the
others are revisits of it; smaller payloads are always responses.  Records
are built as text and written by Spark's text writer with the record
separator CR LF CR LF, gzip-compressed, in the shared folder.

Reading.  Archives are read back by the text reader with the same separator,
which only cuts them into pieces of bounded size: pieces and the separators
between them are read as one stream of bytes, in which ``Content-Length``
alone says where a block ends.  A block that is not followed by the record
separator, or a payload whose digest differs from its header's, is an error.

Index.  Method: external merge.  The captures of each archive are sorted by
(URL key, timestamp, id) and stored as runs.  Ranges of that key go to
tasks, and each task merges the runs that reach it with a loser tree, which
yields capture histories in global order.  The id is part of the range key,
so a URL held by a third of all rows is spread over tasks.

Defined cases: a null html is the empty payload; a null url has the empty
URL key; a null id is smaller than all others; rows that repeat the largest
id with one payload are all responses; an empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelry.llm.common import shared_path, store
from parcelry.plans.guards import bounded_broadcast

MIN_REVISIT_BYTES = 1_000
RECORDS_PER_ARCHIVE = 20_000
SEPARATOR = "\r\n\r\n"
_END, _MAGIC = SEPARATOR.encode(), b"WARC/"
# Captures have no time of their own: seconds after this instant by page_id.
FIRST_CAPTURE = 1_704_067_200
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """Header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))


def records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """One WARC record (``value``) per page, without the separator that ends it."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", r"[\x00-\x20]", "").alias("url"), payload.alias("payload"))
    size, sha = F.octet_length("payload").cast("long"), F.sha1(F.col("payload").cast("binary"))
    keyed = rows.select("page_id", size.alias("bytes"), sha.alias("sha"), F.xxhash64("payload").alias("h")).filter(F.col("bytes") >= min_revisit_bytes)
    groups = keyed.groupBy("sha", "h", "bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    shared = bounded_broadcast(store(groups.select("sha", "h", "bytes", "refers_to"), "shared-payloads"))
    full = rows.withColumns({"bytes": size, "sha": sha, "h": F.xxhash64("payload")}).join(shared, ["sha", "h", "bytes"], "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    seconds = F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 30))
    http = F.concat(F.lit(_HTTP + "\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(SEPARATOR))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        _line("WARC-Date", F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha")),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))),
        _line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        F.lit("\r\nContent-Type: application/http; msgtype=response"),
        _line("Content-Length", F.octet_length(block).cast("string")),
    )
    return full.select(F.concat(head, F.lit(SEPARATOR), block).alias("value"))


def write_archives(pages: DataFrame, path: str, records_per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    out = records(pages).write.option("lineSep", SEPARATOR).option("compression", "gzip")
    out.option("maxRecordsPerFile", records_per_archive).text(path)


def url_key(url: str) -> str:
    """Sort-friendly key: host labels reversed, then the rest, without scheme, port 80/443 and fragment."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^#]*)", url.lower())
    if not m:
        return url.lower()
    host = m.group(1).rpartition("@")[2]
    name, _, port = host.partition(":")
    labels = ",".join(reversed(name.split(".")))
    return labels + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (m.group(2) or "/")


class Captures:
    """Reads the pieces of one archive, in order, as a stream of records."""

    def __init__(self, archive: str):
        self.archive, self.head, self.parts, self.got, self.want = archive, None, [], 0, 0
        self.raw = bytearray()  # of a header that is not complete
        self.ended: int | None = None  # bytes seen of the separator behind a block
        self.begun = False
        self.found: list[tuple] = []

    def add(self, piece: bytes) -> None:
        if self.begun:
            self._feed(_END)
        self.begun = True
        self._feed(piece)

    def _feed(self, data: bytes) -> None:
        at = 0
        while at < len(data):
            if self.ended is not None:
                part = data[at : at + len(_END) - self.ended]
                if part != _END[self.ended : self.ended + len(part)]:
                    raise ValueError(f"{self.archive}: a block longer than its Content-Length")
                at, self.ended = at + len(part), self.ended + len(part)
                if self.ended == len(_END):
                    self.ended = None
            elif self.head is None:
                known = len(self.raw)
                self.raw += data[at:]
                if not self.raw.startswith(_MAGIC[: len(self.raw)]):
                    raise ValueError(f"{self.archive}: a record without a WARC header")
                end = self.raw.find(_END, max(0, known - len(_END) + 1))
                if end < 0:
                    return
                at += end + len(_END) - known
                lines = (x.partition(": ") for x in self.raw[:end].decode().split("\r\n")[1:])
                self.head = {k.lower(): v for k, _, v in lines}
                self.want, self.got, self.parts, self.raw = int(self.head["content-length"]), 0, [], bytearray()
            else:
                part = data[at : at + self.want - self.got]
                self.parts.append(part)
                at, self.got = at + len(part), self.got + len(part)
                if self.got == self.want:
                    self.ended = 0
                    self._close(b"".join(self.parts))

    def _close(self, block: bytes) -> None:
        head, self.head = self.head, None
        http, _, payload = block.partition(_END)
        length = re.search(rb"Content-Length: (\d+)", http)
        if length is None:
            raise ValueError(f"{self.archive}: a block without the length of its payload")
        size = int(length.group(1))
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        kind = head["warc-type"]
        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"{self.archive}: payload and digest differ")
        page = re.fullmatch(r"<urn:page:(-?\d+|none)>", head["warc-record-id"]).group(1)
        refers = head.get("warc-refers-to")
        url = head.get("warc-target-uri", "")
        self.found.append((url_key(url), head["warc-date"], None if page == "none" else int(page), kind, size, digest, int(refers[10:-1]) if refers else None, url, self.archive))

    def run(self) -> list[tuple]:
        # the separator behind the last piece is not seen
        if self.head is not None or self.raw or self.ended:
            raise ValueError(f"{self.archive}: the last record is cut off")
        return sorted(self.found, key=_order)


def _order(row: tuple) -> tuple:
    return row[0], row[1], -(1 << 63) if row[2] is None else row[2]


FIELDS = (("url_key", "string"), ("timestamp", "string"), ("page_id", "long"), ("record_type", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("refers_to", "long"), ("url", "string"), ("archive", "string"))
_SCHEMA = ", ".join(f"{n} {t}" for n, t in FIELDS)
_ARROW = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in FIELDS])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives under ``path``; those of one archive follow each other as a sorted run."""
    pieces = spark.read.option("lineSep", SEPARATOR).text(path).select("value", F.col("_metadata.file_path").alias("archive"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Captures | None = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for value, archive in zip(part.column("value").cast(pa.binary()).to_pylist(), part.column("archive").to_pylist()):
                    if now is None or now.archive != archive:
                        if now is not None and (rows := now.run()):
                            yield _batch(rows)
                        now = Captures(archive)
                    now.add(value)
        if now is not None and (rows := now.run()):
            yield _batch(rows)

    return pieces.mapInArrow(run, _SCHEMA)


class LoserTree:
    """k-way merge: inner nodes hold the loser of their match, the root the overall winner."""

    def __init__(self, runs: list[list[tuple]]):
        self.k = max(1, len(runs))
        self.runs = [iter(r) for r in runs]
        self.heads = [self._next(i) for i in range(len(runs))] or [None]
        self.losers = [0] * self.k
        winners = [0] * (2 * self.k)
        winners[self.k :] = range(self.k)
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if self._less(b, a):
                a, b = b, a
            winners[node], self.losers[node] = a, b
        self.winner = winners[1]

    def _next(self, i: int) -> tuple | None:
        row = next(self.runs[i], None)
        return None if row is None else (_order(row), row)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[0] < y[0] or (x[0] == y[0] and a < b))

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[self.winner] is not None:
            at = self.winner
            yield self.heads[at][1]
            self.heads[at] = self._next(at)
            node = (at + self.k) >> 1
            while node:
                if self._less(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node >>= 1
            self.winner = at


def merge_index(captures: DataFrame) -> DataFrame:
    """Capture histories in the order of (URL key, timestamp, id), globally."""
    runs = store(captures, "capture-runs")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per: dict[str, list[list[tuple]]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                own = per.setdefault(row[8], [[]])
                # a run may arrive in several sorted stretches
                if own[-1] and _order(row) < _order(own[-1][-1]):
                    own.append([])
                own[-1].append(row)
        out = []
        for row in LoserTree([r for name in sorted(per) for r in per[name]]):
            out.append(row)
            if len(out) == 4096:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return runs.repartitionByRange("url_key", "timestamp", "page_id").mapInArrow(merge, _SCHEMA)


def op7_warc(pages: DataFrame) -> DataFrame:
    """The contract's rows, in the order of the merged index (and the index's own columns)."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    index = merge_index(read_archives(pages.sparkSession, path))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), k AS (
  SELECT page_id, payload, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes FROM p
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS top FROM k
)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM r
"""
