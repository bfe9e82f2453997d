"""JSON-array files, split like any other (S2): one raw message per element.

A file ``[{...}, {...}, ...]`` of any size is read in byte ranges.  Spark's
text source cuts at commas, so a range starts behind a comma: either outside
a string or inside one.

1. Every range is scanned from both states, giving the state at its end and
   the change of bracket depth: the range as a function of its start.
2. Composing these functions along a file gives every range its true state
   and depth (one row a range, as in Spark's own list of file splits).
3. Every range is scanned once more from there and cut at commas of depth one.
   What lies before its first cut and behind its last belongs to elements
   that go on in other ranges; elements are numbered by the cuts before them
   and the open pieces are glued by number.
4. Elements are parsed side by side.  The first syntax error of a file ends
   it: what was read before has been sent.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from parcelry.plans.guards import written

OUTSIDE, INSIDE = 0, 1
_SPACE = b" \t\r\n"
_TOKEN = re.compile(rb'"(?:[^"\\]+|\\.)*+(?:("|\\?\Z))|[\[\]{},]', re.DOTALL)
_REST = re.compile(rb'(?:[^"\\]+|\\.)*+("|\\?\Z)', re.DOTALL)


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, piece): the text between commas, in file order within a range."""
    raw = spark.read.option("lineSep", ",").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """Runs of pieces of one range, with the commas behind them."""
    for batch in batches:
        files, starts, pieces = (batch.column(c).to_pylist() for c in ("file", "start", "piece"))
        lo = 0
        for hi in range(1, len(files) + 1):
            if hi == len(files) or files[hi] != files[lo] or starts[hi] != starts[lo]:
                yield files[lo], starts[lo], b",".join(pieces[lo:hi]) + b","
                lo = hi


def tokens(data: bytes, state: int) -> Iterator[tuple[int, int]]:
    """(byte, position) of the brackets and commas outside strings; at the end (state, -1)."""
    at = 0
    if state == INSIDE:
        m = _REST.match(data)
        if m.group(1) != b'"':
            yield INSIDE, -1
            return
        at = m.end()
    for m in _TOKEN.finditer(data, at):
        end = m.group(1)
        if end is None:
            yield data[m.start()], m.start()
        elif end != b'"':
            yield INSIDE, -1
            return
    yield OUTSIDE, -1


_STEP = {ord("["): 1, ord("{"): 1, ord("]"): -1, ord("}"): -1, ord(","): 0}


def _effect(data: bytes, state: int) -> tuple[int, int]:
    """(state at the end, change of depth)."""
    depth = 0
    for byte, pos in tokens(data, state):
        if pos < 0:
            return byte, depth
        depth += _STEP[byte]
    raise AssertionError("tokens end with a state")


_EFFECTS = "file string, start long, first binary, state0 int, depth0 long, state1 int, depth1 long"


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per range: what it does from either state, and its first byte that is no space."""
    found: dict[tuple[str, int], list] = {}
    for file, start, data in _chunks(batches):
        row = found.setdefault((file, start), [None, OUTSIDE, 0, INSIDE, 0])
        row[0] = row[0] or data.lstrip(_SPACE)[:1] or None
        for i in (1, 3):
            row[i], change = _effect(data, row[i])
            row[i + 1] += change
    rows = [(f, s, *r) for (f, s), r in found.items()]
    if rows:
        names = [c.split()[0] for c in _EFFECTS.split(", ")]
        types = [pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def compose(rows: list) -> dict[tuple[str, int], tuple[int, int, bool]]:
    """(state, depth, first range) at the start of every range of the files that start with a bracket.

    ``rows`` come by file and start.  A file whose depth is back at zero has ended.
    """
    out, file = {}, None
    for r in rows:
        if r["file"] != file:
            file, state, depth, opened, ended = r["file"], OUTSIDE, 0, False, False
        if not opened and r["first"] is not None and not ended:
            opened = bytes(r["first"]) == b"["
            ended = not opened
            if opened:
                out[file, r["start"]] = (state, depth, True)
        elif opened and not ended:
            out[file, r["start"]] = (state, depth, False)
        state, depth = (r["state0"], depth + r["depth0"]) if state == OUTSIDE else (r["state1"], depth + r["depth1"])
        ended = ended or (opened and depth <= 0)
    return out


_PIECES = "file string, start long, n long, open boolean, data binary"


def _cut(starts):
    """Pieces between the cuts of each range: ``n`` cuts lie before a piece in its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, depth, n, rest, over = None, OUTSIDE, 0, 0, [], True

        def tail() -> list[tuple]:
            return [(*at, n, True, b"".join(rest))] if at and not over else []

        for file, start, data in _chunks(batches):
            rows = []
            if (file, start) != at:
                rows += tail()
                at, n, rest = (file, start), 0, []
                over = at not in starts.value
                if not over:
                    state, depth, first = starts.value[at]
                    if first:  # cut behind the opening bracket
                        data = data.lstrip(_SPACE)[1:]
                        depth = 1
            if not over:
                cut = 0
                for byte, pos in tokens(data, state):
                    if pos < 0:
                        state = byte
                        break
                    depth += _STEP[byte]
                    if depth == 0 or (depth == 1 and byte == 44):
                        rows.append((*at, n, n == 0, b"".join([*rest, data[cut:pos]])))
                        rest, cut, n = [], pos + 1, n + 1
                        if depth == 0:
                            over = True
                            break
                if not over:
                    rest.append(data[cut:])
            if rows:
                yield _batch(rows, _PIECES)
        if tail():
            yield _batch(tail(), _PIECES)

    return run


_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows), fields)], [name for name, _ in fields])


def _no_constant(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_no_constant)


def element(data: bytes) -> tuple[bytes | None, bool]:
    """(the element as written, or None; whether the file goes on behind it)."""
    text = data.decode("utf-8", "replace").strip(" \t\r\n")
    try:
        end = _DECODER.raw_decode(text)[1]
    except (ValueError, RecursionError):
        return None, False
    return text[:end].encode(), end == len(text)


_ELEMENTS = "file string, pos long, elem binary, more boolean"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [element(d) for d in batch.column("data").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("pos"), pa.array([e for e, _ in found], pa.binary()),
                                          pa.array([m for _, m in found], pa.bool_())], ["file", "pos", "elem", "more"])


def json_array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, elem): the elements of every array file below ``path``, as written.

    NaN and Infinity are errors, as any text that is no JSON; elements before
    a file's first error are kept, and a file that is no array gives none.
    """
    ranges = _ranges(spark, path)
    effects = ranges.mapInArrow(_effects, _EFFECTS).orderBy("file", "start").collect()  # one row a byte range
    starts = spark.sparkContext.broadcast(compose(effects))
    pieces = written(ranges.mapInArrow(_cut(starts), _PIECES), "array-pieces")
    cuts = pieces.groupBy("file", "start").agg(F.max("n").alias("last"))
    # a range's last piece has as many cuts before it as the range has
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    base = cuts.select(F.col("file").alias("_f"), F.col("start").alias("_s"), F.coalesce(F.sum("last").over(order), F.lit(0)).alias("base"))
    numbered = pieces.join(base, (F.col("file") == F.col("_f")) & (F.col("start") == F.col("_s"))).withColumn("pos", F.col("base") + F.col("n"))
    glued = numbered.filter("open").groupBy("file", "pos").agg(F.sort_array(F.collect_list(F.struct("start", "data"))).alias("parts")).select(
        "file", "pos", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["data"])).alias("data"))
    whole = numbered.filter("not open").select("file", "pos", "data")
    parsed = written(whole.unionByName(glued).mapInArrow(_parse, _ELEMENTS), "array-elements")
    stop = parsed.filter("not more").groupBy(F.col("file").alias("_f")).agg(F.min("pos").alias("stop"))
    kept = parsed.join(stop, F.col("file") == F.col("_f"), "left").filter(
        "elem is not null and (stop is null or pos <= stop)")
    return kept.select("file", "pos", "elem")
