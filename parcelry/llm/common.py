"""Helpers shared by the text operators.

Every operator first selects the columns it needs, so extra columns (also
ones whose names an operator uses inside) cannot clash.  Intermediate tables
are Parquet files in the folder named by ``spark.checkpoint.dir``; nothing is
kept in machine-local folders and no ``localCheckpoint`` is used.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from parcelry.plans.guards import estimated_bytes
from parcelry.session import checkpoint_dir

# Null ids sort after every real id.
NULL_ID = (1 << 63) - 1


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with a written table: a lost executor re-reads files
    instead of redoing the stages above.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only; a null text becomes the empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` does not have (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``, equals ``remainder``; a null id counts as text ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(modulus)) == remainder


def smallest_per_key(df: DataFrame, key: str, id_col: str, n: int) -> DataFrame:
    """At most ``n`` rows of each key: the ones with the smallest hash of their id.

    Keys are counted first (combined before the shuffle), and only rows whose
    hash lies among about the first ``4 n + 100`` of their key are ranked, so
    ranking a key never gathers more than that in one task, however many
    rows or tasks there are.  Adds the rank as ``place``.
    """
    known, counts = fresh(df, "_key", "_rows")
    total = df.groupBy(F.col(key).alias(known)).agg(F.count("*").alias(counts))
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    share = F.shiftrightunsigned(F.xxhash64(text), 11) / float(1 << 53)
    few = df.join(total, F.col(key) == F.col(known)).filter(share * F.col(counts) < 4 * n + 100)
    order = Window.partitionBy(key).orderBy(share, id_col)
    return few.select(*df.columns, F.row_number().over(order).alias("place")).filter(F.col("place") <= n)


def input_bytes(docs: DataFrame, column: str) -> int:
    """About how many bytes ``column`` holds: Catalyst's estimate, or a sum over the rows where it has none."""
    df = docs.select(column)
    size = estimated_bytes(df)
    if size is not None and size < 1 << 55:  # a plan of unknown size counts as far larger
        return size
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give freed memory back at the end of a task: Python workers live on
    between tasks and stages, next to an executor's heap.  The C library keeps
    what was freed unless it is asked to trim (glibc; others have no such call)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, text_col: str, max_rows: int = 512, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of at most ``max_rows`` rows and about
    ``max_bytes`` of text, so Python objects for one run stay small however
    long single texts are."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i in range(n):
        if i > start and (i - start >= max_rows or total + sizes[i] > max_bytes):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(sizes[i])
    yield batch.slice(start, n - start)
