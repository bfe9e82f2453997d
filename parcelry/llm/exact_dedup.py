"""Operator 5: exact duplicates through an extendible-hash index on shared files.

DataFrame functions only.  Texts are equal when identical after each run of
white space (space, 0x09-0x0D) becomes one space; null counts as empty.

Method.  Rows are grouped by the 64-bit hash *and* the bytes of the
normalised text, so two texts with one hash are told apart by comparing
bytes; the group count is combined before the shuffle, so a text held by a
third of all rows reaches its owner as one row per task.  This grouping
alone decides the rows; the index stores what it found, and its buckets,
depths and chains decide none.  Each distinct text is one index entry.  The directory starts with one slot and doubles: a
bucket of depth d (the entries whose hashes share d leading bits) that holds
more than ``bucket_rows`` entries splits in two, up to ``max_depth`` bits;
overfull buckets at that depth overflow into longer chains.  Buckets are
owned by ranges of keys: owner tasks write them in key order as Parquet
files in the shared folder, each entry with its place in the chain of
entries of one hash.

Defined cases: of rows that repeat both id and text exactly one is kept; a
null ``doc_id`` sorts last (a group of null ids keeps one of them); an empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelry.llm.common import fresh, store

BUCKET_ROWS = 1_000_000
# 2^16 directory slots at most: the directory is under 2 MB.
MAX_DEPTH = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _key(norm: Column) -> tuple[Column, Column]:
    return F.xxhash64(norm).alias("h"), F.sha2(norm.cast("binary"), 256).alias("sha")


def directory(entries: DataFrame, bucket_rows: int = BUCKET_ROWS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(slot, depth, bucket): the directory after all doublings.

    ``slot`` is the hash's leading ``max_depth`` bits and ``bucket`` the first
    slot that the bucket covers.  At most 2^max_depth rows.
    """
    slot = F.shiftrightunsigned("h", 64 - max_depth).alias("slot")
    fill = entries.groupBy(slot).agg(F.count("*").alias("n"))
    levels = fill.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(slot, {max_depth} - depth)"))
    nodes = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("held"))
    fits = (F.col("held") <= bucket_rows) | (F.col("depth") == max_depth)
    leaf = levels.join(nodes, ["depth", "prefix"]).filter(fits).groupBy("slot").agg(F.min("depth").alias("depth"))
    return leaf.withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {max_depth} - depth), {max_depth} - depth)"))


def build_index(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The written index: one entry per distinct normalised text.

    Columns ``bucket, depth, h, chain, sha, keep_id, group_size``.
    """
    norm = normalised(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm")).select("doc_id", "norm", F.xxhash64("norm").alias("h"))
    groups = rows.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = store(groups.select("h", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "keep_id", "group_size"), "index-entries")
    total = entries.count()
    depth = max(1, min(max_depth, math.ceil(math.log2(max(1, total) / bucket_rows + 1)) + 3))
    slots = directory(entries, bucket_rows, depth)
    slot = F.shiftrightunsigned("h", 64 - depth)
    # at most 2^MAX_DEPTH directory rows of 16 bytes: the side's size is bounded
    placed = entries.withColumn("slot", slot).join(F.broadcast(slots), "slot")
    owned = placed.repartitionByRange("bucket", "h")
    chain = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("sha"))
    index = owned.withColumn("chain", chain).select("bucket", "depth", "h", "chain", "sha", "keep_id", "group_size")
    return store(index, "index")


def exact_duplicates(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    index = build_index(docs, bucket_rows, max_depth)
    h, sha = _key(F.col("norm"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm")).select("doc_id", h, sha)
    # rows that repeat an id and a text are counted together, so that one of them is the kept one
    same = rows.groupBy("h", "sha", "doc_id").agg(F.count("*").alias("copies"))
    found = same.join(index.select("h", "sha", "keep_id", "group_size"), ["h", "sha"])
    one = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return found.select("doc_id", "keep_id", "group_size", "sha", one).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Rows of ``docs`` that stay, one per distinct normalised text; columns unchanged."""
    found = exact_duplicates(docs, bucket_rows, max_depth).filter((F.col("group_size") > 1) | F.col("kept"))
    key_id, key_sha, rows, place = fresh(docs, "_id", "_sha", "_rows", "_place")
    per_id = found.groupBy(F.col("doc_id").alias(key_id), F.col("text_sha256").alias(key_sha)).agg(F.max("kept").alias("kept"), F.count("*").alias(rows))
    keepers = store(per_id.filter("kept").select(key_id, key_sha, rows), "keepers")
    sha = F.sha2(normalised(docs["text"]).cast("binary"), 256)
    stay = docs.join(keepers, docs["doc_id"].eqNullSafe(keepers[key_id]) & (sha == keepers[key_sha]))
    if not keepers.filter(F.col(rows) > 1).limit(1).count():
        return stay.select(docs.columns)
    # rows with one id and one text: the first in the order of their columns stays
    first = F.row_number().over(Window.partitionBy(key_id, key_sha).orderBy(*[F.col(c).cast("string") for c in docs.columns]))
    many = stay.filter(F.col(rows) > 1).withColumn(place, first).filter(F.col(place) == 1).select(docs.columns)
    return stay.filter(F.col(rows) == 1).select(docs.columns).unionByName(many)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
