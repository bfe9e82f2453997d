"""Tables laid out for later joins: bucketed files without a catalog entry.

A bucketed table is Spark's way to keep a join side where it lies: its scan
reports hash partitioning on the bucket columns, so a join or cogroup on them
has no exchange on that side.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_bucketed(df: DataFrame, path: str, buckets: int, keys: Sequence[str], sort: Sequence[str] = ()) -> DataFrame:
    """``df`` written to ``path`` in ``buckets`` buckets by ``keys``; returns the bucketed scan.

    The table is registered under a random name for the write and dropped
    again at once: it is external, so its files stay, and the returned frame
    holds the resolved relation with its bucket specification.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, *keys)
    if sort:
        writer = writer.sortBy(*sort)
    writer.saveAsTable(name)
    found = spark.table(name)
    found.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return found


def read_bucketed(spark: SparkSession, path: str, schema: str, buckets: int, keys: Sequence[str], sort: Sequence[str] = ()) -> DataFrame:
    """The scan of a folder that ``write_bucketed`` wrote, in any session."""
    name = f"bucketed_{uuid.uuid4().hex}"
    order = f" SORTED BY ({', '.join(f'`{c}`' for c in sort)})" if sort else ""
    by = ", ".join(f"`{c}`" for c in keys)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}){order} INTO {buckets} BUCKETS LOCATION '{path}'")
    found = spark.table(name)
    found.schema
    spark.sql(f"DROP TABLE {name}")
    return found
