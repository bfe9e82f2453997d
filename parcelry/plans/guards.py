"""Plan guards: size-checked broadcast and lineage cuts.

``bounded_broadcast`` only marks a side for broadcast after proving it has at
most ``max_rows`` rows (a bounded ``limit(n + 1).count()`` job, which reads
at most n + 1 rows per task).  Beyond the bound the side is returned as is
and Spark plans a shuffle join; AQE may still convert at runtime from
measured shuffle sizes.

``cut_lineage`` writes a reliable checkpoint into the folder named by
``spark.checkpoint.dir`` (shared storage on a cluster), never a local one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelry.session import checkpoint_dir

# Default bound for dimension-like sides: one million narrow rows.
DEFAULT_MAX_BROADCAST_ROWS = 1_000_000
_CONF_KEY = "parcelry.broadcast.maxRows"


def max_broadcast_rows(df: DataFrame) -> int:
    v = df.sparkSession.conf.get(_CONF_KEY, None)
    return int(v) if v else DEFAULT_MAX_BROADCAST_ROWS


# Sides whose optimizer size estimate exceeds this are never counted: they
# are too big to broadcast, and counting them would read the whole table.
MAX_ESTIMATED_BYTES = 256 << 20


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimized plan (file sizes scaled by
    the projected width); None when unavailable."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - e.g. Spark Connect
        return None


def row_count_at_most(df: DataFrame, n: int) -> bool:
    """True when ``df`` has at most ``n`` rows; reads at most n + 1 per task."""
    return df.limit(n + 1).count() <= n


# Proven decisions: (plan hash, input files with length and time, bound) ->
# bool.  A file rewritten in place has another length or time, so its side is
# counted again.
_DECISIONS: dict[tuple, bool] = {}


def file_stamps(df: DataFrame) -> tuple:
    """(path, length, modification time) of every input file, through Hadoop's FileSystem."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        st = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, st.getLen(), st.getModificationTime()))
    return tuple(out)


def _decision_key(df: DataFrame, bound: int) -> tuple | None:
    try:
        return (df.sparkSession.sparkContext.applicationId, df.semanticHash(), file_stamps(df), bound)
    except Exception:  # noqa: BLE001 - no key: the side is counted every time
        return None


def bounded_broadcast(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only if its row count is proven <= ``max_rows``.

    Two steps: a side whose size estimate is large is left to a shuffle join
    at once (no job); any other, also one without an estimate, is counted
    with a bounded limit before it is marked for broadcast.  The outcome is
    remembered for the same plan over the same files.
    """
    bound = max_rows if max_rows is not None else max_broadcast_rows(df)
    est = estimated_bytes(df)
    if est is not None and est > MAX_ESTIMATED_BYTES:
        return df
    key = _decision_key(df, bound)
    small = _DECISIONS.get(key) if key is not None else None
    if small is None:
        small = row_count_at_most(df, bound)
        if key is not None:
            _DECISIONS[key] = small
    return F.broadcast(df) if small else df


_FREE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside leave the disks when their query ends.

    Spark keeps them until the driver collects the plan, which a driver with
    memory to spare does late or never.  What a step has written needs them no more.
    """
    before = spark.conf.get(_FREE_KEY, None)
    spark.conf.set(_FREE_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_KEY, before) if before is not None else spark.conf.unset(_FREE_KEY)


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet under ``folder`` (``spark.checkpoint.dir`` if none is given) and read back.

    Like ``cut_lineage`` but in columns, and a scan has no partitioning: a
    join on it gets its own exchanges, which AQE can split where a key is hot.
    """
    path = f"{(folder or checkpoint_dir(df.sparkSession)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint under ``spark.checkpoint.dir`` (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def bind(df: DataFrame, *named: Column) -> DataFrame:
    """Append ``named`` columns computed exactly once per row.

    The columns come out of a one-element ``inline`` generator, so later
    filters on them are not pushed below (and re-evaluated inside) the
    expressions that compute them, and later projections do not re-inline
    those expressions at every reference.  Costs one trivial generator step
    inside the same codegen stage; no shuffle, no materialisation.
    """
    return df.select(*[F.col(c) for c in df.columns], F.inline(F.array(F.struct(*named))))
