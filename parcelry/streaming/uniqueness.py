"""Uid uniqueness as keyed state (T2): the cost of a batch does not grow with history.

``transformWithState`` keeps one flag per stored uid in RocksDB.  Its function
runs in Python, so it sees uids only: a task first folds its messages to one
row per uid and Arrow batch (a hot uid costs one row a batch of rows, not one
a message), and gets back, for every uid of the micro-batch, whether an
earlier batch stored it.  The payload never leaves the JVM.  State is
versioned with the query's checkpoint: a batch that is replayed sees the
state before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """The RocksDB provider for the queries started inside (a query keeps the settings it starts with)."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class StoredUids(StatefulProcessor):
    """State: a flag for each uid that a batch stored.  Rows: (uid, claims it)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", "flag boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.stored.exists()
        claimed = any([r.claims for r in rows])
        if claimed and not known:
            self.stored.update((True,))
        yield Row(order_uid=key[0], stored=known)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.stored.update((True,))

    def close(self) -> None:
        pass


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            folded = pa.Table.from_batches([batch]).group_by("order_uid").aggregate([("claims", "max")])
            yield from folded.rename_columns(["order_uid", "claims"]).combine_chunks().to_batches()


def seen_before(uids: DataFrame, stored: DataFrame) -> DataFrame:
    """``(order_uid, stored)`` for every uid of a micro-batch of ``uids`` (``order_uid``, ``claims``).

    ``stored`` (``order_uid``) fills the state of a new checkpoint: the uids
    that other runs stored, read once.
    """
    folded = uids.mapInArrow(_fold, "order_uid string, claims boolean")
    first = stored.select("order_uid").distinct().groupBy("order_uid")
    return folded.groupBy("order_uid").transformWithState(
        StoredUids(), "order_uid string, stored boolean", "Append", "None", initialState=first)
