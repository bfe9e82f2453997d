"""Tables that Spark derives once from the source tables and keeps in the shared folder.

A derived table's folder is named by a hash of every source file (path,
length, time) and of the code that builds it, so changed inputs or code give
a new one.  It is written under a name of its own and then renamed, so two
drivers never write to one path; whoever comes second uses the first one's.
"""

from __future__ import annotations

import hashlib
import importlib
import inspect
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from parcelry.plans import files
from parcelry.plans.guards import shuffles_freed
from parcelry.session import checkpoint_dir


def listing(spark: SparkSession, path: str) -> str:
    """Every file below ``path`` with its length and time, sorted (any Hadoop file system)."""
    p, fs = files.hadoop_path(spark, path)
    if not fs.exists(p):
        return f"{path}: none"
    found, below = [], fs.listFiles(p, True)
    while below.hasNext():
        f = below.next()
        found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return ";".join(sorted(found))


def signature(spark: SparkSession, sources: Iterable[str], modules: Iterable[str]) -> str:
    sig = hashlib.sha256()
    for name in modules:
        sig.update(inspect.getsource(importlib.import_module(name)).encode())  # also from a zip
    for path in sources:
        sig.update(listing(spark, path).encode())
    return sig.hexdigest()[:16]


def derived(spark: SparkSession, name: str, sources: Iterable[str], modules: Iterable[str], build: Callable[[str], None]) -> str:
    """The folder of a derived table; ``build(path)`` writes it where it is not there yet."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{signature(spark, sources, modules)}"
    done, fs = files.hadoop_path(spark, path)
    if not fs.exists(done):
        own, _ = files.hadoop_path(spark, f"{path}-{uuid.uuid4().hex}")
        with shuffles_freed(spark):
            build(own.toString())
        if not fs.rename(own, done) and not fs.exists(done):
            raise OSError(f"cannot rename {own.toString()} to {path}")
    return path
