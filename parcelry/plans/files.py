"""Small files on the shared file system, through Hadoop's own interfaces.

Used for metadata only (manifests, run ids); tables are read and written by
Spark.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, path: str):
    """(Path, FileSystem) of ``path`` on its own file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    p, fs = hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``."""
    p, fs = hadoop_path(spark, path)
    return fs.getContentSummary(p).getLength()


def modified(spark: SparkSession, path: str) -> float:
    """Modification time in seconds."""
    p, fs = hadoop_path(spark, path)
    return fs.getFileStatus(p).getModificationTime() / 1000


def make_folder(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.mkdirs(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a whole file under a name that nobody has; False if it is taken.

    Spark's checkpoint file manager does this: a temporary file, renamed
    without overwriting, so the name shows either nothing or the whole text.
    """
    jvm = spark.sparkContext._jvm
    p, _ = hadoop_path(spark, path)
    manager = jvm.org.apache.spark.sql.execution.streaming.checkpointing.CheckpointFileManager.create(
        p.getParent(), spark.sparkContext._jsc.hadoopConfiguration())
    if manager.exists(p):
        return False
    out = manager.createAtomic(p, False)
    try:
        out.write(bytearray(text.encode()))
        out.close()
    except Exception as e:
        out.cancel()
        if "AlreadyExists" in str(e):
            return False
        raise
    return True
