"""Durable intermediate tables.

Iterative operators cut their lineage by writing a Parquet table into the folder that the cluster
shares (``spark.checkpoint.dir``).  A written table survives the loss of any executor, is columnar and
compressed, and unlike ``DataFrame.checkpoint`` is computed only once.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_root: str | None = None
_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only where the session names none (tests, laptops)."""
    global _local_root
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder shared by all executors")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="tracelode-")
        atexit.register(shutil.rmtree, _local_root, True)
    return f"file://{_local_root}"


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def scheme(spark: SparkSession, path: str) -> str:
    """Of the file system that a path belongs to; ``file`` is one that all tasks see as a disk."""
    return _fs(spark, path)[0].getUri().getScheme()


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath)


def delete(spark: SparkSession, path: str) -> None:
    fs, jpath = _fs(spark, path)
    fs.delete(jpath, True)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Atomic on file systems with atomic rename; False if the target is already there."""
    fs, jsource = _fs(spark, source)
    jtarget = spark._jvm.org.apache.hadoop.fs.Path(target)
    return False if fs.exists(jtarget) else bool(fs.rename(jsource, jtarget))


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's content."""
    fs, jpath = _fs(spark, path)
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file appear whole or not at all; False if it is there already or another writer was faster.

    The file is written under a name of its own and renamed, so the file system must rename atomically and never over a file that
    exists, as HDFS and local disks do; on object stores give a folder of a committer that does.
    """
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, jown = _fs(spark, own)
    stream = fs.create(jown, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if rename(spark, own, path):
        return True
    delete(spark, own)
    return False


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    fs, jpath = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath)) if fs.exists(jpath) else []


class Workspace:
    """A private folder below the shared one, for the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/tracelode/{name}-{uuid.uuid4().hex}"
        self._serial = 0
        _made.append(self.path)

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` once and return it as a scan of what was written."""
        self._serial += 1
        path = f"{self.path}/{self._serial:04d}-{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tracelode_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete tables made by ``save`` that nothing reads any more."""
        for df in frames:
            path = getattr(df, "_tracelode_path", None)
            if path:
                delete(self.spark, path)

    def cleanup(self) -> None:
        delete(self.spark, self.path)


def sweep(spark: SparkSession) -> int:
    """Delete the intermediate tables of all calls so far; for use when their results have been written."""
    n = len(_made)
    while _made:
        delete(spark, _made.pop())
    return n
