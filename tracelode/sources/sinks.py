"""Writers: Parquet corpora, JSON lines, tab-separated pages, stores of small files."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions import text as fx


def write_corpus(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Search rows by agent; sessions are hashed to ``buckets`` files of an agent, so that refreshing replaces few files."""
    rows.repartition(buckets, "agent", F.pmod(F.xxhash64("session"), F.lit(buckets))).sortWithinPartitions("session", "turn").write.mode("overwrite").partitionBy("agent").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def flat(hits: DataFrame) -> DataFrame:
    """session, agent, project, turn, who and snippet as one tab-separated line a hit."""
    clean = [fx.one_line(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("session", "agent", "project", "turn", "who", "snippet")]
    return hits.select(F.concat_ws("\t", *clean).alias("value"))


def write_flat(hits: DataFrame, path: str) -> None:
    flat(hits).write.mode("overwrite").text(path)


def envelope(hits: DataFrame, internals: tuple[str, ...] = ("meta", "evidence", "boundary_class", "place")) -> DataFrame:
    """One JSON object a hit, without internal columns."""
    return hits.select(F.to_json(F.struct(*[c for c in hits.columns if c not in internals])).alias("value"))


def files_by_key(path: str) -> Callable:
    """For mapInArrow over (key, value) sorted by key: writes the lines of each key as one text file and yields the number of files.

    For stores of many small files on disks that all tasks see (``file:``), where Spark's own writer starts a process a file for its rights
    and adds a checksum file.  A file is named by its key's digest and renamed into its place when whole, so a task that runs again
    replaces its files by the same ones.  All lines of a key must be in one task.
    """
    root = re.sub(r"^file:(//(?=/))?", "", path)

    def write(batches):
        import pyarrow as pa

        open_key = out = target = None
        n = 0

        def close():
            out.close()
            os.replace(out.name, target)

        try:
            for batch in batches:
                for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if out is None or key != open_key:
                        if out is not None:
                            close()
                        name = hashlib.sha1(key.encode()).hexdigest()
                        folder, open_key, n = f"{root}/{name[0]}", key, n + 1
                        os.makedirs(folder, exist_ok=True)
                        target = f"{folder}/{name}.txt"
                        out = open(f"{target}.{os.getpid()}.tmp", "w", encoding="utf-8", newline="")
                    out.write(value + "\n")
            if out is not None:
                close()
        finally:
            if out is not None and not out.closed:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    return write
