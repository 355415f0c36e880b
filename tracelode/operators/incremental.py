"""Processing only new or changed records, with the target table as the only state.

The target holds, per source key, the version that was processed last.  A run anti-joins its source against the
target on key and version; that and the carrying over of keys it didn't see are one full outer join, written once.  A target version is a
folder of its own, which one small marker file publishes: the marker names the folder and appears by one rename.  A run that dies
before the rename leaves no trace, so the next run compares with the last version that was published; a run that is repeated
after the rename finds its own number published and does nothing; of two drivers that do the same run one publishes, the other's
folder is dropped.

Defined results: of several observations of a key within a run the one with the latest ``seen_at`` counts, then
the highest id; null keys compare equal to null; a version with a content hash on both sides changes only with that hash,
otherwise with any of the other fields (null equals null); an empty source publishes the state unchanged; extra
columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.plans import workspace as ws


class VersionedTarget:
    """A target whose versions are folders; the marker ``v<run>.done`` publishes the folder that it names.

    Each folder is partitioned by ``changed``: the rows of both parts are the state, those that are changed the run's output.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def published(self) -> list[int]:
        return sorted(int(m[1]) for n in ws.listed(self.spark, self.path) if (m := re.fullmatch(r"v(\d+)\.done", n)))

    def version(self) -> int | None:
        """The run that was published last, None before the first."""
        done = self.published()
        return done[-1] if done else None

    def _rows(self, run: int) -> DataFrame:
        folder = ws.read_text(self.spark, f"{self.path}/v{run}.done")
        return self.spark.read.schema(f"{self.schema}, changed boolean").option("basePath", f"{self.path}/{folder}").parquet(f"{self.path}/{folder}")

    def state(self) -> DataFrame:
        at = self.version()
        return self.spark.createDataFrame([], self.schema) if at is None else self._rows(at).drop("changed")

    def write(self, run: int, rows: DataFrame) -> str:
        """Write a version (the schema's columns and ``changed``) that nobody sees yet; returns its folder's name."""
        folder = f"v{run}-{uuid.uuid4().hex}"
        rows.write.mode("errorifexists").partitionBy("changed").parquet(f"{self.path}/{folder}")
        return folder

    def publish(self, run: int, folder: str) -> bool:
        """Make a written version visible; False, and the folder is gone, if that run is published already."""
        if ws.publish_text(self.spark, f"{self.path}/v{run}.done", folder):
            return True
        ws.delete(self.spark, f"{self.path}/{folder}")
        return False

    def outputs(self, columns: list[str], schema: str) -> DataFrame:
        """The processed rows of all published versions, with their ``run_no``."""
        parts = [self._rows(at).filter("changed").select(*columns, F.lit(at).cast("bigint").alias("run_no")) for at in self.published()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, run_no bigint")

    def sweep(self) -> int:
        """Delete what failed runs left behind: folders that no marker names.  Not while another run is at work."""
        named = {ws.read_text(self.spark, f"{self.path}/v{run}.done") for run in self.published()}
        left = [n for n in ws.listed(self.spark, self.path) if n not in named and not n.endswith(".done")]
        for n in left:
            ws.delete(self.spark, f"{self.path}/{n}")
        return len(left)


def latest_per_key(rows: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key: a hash aggregate that combines before the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("last")).select(*keys, "last.*")


def same_version(a: str, b: str, strong: str, weak: list[str]) -> Column:
    """Equality of two versions: by ``strong`` where both sides have it, else by all ``weak`` fields."""
    x, y = F.col(f"{a}.{strong}"), F.col(f"{b}.{strong}")
    weakly = reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in weak])
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(weakly)


def next_state(state: DataFrame, source: DataFrame, keys: list[str], strong: str, weak: list[str]) -> DataFrame:
    """(keys, version, changed): the source's rows, changed where the state lacks their key and version, and the keys only the state has."""
    s, t = source.withColumn("__here", F.lit(True)).alias("s"), state.withColumn("__here", F.lit(True)).alias("t")
    match = reduce(Column.__and__, [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    seen = F.col("s.__here").isNotNull()
    changed = seen & ~F.coalesce(F.col("t.__here") & same_version("s", "t", strong, weak), F.lit(False))
    return s.join(t, match, "full_outer").select(*(F.when(seen, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in [*keys, strong, *weak]), changed.alias("changed"))


def process_run(target: VersionedTarget, run: int, source: DataFrame, keys: list[str], strong: str, weak: list[str]) -> bool:
    """One incremental run over ``source`` (unique by key); False if that run was published before."""
    at = target.version()
    if at is not None and run <= at:
        return False
    return target.publish(run, target.write(run, next_state(target.state(), source, keys, strong, weak)))


def changed_files(spark: SparkSession, files: DataFrame, runs: DataFrame, path: str) -> DataFrame:
    """(run_no, agent, path): the files that each successful run has to process, against the target at ``path``.

    The target outlives the call: called again with more runs, or after a failure, only the runs that aren't published are done.
    """
    keys, strong, weak = ["agent", "path"], "content_hash", ["len", "mtime_secs", "mtime_nanos", "change_token"]
    columns = [*keys, strong, *weak]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (files.schema[c] for c in columns))
    target = VersionedTarget(spark, path, schema)
    at = target.version()
    # one row a run: the list of runs is the driver's schedule, not data
    todo = [run for (run,) in runs.filter(F.lower(F.trim("status")) == "ok").select(F.col("run_no").cast("bigint")).distinct().orderBy("run_no").collect() if at is None or run > at]
    if todo:
        order = F.struct(F.coalesce(F.col("seen_at"), F.timestamp_millis(F.lit(-(10**15)))), F.col("obs_id"))
        # the observations are read once and laid out by run, so that a run reads its own
        work = ws.Workspace(spark, "incremental")
        seen = latest_per_key(files.withColumn("run_no", F.col("run_no").cast("bigint")).filter(F.col("run_no").isin(todo)), ["run_no", *keys], order, [strong, *weak])
        by_run = work.save(seen, "observed", ["run_no"])
        for run in todo:
            process_run(target, run, by_run.filter(F.col("run_no") == run).select(*columns), keys, strong, weak)
        work.drop(by_run)
    return target.outputs(keys, "agent string, path string").select("run_no", "agent", "path")
