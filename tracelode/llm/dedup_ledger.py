"""Duplicates hidden by formatting differences: an incremental ledger of canonical keys.

The ledger is a table at a path of its own, cut into buckets by a hash of the key, and outlives the calls that feed it.  A batch is
aggregated by key, full-outer-joined with the buckets it touches, and only those buckets are written anew; the others stay where
they are.  One small manifest, which appears by a rename, names each bucket's folder and the batches that are in: a batch that is fed
again, after a failure or not, changes nothing.

Defined results: null texts and texts with fewer than ``min_chars`` letters and digits have no key and are
left out; repeated ids with the same text count as one member; ties on the representative go to the lowest id;
an empty table yields an empty ledger; extra columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.plans import workspace as ws
from tracelode.plans.skew import join_hot
from tracelode.plans.workspace import Workspace

MIN_CHARS = 24
TOOL_FIELDS = ("path", "offset", "limit", "pattern", "mode", "timeout_s")
_NOT_ALNUM = r"[^\p{L}\p{N}]+"


def squash(text: Column) -> Column:
    """Letters and digits only, without case; sharp s is what its capitals say, SS."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), _NOT_ALNUM, "")


def canonical_text(text: Column, is_tool: Column, fields: tuple[str, ...] = TOOL_FIELDS) -> Column:
    """The text's letters and digits; in tool rows the named fields are put into a fixed order first.

    A tool row reads ``name: fields``, then possibly a line break and output.  The field part is a JSON object
    (up to its closing brace, over line breaks) or the rest of the first line that isn't blank.
    """
    names = "|".join(fields)
    split = r"(?s)^([^:\n]*):\s*(\{.*?\}|[^\n]*)(.*)$"
    marked = F.regexp_replace(F.regexp_extract(text, split, 2), rf"(?i)(?<![\p{{L}}\p{{N}}_])({names})[\"'”“’`]?\s*[:=]", "\u0001$1=")
    parts = F.array_sort(F.transform(F.split(marked, "\u0001"), squash))
    ordered = F.concat(squash(F.regexp_extract(text, split, 1)), F.array_join(parts, ""), squash(F.regexp_extract(text, split, 3)))
    has_fields = text.rlike(rf"(?is)^[^:\n]*:\s*.*?(?<![\p{{L}}\p{{N}}_])({names})[\"'”“’`]?\s*[:=]")
    return F.when(is_tool & has_fields, ordered).otherwise(squash(text))


def keyed(msgs: DataFrame, *, id_col: str = "id", text_col: str = "text", who_col: str = "who", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, key): the 16-byte digest of each row's canonical text; rows without enough letters are left out."""
    is_tool = F.coalesce(F.lower(F.trim(F.col(who_col))) == "tool", F.lit(False))
    canon = msgs.select(F.col(id_col).alias("id"), canonical_text(F.col(text_col), is_tool).alias("canon"))
    return canon.filter(F.length("canon") >= min_chars).select("id", F.unhex(F.md5("canon")).alias("key"))


LEDGER = "key binary, keep_id bigint, copies bigint"
BUCKETS = 16


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def merge_batch(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The ledger after a batch of (id, key): the batch is pre-aggregated, then full-outer-joined by key.

    A key that holds a third of the batch arrives as one row per map task, because the aggregate combines before it shuffles.
    """
    new = batch.groupBy("key").agg(F.min("id").alias("new_id"), F.count(F.lit(1)).alias("new_copies"))
    return ledger.join(new, "key", "full_outer").select(
        "key",
        F.least("keep_id", "new_id").alias("keep_id"),
        (F.coalesce("copies", F.lit(0)) + F.coalesce("new_copies", F.lit(0))).alias("copies"),
    )


class Ledger:
    """The bucketed table at ``path``.  The number of buckets is fixed when the first batch is fed."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        self.buckets = self._manifest()["count"] if self._versions() else buckets

    def _versions(self) -> list[int]:
        return sorted(int(m[1]) for n in ws.listed(self.spark, self.path) if (m := re.fullmatch(r"manifest-(\d+)", n)))

    def _manifest(self) -> dict:
        at = self._versions()
        return json.loads(ws.read_text(self.spark, f"{self.path}/manifest-{at[-1]}")) if at else {"version": 0, "count": self.buckets, "batches": [], "folders": {}}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def table(self, only: list[int] | None = None) -> DataFrame:
        """The ledger, or some of its buckets."""
        folders = self._manifest()["folders"]
        paths = [f"{self.path}/{folder}/bucket={b}" for b, folder in folders.items() if only is None or int(b) in only]
        return self.spark.read.schema(LEDGER).parquet(*paths) if paths else empty_ledger(self.spark)

    def feed(self, name: str, batch: DataFrame) -> bool:
        """Count a batch of (id, key); False if a batch of that name is in already."""
        now = self._manifest()
        if name in now["batches"]:
            return False
        touched = [r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        folder = f"part-{uuid.uuid4().hex}"
        if touched:
            merged = merge_batch(self.table(touched), batch).withColumn("bucket", self.bucket())
            # adaptive execution splits large buckets and joins small ones' pieces, so that files have a good size
            merged.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        after = {"version": now["version"] + 1, "count": self.buckets, "batches": [*now["batches"], name], "folders": {**now["folders"], **{str(b): folder for b in touched}}}
        if not ws.publish_text(self.spark, f"{self.path}/manifest-{after['version']}", json.dumps(after)):
            ws.delete(self.spark, f"{self.path}/{folder}")
            raise RuntimeError("another batch was fed at the same time; feed this one again")
        return True

    def sweep(self) -> None:
        """Delete the folders that the last manifest doesn't name any bucket of, and older manifests.  Not while a batch is fed."""
        now = self._manifest()
        keep = {f"manifest-{now['version']}", *now["folders"].values()}
        for name in ws.listed(self.spark, self.path):
            if name not in keep:
                ws.delete(self.spark, f"{self.path}/{name}")


def duplicate_members(keys: DataFrame, ledger: DataFrame) -> DataFrame:
    """(keep_id, copy_id, copies): every member of a group but its representative."""
    groups = ledger.filter(F.col("copies") > 1)
    joined = join_hot(keys.select("id", "key"), groups, ["key"], "copies", F.xxhash64("id"))
    return joined.filter(F.col("id") != F.col("keep_id")).select("keep_id", F.col("id").alias("copy_id"), "copies").distinct()


def format_duplicates(spark: SparkSession, msgs: DataFrame, *, batches: int = 2, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(ledger, members) of a message table, which is fed to the ledger at ``path`` in ``batches`` slices, alternating blocks of ids.

    The result doesn't depend on how the rows are sliced.  Without a path the ledger is a new one; with one, slices that are in
    already aren't counted again, so that the call can be repeated after a failure.
    """
    work = Workspace(spark, "ledger")
    keys = work.save(keyed(msgs).withColumn("batch", F.pmod(F.floor(F.col("id") / 4096), F.lit(batches)).cast("int")), "keys")
    ledger = Ledger(spark, path or f"{work.path}/ledger")
    for number in range(batches):
        ledger.feed(f"{number} of {batches}", keys.filter(F.col("batch") == number).select("id", "key"))
        ledger.sweep()
    return ledger.table(), duplicate_members(keys, ledger.table())
