"""Accounting of what was read: outcomes of records by file and agent, and the census against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Outcomes of a source record.
OUTCOMES = ("row", "agent_row", "event", "skip", "error")


def tallies(records: DataFrame, by: list[str]) -> DataFrame:
    """(by..., seen and a count of each outcome) of (by..., outcome) records."""
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("seen"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))


def skips(records: DataFrame, by: list[str]) -> DataFrame:
    return records.filter(F.col("outcome") == "skip").groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))


def audit(found: DataFrame, booked: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of files found with files booked: (keys..., found, booked, verdict ok, missing, stale or short)."""
    f = found.select(*keys, F.col("n").alias("found"))
    b = booked.select(*keys, F.col("n").alias("booked"))
    verdict = F.when(F.col("booked").isNull(), "missing").when(F.col("found").isNull(), "stale").when(F.col("found") != F.col("booked"), "short").otherwise("ok")
    return f.join(b, keys, "full_outer").withColumn("verdict", verdict)


def completeness(total: DataFrame, kept: DataFrame) -> DataFrame:
    """(agent, total, kept, share) of two row sets."""
    a = total.groupBy("agent").agg(F.count(F.lit(1)).alias("total"))
    b = kept.groupBy("agent").agg(F.count(F.lit(1)).alias("kept"))
    return a.join(b, "agent", "left").select("agent", "total", F.coalesce("kept", F.lit(0)).alias("kept"), F.round(F.coalesce("kept", F.lit(0)) / F.col("total"), 6).alias("share"))
