"""The test tables as relations of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "msgs")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_messages with a role column."""
    return table(spark, sf_dir, "raw_messages")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as tool events: a session a user, an error is a failed call."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "subagent_start").otherwise("tool")
    ok = F.when(F.col("event_type") == "error", F.lit(False)).when(F.col("event_type") != "view", F.lit(True))
    return e.select(
        F.element_at(F.array(F.lit("claude"), F.lit("codex"), F.lit("gemini")), (F.col("user_id") % 3 + 1).cast("int")).alias("agent"), F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("session"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), kind.alias("kind"), F.col("event_type").alias("name"), F.col("props").alias("input"), F.format_string("%.2f", "value").alias("output"),
        ok.alias("ok"), F.col("event_id").cast("string").alias("call_id"), F.col("event_id").cast("bigint").alias("event_id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "session_family").select("session", F.coalesce("root", "session").alias("root"), "side")
