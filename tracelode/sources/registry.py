"""The readers by the name of their tool, and reading them all into one corpus."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators import context, corpus
from tracelode.sources import json_files, jsonl, sqlite

READERS: dict[str, Callable] = {
    "claude": jsonl.claude, "codex": jsonl.codex, "antigravity": jsonl.antigravity, "kimi": jsonl.kimi, "pi": jsonl.pi, "omp": partial(jsonl.pi, agent="omp"),
    "gemini": json_files.gemini, "cline": json_files.cline, "opencode": sqlite.opencode, "crush": sqlite.crush, "cursor": sqlite.cursor,
}


def read_all(spark: SparkSession, stores: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, events, intake) of several stores: tool name -> folder."""
    parts = [READERS[name](spark, path) for name, path in stores.items()]
    return tuple(reduce(DataFrame.unionByName, frames) for frames in zip(*parts))


def build_corpus(messages: DataFrame, events: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The flattened search rows of messages and events: copies dropped, turns repaired, tool events attributed as of their time."""
    m = messages.withColumn("rm_id", F.xxhash64("agent", "session", "turn", "text", "reply"))
    m = corpus.renumbered(corpus.deduplicated(m))
    e = corpus.deduplicated_events(events.withColumn("event_id", F.xxhash64("agent", "session", "call_id", "ts", "name", "input", "output")), ["ts", "event_id"])
    turns = context.attributed_events(e, m.select("session", "ts", "turn"))
    rows = corpus.flatten(m, e.join(turns.select("event_id", "turn").dropDuplicates(["event_id"]), "event_id"), labels)
    return rows.withColumn("id", F.xxhash64("session", "turn", "who", "text"))
