"""What all readers of session stores share.

A reader turns one store into two DataFrames of the shapes ``schema.MESSAGES`` (with a ``rm_id``-like ``ordinal``) and
``schema.EVENTS``.  The pattern is the same everywhere: records in their order -> kept prompts open a turn (a running count) ->
replies and tool calls belong to the turn that is open -> results are joined to calls by id.  Malformed records become the
outcome ``error`` of the intake tally and nothing else.

Defined results: prompts that are blank or wrappers open no turn; prose before the first prompt is lost; a call without a
result has a null outcome; of several results the first after the call counts; empty stores yield empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode import schema
from tracelode.functions import text as fx
from tracelode.plans.workspace import Workspace


def lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(file, ordinal, value): the lines of JSON-lines files in order; invalid UTF-8 becomes U+FFFD; compressed files too.

    Large files are read in blocks by several tasks: a line's place is its block's first byte and its number in that task's scan.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    placed = raw.select(F.col("_metadata.file_path").alias("file"), at.alias("ordinal"), F.regexp_replace("value", r"\r$", "").alias("value"))
    return placed.filter(F.trim("value") != "")


def lines_once(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """``lines``, read once into a durable table, for readers that go over them several times.

    Spark counts a file as 4 MB at least, which makes a task of every few files where a store holds one small file a session; here it
    counts as 64 KB, in a session of its own as the setting belongs to sessions.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.files.openCostInBytes", "64k")
    return Workspace(spark, "lines").save(lines(own, path, glob), "lines")


def documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(file, value): whole JSON files."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def field(name: str, column: str = "value") -> Column:
    return F.get_json_object(column, f"$.{name}")


def is_json(column: str = "value") -> Column:
    return F.try_parse_json(column).isNotNull()


def stem(file: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.(?:jsonl|json)(?:\.gz)?$", "")


def content_text(content: Column) -> Column:
    """The text of a message's content: a string, or the text blocks of an array joined by line breaks."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "input_text", "output_text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.when(F.startswith(F.ltrim(content), F.lit("[")) & blocks.isNotNull(), F.array_join(texts, "\n")).otherwise(content)


def typed(text: Column) -> Column:
    """Whether a person typed this: it says something and is no wrapper."""
    return F.coalesce(text.rlike(r"[^\s\p{Z}]") & ~fx.is_wrapper(text), F.lit(False))


def turns(records: DataFrame, session: str = "session") -> DataFrame:
    """Adds ``turn``, the number of prompts up to a record minus one; records before the first prompt get -1."""
    w = Window.partitionBy(session).orderBy("file", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("turn", (F.sum(F.when(F.col("kind") == "prompt", 1).otherwise(0)).over(w) - 1).cast("int"))


def messages(records: DataFrame, agent: str) -> DataFrame:
    """Messages of records (session, file, ordinal, kind prompt or reply, text, ts, model, project, who, side, parent).

    A turn's reply is its reply records in order; its model is the first one named.  A turn is a handful of records.
    """
    numbered = turns(records).filter("turn >= 0")
    at = F.struct("file", "ordinal")
    prompt = F.col("kind") == "prompt"
    pieces = F.sort_array(F.collect_list(F.when((F.col("kind") == "reply") & F.col("text").rlike(r"[^\s\p{Z}]"), F.struct("file", "ordinal", "text"))))
    joined = F.array_join(F.transform(pieces, lambda p: p["text"]), "\n\n")
    model = F.when(F.col("kind").isin("prompt", "reply") & (F.trim("model") != "") & (F.col("model") != "<synthetic>"), F.col("model"))
    out = numbered.groupBy("session", "turn").agg(
        F.min_by("text", F.when(prompt, at)).alias("text"), F.min_by("ts", F.when(prompt, at)).alias("ts"), F.min_by("project", at).alias("project"), joined.alias("reply"),
        F.min_by(model, F.when(model.isNotNull(), at)).alias("model"), F.min_by("who", F.when(prompt, at)).alias("who"), F.max(F.coalesce("side", F.lit(False))).alias("side"), F.min_by("parent", F.when(F.trim("parent") != "", at)).alias("parent"),
    )
    return out.select(
        F.lit(agent).alias("agent"), F.coalesce("project", F.lit("unknown")).alias("project"), "session", F.coalesce("ts", F.lit(0)).cast("bigint").alias("ts"), "turn", "text", F.coalesce("who", F.lit("user")).alias("who"),
        F.coalesce("model", F.lit("")).alias("model"), F.when(F.col("model").isNotNull(), "explicit").otherwise("unknown").alias("model_source"), fx.capped(F.col("reply"), schema.REPLY_CAP).alias("reply"),
        F.length("reply").cast("bigint").alias("reply_chars"), "side", F.coalesce("parent", F.lit("")).alias("parent"),
    )


def events(calls: DataFrame, results: DataFrame | None, agent: str) -> DataFrame:
    """Events of calls (session, file, ordinal, ts, kind, name, input, call_id, child_session) with their results (session,
    file, ordinal, call_id, output, ok).  A call takes the first result after it."""
    if results is not None:
        after = calls.alias("c").join(results.alias("r"), (F.col("c.session") == F.col("r.session")) & (F.col("c.call_id") == F.col("r.call_id")) & (F.struct("r.file", "r.ordinal") >= F.struct("c.file", "c.ordinal")), "left")
        first = after.groupBy(*(F.col(f"c.{c}").alias(c) for c in calls.columns)).agg(F.min_by(F.struct("r.output", "r.ok"), F.when(F.col("r.file").isNotNull(), F.struct("r.file", "r.ordinal"))).alias("r"))
        calls = first.withColumn("output", F.col("r.output")).withColumn("ok", F.col("r.ok")).drop("r")
    out = F.coalesce("output", F.lit(""))
    return calls.select(
        F.lit(agent).alias("agent"), "session", F.coalesce("ts", F.lit(0)).cast("bigint").alias("ts"), "kind", "name", fx.capped(F.coalesce("input", F.lit("")), schema.EVENT_CAP).alias("input"), fx.capped(out, schema.EVENT_CAP).alias("output"),
        F.length(F.coalesce("input", F.lit(""))).cast("bigint").alias("input_chars"), F.length(out).cast("bigint").alias("output_chars"), F.octet_length(out).cast("bigint").alias("output_bytes"), F.col("ok").cast("boolean").alias("ok"),
        F.coalesce("call_id", F.lit("")).alias("call_id"), F.coalesce("child_session", F.lit("")).alias("child_session"),
    )


def intake(records: DataFrame, agent: str) -> DataFrame:
    """(agent, file, outcome, reason) of records with kind and reason, for the accounting operators."""
    outcome = F.when(F.col("kind") == "prompt", "row").when(F.col("kind") == "reply", "agent_row").when(F.col("kind").isin("call", "result"), "event").when(F.col("kind") == "error", "error").otherwise("skip")
    return records.select(F.lit(agent).alias("agent"), "file", outcome.alias("outcome"), F.coalesce("reason", F.lit("")).alias("reason"))
