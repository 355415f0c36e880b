"""SQLite stores: a batch data source for their tables, and readers of opencode, crush and cursor.

The source opens each file read-only; one file is one partition, as one store is one writer's.
"""

from __future__ import annotations

import glob as globbing
import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracelode.functions import text as fx
from tracelode.sources import common
from tracelode.sources.common import field
from tracelode.sources.jsonl import _record


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.options = schema, options

    def partitions(self):
        path = self.options["path"]
        files = [path] if os.path.isfile(path) else sorted(globbing.glob(f"{path}/**/{self.options.get('glob', '*.db')}", recursive=True))
        return [_File(f) for f in files] or [_File("")]

    def read(self, partition):
        if not partition.path:
            return
        db = sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True)
        db.text_factory = lambda b: b.decode("utf-8", "replace")
        try:
            there = {r[0] for r in db.execute("select name from sqlite_master where type in ('table', 'view')")}
            if self.options["table"] not in there:
                return
            names = [f.name for f in self.schema.fields if f.name != "file"]
            columns = {r[1] for r in db.execute(f'pragma table_info("{self.options["table"]}")')}
            wanted = ", ".join(f'"{n}"' if n in columns else f'NULL AS "{n}"' for n in names)
            for row in db.execute(f'select {wanted} from "{self.options["table"]}"'):
                text = [v.decode("utf-8", "replace") if isinstance(v, bytes) else v for v in row]
                typed = [None if v is None else int(v) if f.dataType.simpleString() == "bigint" else str(v) for v, f in zip(text, [f for f in self.schema.fields if f.name != "file"])]
                yield (partition.path, *typed)
        finally:
            db.close()


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_table").schema("file string, ...").option("table", t).load(path)``; columns that a table lacks
    are null, files without the table are empty."""

    @classmethod
    def name(cls):
        return "sqlite_table"

    def reader(self, schema):
        return _Reader(schema, self.options)


def table(spark: SparkSession, path: str, name: str, columns: str, glob: str = "*.db") -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").schema(f"file string, {columns}").option("table", name).option("glob", glob).load(path)


def opencode(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An opencode store of either version: text parts of a message joined in order, injected parts dropped for prompts."""
    sessions = table(spark, path, "session", "id string, directory string, parent_id string, title string").unionByName(table(spark, path, "session_v2", "id string, directory string, parent_id string, title string"))
    m = table(spark, path, "message", "id string, session_id string, data string, time_created bigint").select("file", "id", "session_id", field("role", "data").alias("role"), F.coalesce(field("modelID", "data"), field("model.modelID", "data"), F.lit("")).alias("model"), "time_created")
    p = table(spark, path, "part", "id string, message_id string, session_id string, data string, time_created bigint").select("file", F.col("id").alias("part"), F.col("message_id").alias("id"), "data", F.col("time_created").alias("at"))
    parts = m.join(p, ["file", "id"])
    injected = F.coalesce(field("synthetic", "data") == "true", F.lit(False)) | F.coalesce(field("ignored", "data") == "true", F.lit(False))
    said = parts.filter((field("type", "data") == "text") & ~((F.col("role") == "user") & injected))
    texts = said.groupBy("file", "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part", field("text", "data").alias("t")))), lambda x: x["t"]), "\n").alias("text"))  # one message's parts
    v1 = m.join(texts, ["file", "id"], "left").select("file", "id", F.col("session_id").alias("session"), "role", "model", F.col("time_created").alias("ts"), "text")
    v2 = table(spark, path, "session_message", "id string, session_id string, type string, seq bigint, time_created bigint, data string").select(
        "file", "id", F.col("session_id").alias("session"), F.col("type").alias("role"), F.coalesce(field("model.id", "data"), F.lit("")).alias("model"), F.col("time_created").alias("ts"), F.coalesce(field("text", "data"), common.content_text(field("content", "data"))).alias("text"))
    rows = v1.unionByName(v2).join(sessions.select(F.col("id").alias("session"), "directory", "parent_id").dropDuplicates(["session"]), "session", "left").withColumn("ordinal", F.struct("ts", "id"))
    kind = F.when((F.col("role") == "user") & common.typed(F.col("text")), "prompt").when(F.col("role") == "assistant", "reply").otherwise("skip")
    records = _record(rows, session=F.col("session"), kind=kind, text=F.coalesce("text", F.lit("")), ts=F.col("ts"), model=F.col("model"), project=fx.project_name(F.col("directory")), side=F.col("parent_id").isNotNull(), parent=F.coalesce("parent_id", F.lit("")), reason=F.coalesce("role", F.lit("")))
    status = field("state.status", "data")
    calls = parts.filter(field("type", "data") == "tool").select(F.col("session_id").alias("session"), "file", F.struct("at", F.col("part").alias("id")).alias("ordinal"), F.col("at").alias("ts"), F.lit("tool").alias("kind"), field("tool", "data").alias("name"), fx.summarized_input(field("state.input", "data")).alias("input"),
                                                                 F.coalesce(field("callID", "data"), "part").alias("call_id"), F.lit("").alias("child_session"), field("state.output", "data").alias("output"), F.when(status == "completed", True).when(status == "error", False).alias("ok"))
    child = sessions.filter("parent_id is not null").select(F.col("parent_id").alias("session"), "file", F.struct(F.lit(0).cast("bigint").alias("at"), "id").alias("ordinal"), F.lit(0).cast("bigint").alias("ts"), F.lit("subagent_start").alias("kind"), F.lit("task").alias("name"), F.col("title").alias("input"), F.col("id").alias("call_id"), F.col("id").alias("child_session"), F.lit("").alias("output"), F.lit(None).cast("boolean").alias("ok"))
    return common.messages(records, "opencode"), common.events(calls.unionByName(child), None, "opencode"), common.intake(records, "opencode")


def crush(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A crush store: messages in order of creation with typed parts; the project is the folder that holds the store."""
    sessions = table(spark, path, "sessions", "id string, parent_session_id string, title string")
    m = table(spark, path, "messages", "id string, session_id string, role string, parts string, model string, created_at bigint")
    part = "array<struct<type:string,data:struct<text:string,id:string,name:string,input:string,tool_call_id:string,content:string,is_error:boolean>>>"
    rows = m.join(sessions.select("file", F.col("id").alias("session_id"), "parent_session_id"), ["file", "session_id"], "left").withColumn("p", F.from_json("parts", part)).withColumn("ordinal", F.struct("created_at", "id"))
    text = F.array_join(F.transform(F.filter("p", lambda x: x["type"] == "text"), lambda x: x["data"]["text"]), "\n")
    ts = F.when(F.col("created_at") < 100_000_000_000, F.col("created_at") * 1000).otherwise(F.col("created_at"))
    kind = F.when((F.col("role") == "user") & common.typed(text), "prompt").when(F.col("role") == "assistant", "reply").when(F.col("role") == "tool", "result").otherwise("skip")
    folder = fx.project_name(F.regexp_replace(F.regexp_replace("file", r"/[^/]+$", ""), r"/\.crush$", ""))
    records = _record(rows, session=F.col("session_id"), kind=kind, text=text, ts=ts, model=F.coalesce("model", F.lit("")), project=folder, side=F.col("parent_session_id").isNotNull(), parent=F.coalesce("parent_session_id", F.lit("")), reason=F.coalesce("role", F.lit("")))
    flat = rows.select(F.col("session_id").alias("session"), "file", "ordinal", ts.alias("ts"), F.explode("p").alias("x"))
    calls = flat.filter("x.type = 'tool_call'").select("session", "file", "ordinal", "ts", F.lit("tool").alias("kind"), F.col("x.data.name").alias("name"), fx.summarized_input(F.col("x.data.input")).alias("input"), F.col("x.data.id").alias("call_id"), F.lit("").alias("child_session"))
    results = flat.filter("x.type = 'tool_result'").select("session", "file", "ordinal", F.col("x.data.tool_call_id").alias("call_id"), F.col("x.data.content").alias("output"), (~F.col("x.data.is_error")).alias("ok"))
    return common.messages(records, "crush"), common.events(calls, results, "crush"), common.intake(records, "crush")


def cursor(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A cursor store, a key-value table: composers list their bubbles in order; hidden thoughts are skipped."""
    kv = table(spark, path, "cursorDiskKV", "key string, value string", "*.vscdb").unionByName(table(spark, path, "cursorDiskKV", "key string, value string", "*.db"))
    composers = kv.filter(F.startswith("key", F.lit("composerData:"))).select("file", F.substring_index("key", ":", -1).alias("session"), field("createdAt").cast("bigint").alias("created"), F.posexplode(F.from_json(field("fullConversationHeadersOnly"), "array<struct<bubbleId:string,type:int>>")).alias("ordinal", "h"))
    bubbles = kv.filter(F.startswith("key", F.lit("bubbleId:"))).select("file", F.element_at(F.split("key", ":"), 2).alias("session"), F.element_at(F.split("key", ":"), 3).alias("bubble"), "value")
    rows = composers.withColumn("bubble", F.col("h.bubbleId")).join(bubbles, ["file", "session", "bubble"], "left").withColumn("type", F.col("h.type"))
    text = F.coalesce(field("text"), F.lit(""))
    thought = F.coalesce(field("isThought") == "true", F.lit(False))
    ts = F.coalesce(F.when(fx.parse_timestamp(field("createdAt")) > 0, fx.parse_timestamp(field("createdAt"))), "created", F.lit(0))
    kind = F.when(F.col("value").isNull() | thought, "skip").when((F.col("type") == 1) & common.typed(text), "prompt").when(F.col("type") == 2, "reply").otherwise("skip")
    records = _record(rows, session=F.col("session"), kind=kind, text=text, ts=ts, model=F.coalesce(field("modelInfo.modelName"), F.lit("")), project=F.lit("cursor"), reason=F.when(thought, "thought").otherwise("other"))
    status = F.lower(field("toolFormerData.status"))
    calls = rows.filter(field("toolFormerData.name").isNotNull()).select("session", "file", "ordinal", ts.alias("ts"), F.lit("tool").alias("kind"), field("toolFormerData.name").alias("name"), fx.summarized_input(F.coalesce(field("toolFormerData.params"), field("toolFormerData.rawArgs"), F.lit("null"))).alias("input"),
                                                                         F.coalesce(field("toolFormerData.toolCallId"), "bubble").alias("call_id"), F.lit("").alias("child_session"), field("toolFormerData.result").alias("output"), F.when(status == "completed", True).when(status.isin("error", "failed", "cancelled", "rejected", "aborted"), False).alias("ok"))
    return common.messages(records, "cursor"), common.events(calls, None, "cursor"), common.intake(records, "cursor")
