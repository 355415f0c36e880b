"""Readers of stores with one JSON document a session: gemini, cline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import text as fx
from tracelode.sources import common
from tracelode.sources.common import field
from tracelode.sources.jsonl import _record


def gemini(spark: SparkSession, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A gemini store: messages of type user and gemini in their array's order; the project is always gemini."""
    docs = common.documents(spark, path, glob).withColumn("ok", common.is_json())
    rows = docs.select("file", "ok", field("sessionId").alias("session"), F.posexplode_outer(F.from_json(field("messages"), "array<string>")).alias("ordinal", "value"))
    rows = rows.withColumn("session", F.coalesce("session", common.stem(F.col("file")))).withColumn("ordinal", F.coalesce("ordinal", F.lit(0))).withColumn("type", field("type")).withColumn("ts", fx.parse_timestamp(field("timestamp")))
    text = common.content_text(field("content"))
    kind = F.when(~F.col("ok"), "error").when((F.col("type") == "user") & common.typed(text), "prompt").when(F.col("type") == "gemini", "reply").otherwise("skip")
    records = _record(rows, session=F.col("session"), kind=kind, text=text, ts=F.col("ts"), model=F.coalesce(field("model"), F.lit("")), project=F.lit("gemini"), reason=F.coalesce("type", F.lit("")))
    call = "array<struct<id:string,name:string,args:string,status:string,result:array<struct<functionResponse:struct<response:struct<output:string>>>>>>"
    used = rows.filter("type = 'gemini'").select("session", "file", "ordinal", "ts", F.explode(F.from_json(field("toolCalls"), call)).alias("c"))
    output = F.array_join(F.transform("c.result", lambda r: r["functionResponse"]["response"]["output"]), "\n")
    calls = used.select("session", "file", "ordinal", "ts", F.lit("tool").alias("kind"), F.col("c.name").alias("name"), fx.summarized_input(F.col("c.args")).alias("input"), F.col("c.id").alias("call_id"), F.lit("").alias("child_session"), output.alias("output"),
                        F.when(F.lower("c.status").isin("success", "ok"), True).when(F.lower("c.status").isin("error", "cancelled", "failed"), False).alias("ok"))
    return common.messages(records, "gemini"), common.events(calls, None, "gemini"), common.intake(records, "gemini")


def cline(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A cline store: a folder a task with its API history; the task index gives the working directory."""
    docs = common.documents(spark, path, "api_conversation_history.json").withColumn("ok", common.is_json())
    index = common.documents(spark, path, "taskHistory.json").select(F.explode(F.from_json("value", "array<struct<id:string,cwdOnTaskInitialization:string>>")).alias("t")).select(F.col("t.id").alias("session"), F.col("t.cwdOnTaskInitialization").alias("cwd"))
    rows = docs.select("file", "ok", F.element_at(F.split("file", "/"), -2).alias("session"), F.posexplode_outer(F.from_json("value", "array<string>")).alias("ordinal", "value")).withColumn("ordinal", F.coalesce("ordinal", F.lit(0)))
    rows = rows.join(index.dropDuplicates(["session"]), "session", "left").withColumn("role", field("role")).withColumn("ts", fx.parse_timestamp(F.coalesce(field("ts"), F.col("session"))))
    bare = F.regexp_replace(common.content_text(field("content")), r"(?s)<environment_details>.*?</environment_details>", "")
    inside = F.regexp_extract(bare, r"(?s)<(task|feedback|answer|user_message)>(.*?)</\1>", 2)
    text = fx.stripped(F.when((F.col("role") == "user") & (F.trim(inside) != ""), inside).otherwise(bare))
    kind = F.when(~F.col("ok"), "error").when((F.col("role") == "user") & common.typed(text) & ~F.startswith(text, F.lit("[")), "prompt").when(F.col("role") == "assistant", "reply").otherwise("skip")
    records = _record(rows, session=F.col("session"), kind=kind, text=text, ts=F.col("ts"), project=fx.project_name(F.col("cwd")), reason=F.coalesce("role", F.lit("")))
    block = "array<struct<type:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
    blocks = rows.select("session", "file", "ordinal", "ts", F.explode(F.from_json(field("content"), block)).alias("b"))
    calls = blocks.filter("b.type = 'tool_use'").select("session", "file", "ordinal", "ts", F.lit("tool").alias("kind"), F.col("b.name").alias("name"), fx.summarized_input(F.col("b.input")).alias("input"), F.col("b.id").alias("call_id"), F.lit("").alias("child_session"))
    results = blocks.filter("b.type = 'tool_result'").select("session", "file", "ordinal", F.col("b.tool_use_id").alias("call_id"), common.content_text(F.col("b.content")).alias("output"), (~F.coalesce("b.is_error", F.lit(False))).alias("ok"))
    return common.messages(records, "cline"), common.events(calls, results, "cline"), common.intake(records, "cline")
