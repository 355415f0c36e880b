"""Readers of JSON-lines stores: claude, codex, antigravity, kimi, pi."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.functions import text as fx
from tracelode.sources import common
from tracelode.sources.common import field

_BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
_RECORD = ["session", "file", "ordinal", "kind", "text", "ts", "model", "project", "who", "side", "parent", "reason"]


def _record(df: DataFrame, **given: Column) -> DataFrame:
    defaults = {"text": F.lit(""), "ts": F.lit(0).cast("bigint"), "model": F.lit(""), "project": F.lit(None).cast("string"), "who": F.lit("user"), "side": F.lit(False), "parent": F.lit(""), "reason": F.lit("")}
    return df.select("file", "ordinal", *(given.get(c, defaults.get(c)).alias(c) for c in _RECORD if c not in ("file", "ordinal")))


def _main_project(records: DataFrame) -> DataFrame:
    """Each session's most frequent project, the first by name of several."""
    n = records.filter(F.col("project").isNotNull()).groupBy("session", "project").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("session").agg(F.min_by("project", F.struct(-F.col("n"), "project")).alias("main"))
    return records.join(best, "session", "left").withColumn("project", F.coalesce("main", F.lit("unknown"))).drop("main")


def claude(spark: SparkSession, path: str, glob: str = "*.jsonl") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, events, intake) of a claude store: prompts are external user lines; side files (agent-*) are side sessions."""
    raw = common.lines(spark, path, glob).withColumn("ok", common.is_json())
    side_file = common.stem(F.col("file")).startswith("agent-")
    inner = F.coalesce(field("sessionId"), common.stem(F.col("file")))
    base = raw.withColumn("side", side_file).withColumn("session", F.when(side_file, common.stem(F.col("file"))).otherwise(inner)).withColumn("parent", F.when(side_file, field("sessionId")).otherwise(""))
    content = field("message.content")
    ts = fx.parse_timestamp(field("timestamp"))
    base = base.withColumn("content", content).withColumn("ts", ts).withColumn("type", field("type")).withColumn("cwd", field("cwd")).withColumn("blocks", F.from_json("content", _BLOCKS))
    text = common.content_text(F.col("content"))
    recap = F.coalesce(field("isCompactSummary") == "true", F.lit(False))
    hidden = F.coalesce(field("isMeta") == "true", F.lit(False)) | (F.coalesce(field("isSidechain") == "true", F.lit(False)) & ~F.col("side"))
    external = F.coalesce(field("userType"), F.lit("external")) == "external"
    prompt = (F.col("type") == "user") & ~hidden & external & (common.typed(text) | recap)
    has_result = F.exists(F.coalesce("blocks", F.array().cast(_BLOCKS)), lambda b: b["type"] == "tool_result")
    kind = F.when(~F.col("ok"), "error").when(hidden, "skip").when(has_result, "result").when(prompt, "prompt").when(F.col("type") == "assistant", "reply").otherwise("skip")
    reason = F.when(hidden, "meta or side line").when(F.col("type") == "user", "not typed").otherwise("other type")
    records = _main_project(_record(base, session=F.col("session"), kind=kind, text=text, ts=F.col("ts"), model=F.coalesce(field("message.model"), F.lit("")), project=F.when(F.col("cwd").isNotNull(), fx.project_name(F.col("cwd"))),
                                    who=F.when(recap, "recap").otherwise("user"), side=F.col("side"), parent=F.coalesce("parent", F.lit("")), reason=reason))
    blocks = base.filter(F.col("ok") & ~hidden).select("session", "file", "ordinal", "ts", F.explode("blocks").alias("b"))
    calls = blocks.filter("b.type = 'tool_use'").select("session", "file", "ordinal", "ts", F.when(F.col("b.name").isin("Task", "Agent"), "subagent_start").otherwise("tool").alias("kind"), F.col("b.name").alias("name"),
                                                        fx.summarized_input(F.col("b.input")).alias("input"), F.col("b.id").alias("call_id"), F.lit("").alias("child_session"))
    results = blocks.filter("b.type = 'tool_result'").select("session", "file", "ordinal", F.col("b.tool_use_id").alias("call_id"), common.content_text(F.col("b.content")).alias("output"), (~F.coalesce("b.is_error", F.lit(False))).alias("ok"))
    return common.messages(records, "claude"), common.events(calls, results, "claude"), common.intake(records, "claude")


def codex(spark: SparkSession, path: str, glob: str = "*.jsonl") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A codex store: user text counts if a logged submission is a prefix of it; the model of a turn context holds onward."""
    raw = common.lines_once(spark, path, glob).withColumn("ok", common.is_json()).withColumn("type", field("type")).withColumn("pt", field("payload.type"))
    w = Window.partitionBy("file").orderBy("ordinal")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    meta = F.when(F.col("type") == "session_meta", field("payload.id"))
    base = raw.withColumn("session", F.coalesce(F.first(meta, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), common.stem(F.col("file"))))
    base = base.withColumn("cwd", F.last(F.when(F.col("type").isin("session_meta", "turn_context"), field("payload.cwd")), ignorenulls=True).over(so_far))
    base = base.withColumn("model", F.last(F.when(F.col("type") == "turn_context", field("payload.model")), ignorenulls=True).over(so_far)).withColumn("ts", fx.parse_timestamp(field("timestamp")))
    text = common.content_text(field("payload.content"))
    said = base.filter((F.col("type") == "event_msg") & (F.col("pt") == "user_message")).groupBy("file").agg(F.collect_set(field("payload.message")).alias("sent"))  # one file's submissions
    base = base.withColumn("text", F.when(F.col("type") == "compacted", field("payload.message")).otherwise(text)).join(said, "file", "left")
    attested = F.exists(F.coalesce("sent", F.array().cast("array<string>")), lambda s: (s != "") & F.startswith(F.col("text"), s))
    prompt = (F.col("type") == "response_item") & (F.col("pt") == "message") & (field("payload.role") == "user") & attested & common.typed(F.col("text"))
    reply = (F.col("type") == "response_item") & (F.col("pt") == "message") & (field("payload.role") == "assistant")
    kind = F.when(~F.col("ok"), "error").when(prompt | (F.col("type") == "compacted"), "prompt").when(reply, "reply").when(F.col("pt").isin("function_call", "custom_tool_call", "local_shell_call", "web_search_call"), "call").when(F.col("pt").isin("function_call_output", "custom_tool_call_output"), "result").otherwise("skip")
    records = _record(base, session=F.col("session"), kind=kind, text=F.col("text"), ts=F.col("ts"), model=F.coalesce("model", F.lit("")), project=fx.project_name(F.col("cwd")), who=F.when(F.col("type") == "compacted", "recap").otherwise("user"), reason=F.coalesce("pt", "type"))
    calls = base.filter(kind == "call").select("session", "file", "ordinal", "ts", F.lit("tool").alias("kind"), F.coalesce(field("payload.name"), F.regexp_replace("pt", "_call$", "")).alias("name"),
                                               fx.summarized_input(F.coalesce(field("payload.arguments"), field("payload.input"), field("payload.action"), F.lit("null"))).alias("input"), F.coalesce(field("payload.call_id"), F.lit("")).alias("call_id"), F.lit("").alias("child_session"))
    code = F.get_json_object(field("payload.output"), "$.metadata.exit_code")
    results = base.filter(kind == "result").select("session", "file", "ordinal", field("payload.call_id").alias("call_id"), F.coalesce(F.get_json_object(field("payload.output"), "$.output"), field("payload.output")).alias("output"), (code.cast("int") == 0).alias("ok"))
    return common.messages(records, "codex"), common.events(calls, results, "codex"), common.intake(records, "codex")


def antigravity(spark: SparkSession, path: str, glob: str = "*.jsonl") -> tuple[DataFrame, DataFrame, DataFrame]:
    """An antigravity store: explicit user input unwrapped from its request tag; planner steps are replies and announce calls."""
    raw = common.lines(spark, path, glob).withColumn("ok", common.is_json()).withColumn("type", field("type")).withColumn("ts", fx.parse_timestamp(field("created_at")))
    base = raw.withColumn("session", F.element_at(F.split("file", "/"), -2))
    content = F.coalesce(field("content"), F.lit(""))
    inside = fx.stripped(F.regexp_extract(content, r"(?s)<USER_REQUEST>(.*?)</USER_REQUEST>", 1))
    text = F.when(F.col("type") == "USER_INPUT", F.when(inside != "", inside).otherwise(content)).otherwise(content)
    prompt = (F.col("type") == "USER_INPUT") & (field("source") == "USER_EXPLICIT") & common.typed(text)
    kind = F.when(~F.col("ok"), "error").when(prompt, "prompt").when(F.col("type") == "PLANNER_RESPONSE", "reply").when(field("source") == "MODEL", "result").otherwise("skip")
    cwd = F.regexp_extract("value", r'"(?:Cwd|cwd)\\*"\s*:\s*\\*"([^"\\]+)', 1)
    records = _main_project(_record(base, session=F.col("session"), kind=kind, text=text, ts=F.col("ts"), project=F.when(cwd != "", fx.project_name(cwd)), reason=F.col("type")))
    # announced calls wait in order within their planner step; the model's action records take them first in, first out
    w = Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    steps = base.withColumn("step", F.sum((F.col("type") == "PLANNER_RESPONSE").cast("int")).over(w))
    announced = steps.filter("type = 'PLANNER_RESPONSE'").select("session", "file", "ordinal", "ts", "step", F.posexplode(F.from_json(field("tool_calls"), "array<struct<name:string,args:string>>")).alias("nth", "c"))
    done = steps.filter((field("source") == "MODEL") & (F.col("type") != "PLANNER_RESPONSE")).select("file", "step", F.col("ordinal").alias("at"), content.alias("output"), field("status").alias("status"))
    done = done.withColumn("nth", F.row_number().over(Window.partitionBy("file", "step").orderBy("at")) - 1)
    joined = announced.join(done, ["file", "step", "nth"], "left")
    status = F.upper("status")
    calls = joined.select("session", "file", "ordinal", "ts", F.when(F.upper("c.name") == "INVOKE_SUBAGENT", "subagent_start").otherwise("tool").alias("kind"), F.col("c.name").alias("name"), fx.summarized_input(F.col("c.args")).alias("input"),
                          F.concat(F.lit("ag"), "step", F.lit("-"), "nth").alias("call_id"), F.lit("").alias("child_session"), "output", F.when(status.isin("DONE", "COMPLETED", "SUCCESS"), True).when(status.isin("ERROR", "FAILED"), False).alias("ok"))
    return common.messages(records, "antigravity"), common.events(calls, None, "antigravity"), common.intake(records, "antigravity")


def kimi(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A kimi store: context.jsonl says who said what, wire.jsonl when; the last prompts and the last turn marks belong together."""
    folder = F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1)
    raw = common.lines(spark, path, "context.jsonl").withColumn("ok", common.is_json()).withColumn("session", folder).withColumn("role", field("role"))
    text = common.content_text(field("content"))
    prompt = (F.col("role") == "user") & common.typed(text)
    kind = F.when(~F.col("ok"), "error").when(prompt, "prompt").when(F.col("role") == "assistant", "reply").when(F.col("role") == "tool", "result").otherwise("skip")
    base = raw.withColumn("kind", kind).withColumn("text", text)
    w = Window.partitionBy("session").orderBy("ordinal")
    prompts = base.filter("kind = 'prompt'").withColumn("nth", F.row_number().over(w)).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("session")))
    wire = common.lines(spark, path, "wire.jsonl").withColumn("session", folder).filter(field("message.type") == "TurnBegin")
    marks = wire.select("session", "ordinal", (field("timestamp").cast("double") * 1000).cast("bigint").alias("ts")).withColumn("nth", F.row_number().over(w)).withColumn("marks", F.count(F.lit(1)).over(Window.partitionBy("session")))
    many = marks.groupBy("session").agg(F.max("marks").alias("marks"))
    aligned = prompts.join(many, "session", "left").withColumn("nth", F.col("nth") + F.greatest(F.lit(0), F.coalesce("marks", F.lit(0)) - F.col("of"))).drop("marks")
    timed = aligned.join(marks.select("session", "nth", F.col("ts").alias("at")), ["session", "nth"], "left")
    timed = timed.withColumn("at", F.coalesce(F.last("at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    base = base.join(timed.select("session", "file", "ordinal", "at"), ["session", "file", "ordinal"], "left")
    records = _record(base, session=F.col("session"), kind=F.col("kind"), text=F.col("text"), ts=F.col("at"), project=F.lit("unknown"), reason=F.coalesce("role", F.lit("")))
    named = F.from_json(field("tool_calls"), "array<struct<id:string,function:struct<name:string,arguments:string>>>")
    calls = base.filter("role = 'assistant'").select("session", "file", "ordinal", F.lit(0).cast("bigint").alias("ts"), F.explode(named).alias("c")).select("session", "file", "ordinal", "ts", F.lit("tool").alias("kind"), F.col("c.function.name").alias("name"), fx.summarized_input(F.col("c.function.arguments")).alias("input"), F.col("c.id").alias("call_id"), F.lit("").alias("child_session"))
    results = base.filter("role = 'tool'").select("session", "file", "ordinal", field("tool_call_id").alias("call_id"), F.col("text").alias("output"), (~F.startswith(F.ltrim("text"), F.lit("<system>ERROR"))).alias("ok"))
    return common.messages(records, "kimi"), common.events(calls, results, "kimi"), common.intake(records, "kimi")


def pi(spark: SparkSession, path: str, agent: str = "pi", glob: str = "*.jsonl*") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A pi or oh-my-pi store, a tree of records: the parent chain of the last record is the conversation, the rest is skipped.

    The chain is found for all files at once by the nested sets of the hierarchy operator: a record is on it if its range
    holds the last record's.  Files without ids keep their order; ``.jsonl.gz`` copies are read as well.
    """
    from tracelode.operators.hierarchy import nested_sets

    raw = common.lines_once(spark, path, glob).withColumn("ok", common.is_json()).withColumn("type", field("type")).withColumn("rid", field("id"))
    head = raw.filter("type = 'session'").groupBy("file").agg(F.first(field("id")).alias("session"), F.first(field("cwd")).alias("cwd"))
    body = raw.filter("type <> 'session' or not ok").join(head, "file", "left").withColumn("session", F.coalesce("session", common.stem(F.col("file"))))
    key = lambda c: F.concat("file", F.lit("\n"), c)
    tree = body.filter("rid is not null").select(key("rid").alias("node"), F.when(field("parentId").isNotNull(), key(field("parentId"))).alias("parent"))
    sets = nested_sets(spark, tree).filter("not cyclic").select("node", "root", "lft", "size")
    leaf = body.filter("rid is not null").groupBy("file").agg(F.max_by(key("rid"), "ordinal").alias("node")).join(sets, "node").select("file", F.col("root").alias("leaf_root"), F.col("lft").alias("leaf"))
    marked = body.withColumn("node", key("rid")).join(sets, "node", "left").join(leaf, "file", "left")
    on = F.col("rid").isNull() & F.col("leaf").isNull() | (F.col("root") == F.col("leaf_root")) & (F.col("lft") <= F.col("leaf")) & (F.col("leaf") < F.col("lft") + F.col("size"))
    w = Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    base = marked.withColumn("on", F.coalesce(on, F.lit(False))).withColumn("role", field("message.role")).withColumn("text", F.when(F.col("type") == "compaction", field("summary")).otherwise(common.content_text(field("message.content"))))
    changed = F.last(F.when((F.col("type") == "model_change") & F.col("on"), field("modelId")), ignorenulls=True).over(w)
    base = base.withColumn("model", F.coalesce(field("message.model"), changed, F.lit(""))).withColumn("ts", fx.parse_timestamp(field("timestamp")))
    prompt = (F.col("role") == "user") & common.typed(F.col("text")) | (F.col("type") == "compaction")
    kind = F.when(~F.col("ok"), "error").when(~F.col("on"), "skip").when(prompt, "prompt").when(F.col("role") == "assistant", "reply").when(F.col("role").isin("toolResult", "bashExecution"), "result").otherwise("skip")
    records = _record(base, session=F.col("session"), kind=kind, text=F.col("text"), ts=F.col("ts"), model=F.col("model"), project=F.coalesce("cwd", F.lit("unknown")), who=F.when(F.col("type") == "compaction", "recap").otherwise("user"), reason=F.when(~F.col("on"), "unreferenced").otherwise(F.coalesce("type", F.lit(""))))
    live = base.filter("on")
    blocks = F.from_json(field("message.content"), "array<struct<type:string,id:string,name:string,arguments:string>>")
    used = live.filter("role = 'assistant'").select("session", "file", "ordinal", "ts", F.explode(blocks).alias("b")).filter("b.type = 'toolCall'").select("session", "file", "ordinal", "ts", F.lit("tool").alias("kind"), F.col("b.name").alias("name"), fx.summarized_input(F.col("b.arguments")).alias("input"), F.col("b.id").alias("call_id"), F.lit("").alias("child_session"))
    results = live.filter("role = 'toolResult'").select("session", "file", "ordinal", field("message.toolCallId").alias("call_id"), F.col("text").alias("output"), (F.coalesce(field("message.isError"), F.lit("false")) != "true").alias("ok"))
    shell = live.filter("role = 'bashExecution'").select("session", "file", "ordinal", "ts", F.lit("tool").alias("kind"), F.lit("bash").alias("name"), field("message.command").alias("input"), F.concat(F.lit("sh"), F.hex(F.xxhash64("file", "ordinal"))).alias("call_id"), F.lit("").alias("child_session"), field("message.output").alias("output"),
                                                            ((field("message.exitCode") == "0") & (F.coalesce(field("message.cancelled"), F.lit("false")) != "true")).alias("ok"))
    return common.messages(records, agent), common.events(used, results, agent).unionByName(common.events(shell, None, agent)), common.intake(records, agent)
