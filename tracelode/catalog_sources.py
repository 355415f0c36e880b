"""Queries of readers and writers: the message table is written as a store of each kind and read back by that store's reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode import schema
from tracelode.operators import lexical
from tracelode.operators.filters import QuerySpec
from tracelode.plans import workspace
from tracelode.plans.workspace import Workspace
from tracelode.sources import json_files, jsonl, sinks, tables

QUERIES: dict = {}
SQL: dict = {}


def _add(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _talk(spark, d) -> DataFrame:
    """The messages of each session in order, numbered anew; times in whole seconds."""
    n = F.row_number().over(Window.partitionBy("session").orderBy("turn", "rm_id")) - 1
    when = F.date_format(F.timestamp_seconds(F.floor(F.coalesce("ts", F.lit(0)) / 1000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return tables.messages(spark, d).filter("session is not null").select("session", "rm_id", n.alias("n"), "text", F.coalesce("reply", F.lit("")).alias("reply"), when.alias("when"), F.coalesce(F.trim("model"), F.lit("")).alias("model"))


def _store(spark, d, name: str, records: list[Column], *, first: Column | None = None, by_session: bool = True, by_folder: bool = True, document: Column | None = None) -> str:
    """Writes the records of each message as lines, a file a session if asked, each in a folder of its own if asked; returns the folder."""
    talk, work = _talk(spark, d), Workspace(spark, name)
    path = f"{work.path}/store"
    if document is not None:
        docs = talk.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("n", *[c.alias(f"c{i}") for i, c in enumerate(records)]))).alias("rows"))  # a test session
        flat = docs.select("session", F.to_json(F.struct(F.col("session").alias("sessionId"), F.flatten(F.transform("rows", lambda r: F.array(*(r[f"c{i}"] for i in range(len(records)))))).alias("messages"))).alias("value"))
        flat.repartition("session").write.partitionBy("session").text(path)
        return path
    # a session's opening line goes with its first message: the branches of a union keep their own partitions, and a repartition over them may be left out
    opening = [F.when(F.col("n") == 0, first)] if first is not None else []
    lines = talk.select("session", "n", F.posexplode(F.array(*opening, *records)).alias("k", "value")).filter("value is not null")
    ordered = lines.repartition("session").sortWithinPartitions("session", "n", "k")
    if by_session and not by_folder and workspace.scheme(spark, path) == "file":
        ordered.select("session", "value").mapInArrow(sinks.files_by_key(path), "files bigint").agg(F.sum("files")).collect()
        return path
    (ordered.select("session", "value").write.partitionBy("session") if by_session else ordered.select("value").write).text(path)
    return path


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def _s(**fields: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in fields.items()))


_T = "t AS (SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY turn, rm_id) - 1 AS INT) AS turn, rm_id, text, coalesce(reply, '') AS reply, CASE WHEN regexp_matches(reply, '[^\\s\\p{Z}]') THEN reply ELSE '' END AS said, (coalesce(ts, 0) // 1000) * 1000 AS ts, CASE WHEN trim(model) = '<synthetic>' THEN '' ELSE trim(coalesce(model, '')) END AS model FROM raw_messages WHERE session IS NOT NULL)"


def _claude(spark, d):
    user = _json(type=F.lit("user"), sessionId=F.col("session"), userType=F.lit("external"), cwd=F.lit("/work/atlas"), timestamp=F.col("when"), message=_s(role=F.lit("user"), content=F.col("text")))
    call = _s(type=F.lit("tool_use"), text=F.lit(None).cast("string"), id=F.concat(F.lit("t"), "rm_id"), name=F.lit("Bash"), input=_s(command=F.concat(F.lit("run "), "n")))
    answer = _json(type=F.lit("assistant"), sessionId=F.col("session"), timestamp=F.col("when"), message=_s(model=F.col("model"), content=F.array(_s(type=F.lit("text"), text=F.col("reply"), id=F.lit(None).cast("string"), name=F.lit(None).cast("string"), input=F.lit(None).cast("struct<command:string>")), call)))
    result = _json(type=F.lit("user"), sessionId=F.col("session"), message=_s(content=F.array(_s(type=F.lit("tool_result"), tool_use_id=F.concat(F.lit("t"), "rm_id"), content=F.concat(F.lit("out "), "n"), is_error=F.col("rm_id") % 3 == 0))))
    meta = _json(type=F.lit("user"), sessionId=F.col("session"), isMeta=F.lit(True), message=_s(content=F.lit("hidden")))
    command = _json(type=F.lit("user"), sessionId=F.col("session"), message=_s(content=F.lit("<command-name>x</command-name>")))
    return jsonl.claude(spark, _store(spark, d, "claude", [user, meta, answer, result, command, F.lit("{broken")], by_session=False), "*.txt")


@_add("scan_claude", f"WITH {_T} SELECT session, turn, text, said AS reply, ts, model, 'atlas' AS project FROM t")
def scan_claude(spark, d):
    return _claude(spark, d)[0].select("session", "turn", "text", "reply", "ts", "model", "project")


@_add("scan_claude_events", f"WITH {_T} SELECT session, 't' || rm_id AS call_id, 'Bash' AS name, 'run ' || turn AS input, 'out ' || turn AS output, rm_id % 3 <> 0 AS ok, ts FROM t")
def scan_claude_events(spark, d):
    return _claude(spark, d)[1].select("session", "call_id", "name", "input", "output", "ok", "ts")


@_add("scan_claude_intake", f"WITH {_T} SELECT unnest(['row', 'agent_row', 'event', 'skip', 'error']) AS outcome, unnest([count(*), count(*), count(*), 2 * count(*), count(*)]) AS n FROM t")
def scan_claude_intake(spark, d):
    return _claude(spark, d)[2].groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@_add("scan_codex", f"WITH {_T} SELECT session, turn, text, said AS reply, ts, model FROM t")
def scan_codex(spark, d):
    part = lambda kind, text: F.array(_s(type=F.lit(kind), text=text))
    first = _json(type=F.lit("session_meta"), payload=_s(id=F.col("session"), cwd=F.lit("/work/atlas")))
    context = _json(type=F.lit("turn_context"), payload=_s(model=F.col("model"), cwd=F.lit("/work/atlas")))
    sent = _json(type=F.lit("event_msg"), payload=_s(type=F.lit("user_message"), message=F.col("text")))
    user = _json(type=F.lit("response_item"), timestamp=F.col("when"), payload=_s(type=F.lit("message"), role=F.lit("user"), content=part("input_text", F.col("text"))))
    injected = _json(type=F.lit("response_item"), payload=_s(type=F.lit("message"), role=F.lit("user"), content=part("input_text", F.lit("injected context that nobody sent"))))
    answer = _json(type=F.lit("response_item"), payload=_s(type=F.lit("message"), role=F.lit("assistant"), content=part("output_text", F.col("reply"))))
    path = _store(spark, d, "codex", [context, sent, user, injected, answer], first=first, by_folder=False)
    return jsonl.codex(spark, path, "*.txt")[0].select("session", "turn", "text", "reply", "ts", "model")


@_add("scan_antigravity", f"WITH {_T} SELECT 'session=' || session AS session, turn, trim(regexp_replace(text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS text, said AS reply, ts FROM t")
def scan_antigravity(spark, d):
    user = _json(type=F.lit("USER_INPUT"), source=F.lit("USER_EXPLICIT"), created_at=F.col("when"), content=F.concat(F.lit("<USER_REQUEST>"), "text", F.lit("</USER_REQUEST> and more")))
    step = _json(type=F.lit("PLANNER_RESPONSE"), source=F.lit("MODEL"), content=F.col("reply"))
    other = _json(type=F.lit("USER_INPUT"), source=F.lit("SYSTEM"), content=F.lit("a note of the system"))
    path = _store(spark, d, "antigravity", [user, other, step])
    return jsonl.antigravity(spark, path, "*.txt")[0].select("session", "turn", "text", "reply", "ts")


@_add("scan_pi", f"WITH {_T} SELECT session, turn, text, said AS reply, ts, model FROM t")
def scan_pi(spark, d):
    """A tree of records in which every turn also has an abandoned answer."""
    here, before = F.concat(F.lit("u"), "n"), F.when(F.col("n") > 0, F.concat(F.lit("a"), F.col("n") - 1))
    first = _json(type=F.lit("session"), id=F.col("session"), version=F.lit(3), cwd=F.lit("/work/atlas"))
    user = _json(type=F.lit("message"), id=here, parentId=before, timestamp=F.col("when"), message=_s(role=F.lit("user"), content=F.col("text")))
    dead = _json(type=F.lit("message"), id=F.concat(F.lit("x"), "n"), parentId=here, message=_s(role=F.lit("assistant"), content=F.lit("abandoned")))
    answer = _json(type=F.lit("message"), id=F.concat(F.lit("a"), "n"), parentId=here, message=_s(role=F.lit("assistant"), model=F.col("model"), content=F.col("reply")))
    path = _store(spark, d, "pi", [user, dead, answer], first=first, by_folder=False)
    return jsonl.pi(spark, path, glob="*.txt")[0].select("session", "turn", "text", "reply", "ts", "model")


@_add("scan_gemini", f"WITH {_T} SELECT session, turn, text, said AS reply, ts, model FROM t")
def scan_gemini(spark, d):
    none = F.lit(None).cast("string")
    user = _s(type=F.lit("user"), timestamp=F.col("when"), content=F.col("text"), model=none)
    info = _s(type=F.lit("info"), timestamp=none, content=F.lit("a note"), model=none)
    answer = _s(type=F.lit("gemini"), timestamp=none, content=F.col("reply"), model=F.col("model"))
    path = _store(spark, d, "gemini", [user, info, answer], document=F.lit(True))
    return json_files.gemini(spark, path, "*.txt")[0].select("session", "turn", "text", "reply", "ts", "model")


# ---------------------------------------------------------------- writers

@_add("sink_corpus", "SELECT id, session, turn, ts, agent, project, concept, model, model_source, who, text, content_digest FROM msgs WHERE agent IS NOT NULL")
def sink_corpus(spark, d):
    """The corpus written by agent and read again."""
    path = f"{Workspace(spark, 'sink').path}/corpus"
    sinks.write_corpus(tables.msgs(spark, d).filter("agent is not null"), path, 4)
    return spark.read.schema(schema.MSGS).parquet(path)


@_add("sink_json", "SELECT id, session, turn, who, text FROM msgs")
def sink_json(spark, d):
    path = f"{Workspace(spark, 'sink').path}/json"
    sinks.write_json(tables.msgs(spark, d).select("id", "session", "turn", "who", "text"), path)
    return spark.read.schema("id bigint, session string, turn int, who string, text string").json(path)


_CLEAN = lambda c: f"trim(regexp_replace(coalesce(CAST({c} AS VARCHAR), ''), '[\\s\\p{{Z}}]+', ' ', 'g'))"


@_add("sink_flat", "WITH h AS (SELECT *, text AS snippet FROM msgs WHERE regexp_matches(text, '(?i)exit code [0-9]+')) SELECT " + " || chr(9) || ".join(_CLEAN(c) for c in ("session", "agent", "project", "turn", "who", "snippet")) + " AS value FROM h")
def sink_flat(spark, d):
    """Hits as tab-separated lines, written and read again."""
    path = f"{Workspace(spark, 'sink').path}/flat"
    hits = lexical.regex(tables.msgs(spark, d), QuerySpec("exit code [0-9]+")).withColumn("snippet", F.col("text"))
    sinks.write_flat(hits, path)
    return spark.read.text(path)


@_add("sink_envelope", "SELECT id, session, who FROM msgs WHERE contains(lower(text), 'lease')")
def sink_envelope(spark, d):
    """Hits as JSON objects without internal columns, parsed again."""
    hits = lexical.phrase(tables.msgs(spark, d), QuerySpec("lease")).select("id", "session", "who", F.lit(1).alias("place"))
    parsed = sinks.envelope(hits).select(F.from_json("value", "id bigint, session string, who string, place int").alias("v")).select("v.*")
    return parsed.filter("place is null").drop("place")
