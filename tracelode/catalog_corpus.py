"""Queries of corpus building, normalisation, context, accounting and live state, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode import schema
from tracelode.catalog_search import _word_quality
from tracelode.functions import boundary
from tracelode.functions import text as fx
from tracelode.operators import accounting, context, corpus, hierarchy
from tracelode.sources import tables
from tracelode.streaming import live

QUERIES: dict = {}
SQL: dict = {}


def _add(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_EV = """ev AS (SELECT ['claude', 'codex', 'gemini'][user_id % 3 + 1] AS agent, 'u-' || user_id AS session, (epoch_us(ts) // 1000) AS ts, CASE WHEN event_type = 'signup' THEN 'subagent_start' ELSE 'tool' END AS kind,
  event_type AS name, props AS input, printf('%.2f', value) AS output, CASE WHEN event_type = 'error' THEN false WHEN event_type <> 'view' THEN true END AS ok, CAST(event_id AS VARCHAR) AS call_id, event_id FROM events)"""
# ---------------------------------------------------------------- building

@_add("content_digest", "SELECT id, content_digest AS digest FROM msgs WHERE content_digest IS NOT NULL AND text IS NOT NULL")
def content_digest(spark, d):
    """The digest of every row that has one stored; the stored one is the oracle."""
    return tables.msgs(spark, d).filter("content_digest is not null and text is not null").select("id", fx.digest(F.col("text")).alias("digest"))


@_add("replies_build", f"SELECT agent || ':' || session || ':' || turn AS mid, rm_id, CAST(CASE WHEN reply_chars > 0 THEN reply_chars ELSE length(reply) END AS BIGINT) AS reply_chars, (CASE WHEN reply_chars > 0 THEN reply_chars ELSE length(reply) END) > {schema.REPLY_CAP} AS reply_truncated FROM raw_messages WHERE regexp_matches(reply, '[^\\s\\p{{Z}}]')")
def replies_build(spark, d):
    m = tables.messages(spark, d)
    return corpus.replies(m).join(m.filter(F.col("reply").rlike(r"[^\s\p{Z}]")).select(corpus.message_id().alias("mid"), "rm_id", "reply"), ["mid", "reply"]).dropDuplicates(["rm_id", "mid"]).select("mid", "rm_id", "reply_chars", "reply_truncated")


@_add("sessions_agg", r"""WITH m AS (SELECT *, substr(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), 1, 120) AS line, lower(trim(parent)) AS claim FROM raw_messages)
SELECT session, min(agent) AS agent, arg_min(project, (turn, rm_id)) AS project, count(*) AS n, coalesce(min(ts) FILTER (ts > 0), 0) AS first_ts, coalesce(max(ts) FILTER (ts > 0), 0) AS last_ts, arg_min(line, (turn, rm_id)) AS first_text,
 arg_min(claim, (turn, rm_id)) FILTER (claim <> '') AS parent FROM m GROUP BY session""")
def sessions_agg(spark, d):
    return corpus.sessions(tables.messages(spark, d))


@_add("event_stats", f"WITH {_EV} SELECT agent, count(*) FILTER (kind = 'tool') AS calls, count(*) FILTER (kind = 'tool' AND NOT ok) AS fails, count(*) FILTER (kind = 'tool' AND ok IS NOT NULL) AS known, count(*) FILTER (kind = 'subagent_start') AS subagents FROM ev GROUP BY agent")
def event_stats(spark, d):
    return corpus.event_stats(tables.events(spark, d))


@_add("event_stats_by_tool", f"WITH {_EV} SELECT agent, name, count(*) FILTER (kind = 'tool') AS calls, count(*) FILTER (kind = 'tool' AND NOT ok) AS fails, count(*) FILTER (kind = 'tool' AND ok IS NOT NULL) AS known, count(*) FILTER (kind = 'subagent_start') AS subagents FROM ev GROUP BY agent, name")
def event_stats_by_tool(spark, d):
    return corpus.event_stats(tables.events(spark, d), by_name=True)


@_add("tool_rows", f"WITH {_EV} SELECT event_id, trim(CASE WHEN kind = 'subagent_start' THEN 'subagent ' ELSE '' END || name || CASE WHEN NOT coalesce(ok, true) THEN ' [failed]' ELSE '' END || CASE WHEN trim(coalesce(input, '')) <> '' THEN ': ' || trim(input) ELSE '' END || CASE WHEN coalesce(output, '') <> '' THEN chr(10) || output ELSE '' END) AS text FROM ev")
def tool_rows(spark, d):
    e = tables.events(spark, d)
    return e.select("event_id", corpus.tool_text(F.col("name"), F.col("kind"), F.col("ok"), F.col("input"), F.col("output")).alias("text"))


@_add("msgs_build", """SELECT who, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
  SELECT CASE WHEN trim(model) = '<synthetic>' THEN 'synthetic' WHEN coalesce(side, false) THEN 'subagent' ELSE 'user' END AS who, text FROM raw_messages WHERE text <> '' AND lower(trim(text)) <> 'continue' UNION ALL SELECT 'agent', reply FROM raw_messages WHERE reply <> '') GROUP BY who""")
def msgs_build(spark, d):
    m = tables.messages(spark, d)
    who = fx.row_kind(F.lit("user"), F.col("model"), F.col("text"), F.col("project"), F.col("side"))
    rows = corpus.flatten(m.withColumn("who", who).withColumn("model_source", F.lit("explicit")).withColumn("text", F.when(who != "control", F.col("text"))))
    return rows.groupBy("who").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@_add("session_sig", "SELECT session, count(*) AS rows FROM msgs GROUP BY session")
def session_sig(spark, d):
    s = corpus.session_signatures(tables.msgs(spark, d))
    return s.select("session", F.substring_index("signature", "-", 1).cast("bigint").alias("rows"))


@_add("project_name", "SELECT DISTINCT path, string_split(path, '/')[-1] AS name FROM source_files")
def project_name(spark, d):
    return tables.table(spark, d, "source_files").select("path", fx.project_name(F.col("path")).alias("name")).distinct()


@_add("row_kind", "SELECT rm_id, CASE WHEN trim(model) = '<synthetic>' THEN 'synthetic' WHEN lower(trim(text)) = 'continue' THEN 'control' WHEN coalesce(side, false) THEN 'subagent' ELSE 'user' END AS kind FROM raw_messages")
def row_kind(spark, d):
    return tables.messages(spark, d).select("rm_id", fx.row_kind(F.lit("user"), F.col("model"), F.col("text"), F.col("project"), F.col("side")).alias("kind"))


@_add("wrapper_filter", "SELECT id FROM msgs WHERE text IS NOT NULL AND NOT regexp_matches(text, '^\\s*(<command-name>|<command-message>|<command-args>|<local-command|<bash-input>|<bash-stdout>|<user-prompt-submit-hook>|Caveat:|<system-reminder>|<teammate-message|<task-notification|\\[SYSTEM NOTIFICATION|<system-notification)') AND who = 'user'")
def wrapper_filter(spark, d):
    return tables.msgs(spark, d).filter((F.col("who") == "user") & ~fx.is_wrapper(F.col("text"))).select("id")


@_add("timestamp_parse", "SELECT event_id, (epoch_us(ts) // 1000) AS ms FROM events")
def timestamp_parse(spark, d):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return tables.table(spark, d, "events").select("event_id", fx.parse_timestamp(text).alias("ms"))


@_add("age_labels", f"SELECT id, CASE WHEN ts <= 0 THEN '?' WHEN s < 60 THEN 'now' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' WHEN s < 5184000 THEN (s // 86400) || 'd' ELSE (s // 2592000) || 'mo' END AS age FROM (SELECT id, ts, ({schema.NOW_MS} - ts) // 1000 AS s FROM msgs WHERE ts IS NOT NULL)")
def age_labels(spark, d):
    return tables.msgs(spark, d).filter("ts is not null").select("id", fx.age_label(F.col("ts")).alias("age"))


# ---------------------------------------------------------------- normalisation

@_add("dedupe_messages", """SELECT agent, session, turn, text, rm_id FROM (SELECT *, row_number() OVER (PARTITION BY agent, session, turn, text ORDER BY length(coalesce(reply, '')) DESC, (coalesce(ts, 0) > 0) DESC, (coalesce(trim(model), '') <> '') DESC, (coalesce(trim(parent), '') <> '') DESC, coalesce(ts, 0), rm_id) AS rn FROM raw_messages) WHERE rn = 1""")
def dedupe_messages(spark, d):
    return corpus.deduplicated(tables.messages(spark, d)).select("agent", "session", "turn", "text", "rm_id")


@_add("repair_turn_collisions", """WITH c AS (SELECT agent, session, max(n) > 1 AS clash FROM (SELECT agent, session, turn, count(*) AS n FROM raw_messages GROUP BY ALL) GROUP BY ALL)
SELECT rm_id, CAST(CASE WHEN clash THEN row_number() OVER (PARTITION BY agent, session ORDER BY CASE WHEN coalesce(ts, 0) <= 0 THEN 1 ELSE 0 END, ts, turn, text, rm_id) - 1 ELSE turn END AS INT) AS turn FROM raw_messages JOIN c USING (agent, session)""")
def repair_turn_collisions(spark, d):
    return corpus.renumbered(tables.messages(spark, d)).select("rm_id", "turn")


@_add("dedupe_events", f"WITH {_EV}, k AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN '' ELSE CAST(event_id // 2 AS VARCHAR) END AS cid FROM ev) SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY agent, session, cid ORDER BY ts, event_id) AS rn FROM k) WHERE cid = '' OR rn = 1")
def dedupe_events(spark, d):
    call = F.when(F.col("event_id") % 10 == 0, "").otherwise(F.floor(F.col("event_id") / 2).cast("string"))
    return corpus.deduplicated_events(tables.events(spark, d).withColumn("call_id", call), ["ts", "event_id"]).select("event_id")


@_add("anonymous_call_ids", f"WITH {_EV} SELECT name, ok, count(*) AS n FROM ev GROUP BY ALL")
def anonymous_call_ids(spark, d):
    e = corpus.with_call_ids(tables.events(spark, d).withColumn("call_id", F.lit("")), ["kind", "name", "ts", "input", "output"])
    return e.groupBy("name", "ok").agg(F.count_distinct("session", "call_id").alias("n"))


@_add("model_backfill", """WITH k AS (SELECT id, session, turn, CASE WHEN trim(model) <> '' AND NOT starts_with(trim(model), '<') THEN trim(model) END AS m FROM msgs WHERE session IS NOT NULL AND turn IS NOT NULL),
s AS (SELECT session, min(m) AS one, count(DISTINCT m) AS n FROM k GROUP BY session),
w AS (SELECT k.*, one, n, last_value(m IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(m IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM k JOIN s USING (session))
SELECT id, CASE WHEN m IS NOT NULL THEN m WHEN n = 1 THEN one WHEN n > 1 AND (a IS NULL OR b IS NULL OR a = b) THEN coalesce(b, a) ELSE '' END AS model,
 CASE WHEN m IS NOT NULL THEN 'explicit' WHEN n = 0 THEN 'unknown' WHEN n = 1 THEN 'session' WHEN a IS NULL OR b IS NULL OR a = b THEN 'temporal_session' ELSE 'ambiguous_session' END AS model_source FROM w""")
def model_backfill(spark, d):
    rows = tables.msgs(spark, d).filter("session is not null and turn is not null")
    return corpus.attributed_models(rows).select("id", "model", "model_source")


@_add("exact_fold_documents", "SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def exact_fold_documents(spark, d):
    return tables.table(spark, d, "documents").filter("text is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@_add("row_diff_multiset", "WITH b AS (SELECT session, turn, who FROM msgs WHERE id % 3 > 0), a AS (SELECT session, turn, who FROM msgs WHERE id % 3 < 2) (SELECT 'insert' AS op, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT 'delete', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))")
def row_diff_multiset(spark, d):
    m = tables.msgs(spark, d)
    return corpus.row_difference(m.filter("id % 3 > 0"), m.filter("id % 3 < 2"), ["session", "turn", "who"])


@_add("changed_sessions", "WITH a AS (SELECT session, list_sort(list(hash(turn, who, text))) AS s FROM msgs GROUP BY session), b AS (SELECT session, list_sort(list(hash(turn, who, text))) AS s FROM msgs WHERE id % 997 <> 5 GROUP BY session) SELECT coalesce(a.session, b.session) AS session, CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.session IS NOT DISTINCT FROM b.session WHERE a.s IS DISTINCT FROM b.s")
def changed_sessions(spark, d):
    m = tables.msgs(spark, d)
    return corpus.changed_sessions(m, m.filter("id % 997 <> 5"))


@_add("refreshed_corpus", "SELECT id, session FROM msgs WHERE id % 997 <> 5")
def refreshed_corpus(spark, d):
    m = tables.msgs(spark, d)
    return corpus.refreshed(m, m.filter("id % 997 <> 5")).select("id", "session")


@_add("merged_transcript", "SELECT session, turn, arg_min(text, id) FILTER (who IN ('user', 'subagent')) AS prompt, arg_min(text, id) FILTER (who = 'agent') AS reply FROM msgs WHERE session IS NOT NULL AND turn IS NOT NULL GROUP BY ALL HAVING prompt IS NOT NULL OR reply IS NOT NULL")
def merged_transcript(spark, d):
    return corpus.merged_transcript(tables.msgs(spark, d))


@_add("boundary_stats", """WITH w AS (SELECT DISTINCT session AS root, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS word FROM msgs WHERE text IS NOT NULL AND session IS NOT NULL),
g AS (SELECT root, word, unnest(list_distinct(flatten([list_transform(range(1, length(word) - n + 2), lambda i: substr(word, i, n)) for n in [1, 2, 3, 4] if n <= length(word)]))) AS token FROM w WHERE word <> ''),
p AS (SELECT token, root, bool_or(token = word) AS aligned FROM g GROUP BY ALL) SELECT token, count(*) AS n, count(*) FILTER (aligned) AS s FROM p GROUP BY token""")
def boundary_stats(spark, d):
    m = tables.msgs(spark, d)
    return corpus.boundary_stats(m, m.select("session", F.col("session").alias("root")).distinct())


@_add("boundary_quality", f"SELECT id, {_word_quality('lock', 'text')}::DOUBLE AS q FROM msgs WHERE regexp_matches(text, '(?i)lock')".replace("…", ""))
def boundary_quality(spark, d):
    """How well the best occurrence of a word is aligned, over all texts."""
    return tables.msgs(spark, d).select("id", boundary.quality(F.col("text"), "lock").alias("q")).filter("q is not null")


# ---------------------------------------------------------------- families and context

@_add("family_roots", "SELECT session, coalesce(root, session) AS root FROM session_family")
def family_roots(spark, d):
    """Roots of the published closure, taken as links and closed again: a root is its own."""
    f = tables.families(spark, d)
    links = f.select(F.col("session").alias("node"), F.when(F.col("root") != F.col("session"), F.concat(F.lit("r:"), F.col("root"))).alias("parent"))
    return hierarchy.nested_sets(spark, links).select(F.col("node").alias("session"), F.regexp_replace("root", "^r:", "").alias("root"))


@_add("family_members", "SELECT coalesce(root, session) AS root, count(*) AS members, min(session) AS first FROM session_family GROUP BY ALL")
def family_members(spark, d):
    return tables.families(spark, d).groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.min("session").alias("first"))


_CENTRES = "c AS (SELECT session, max(turn) AS turn FROM msgs WHERE turn IS NOT NULL AND session IS NOT NULL GROUP BY session)"


@_add("context_window", f"WITH {_CENTRES} SELECT m.id, c.turn AS centre FROM msgs m JOIN c USING (session) WHERE m.turn BETWEEN c.turn - 2 AND c.turn + 2")
def context_window(spark, d):
    m = tables.msgs(spark, d)
    centres = m.filter("session is not null").groupBy("session").agg(F.max("turn").alias("turn")).filter("turn is not null")
    return context.windows(m, centres, 2).select("id", "centre")


@_add("windows_batch", "WITH c AS (SELECT DISTINCT session, turn FROM msgs WHERE regexp_matches(text, '(?i)lease') AND turn IS NOT NULL AND session IS NOT NULL) SELECT m.id, c.turn AS centre FROM msgs m JOIN c ON m.session = c.session AND m.turn BETWEEN c.turn - 1 AND c.turn + 1 WHERE m.who IS NULL OR m.who <> 'tool'")
def windows_batch(spark, d):
    m = tables.msgs(spark, d)
    centres = m.filter(fx.has(F.col("text"), "lease") & F.col("turn").isNotNull() & F.col("session").isNotNull()).select("session", "turn").distinct()
    prose = m.filter(F.coalesce(F.col("who") != "tool", F.lit(True)))
    spread = centres.select("session", F.col("turn").alias("centre"), F.explode(F.sequence(F.col("turn") - 1, F.col("turn") + 1)).alias("turn"))
    return prose.join(spread, ["session", "turn"]).select("id", "centre")


@_add("nearest_turn", "WITH t AS (SELECT DISTINCT session, turn FROM msgs WHERE turn IS NOT NULL AND session IS NOT NULL) SELECT session, 7 AS asked, arg_min(turn, (abs(turn - 7), turn)) AS turn FROM t GROUP BY session")
def nearest_turn(spark, d):
    m = tables.msgs(spark, d)
    return context.nearest_turns(m, m.filter("session is not null").select("session").distinct().withColumn("turn", F.lit(7)))


_MARKS = "marks AS (SELECT session, min(ts) AS ts, turn FROM (SELECT 'u-' || user_id AS session, (epoch_us(ts) // 1000) AS ts, CAST(floor(value / 10) AS INT) AS turn FROM events WHERE event_type = 'purchase') GROUP BY ALL)"


def _marks(spark, d):
    e = tables.table(spark, d, "events").filter("event_type = 'purchase'")
    rows = e.select(F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("session"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.floor(F.col("value") / 10).cast("int").alias("turn"))
    return rows.groupBy("session", "turn").agg(F.min("ts").alias("ts"))


@_add("asof_event_turn", f"WITH {_EV}, {_MARKS}, f AS (SELECT session, arg_min(turn, (ts, turn)) AS first FROM marks GROUP BY session), l AS (SELECT session, ts, max(turn) AS turn FROM marks GROUP BY ALL) SELECT e.event_id, coalesce(l.turn, f.first) AS turn FROM ev e ASOF LEFT JOIN l ON e.session = l.session AND e.ts >= l.ts LEFT JOIN f ON e.session = f.session")
def asof_event_turn(spark, d):
    return context.attributed_events(tables.events(spark, d), _marks(spark, d)).select("event_id", "turn")


@_add("event_intervals", f"WITH {_MARKS}, l AS (SELECT session, ts, max(turn) AS turn FROM marks GROUP BY ALL) SELECT session, turn, ts AS start, lead(ts) OVER (PARTITION BY session ORDER BY ts) AS \"end\" FROM l")
def event_intervals(spark, d):
    return context.intervals(_marks(spark, d))


@_add("interval_owners", f"WITH {_EV}, {_MARKS}, l AS (SELECT session, ts, max(turn) AS turn FROM marks GROUP BY ALL) SELECT e.event_id, l.turn FROM ev e ASOF JOIN l ON e.session = l.session AND e.ts >= l.ts")
def interval_owners(spark, d):
    return context.owned_events(tables.events(spark, d), _marks(spark, d)).select("event_id", "turn")


@_add("latest_per_session", "SELECT session, arg_max(id, (coalesce(turn, -1), coalesce(ts, 0), id)) AS id FROM msgs WHERE regexp_matches(text, '[^\\s\\p{Z}]') AND session IS NOT NULL GROUP BY session")
def latest_per_session(spark, d):
    return context.latest_rows(tables.msgs(spark, d)).select("session", "id")


@_add("chats_list", "SELECT session, min(agent) AS agent, count(*) AS rows, coalesce(max(ts) FILTER (ts > 0), 0) AS last_ts FROM msgs WHERE session IS NOT NULL GROUP BY session ORDER BY last_ts DESC, session DESC LIMIT 40")
def chats_list(spark, d):
    return context.chats(tables.msgs(spark, d)).select("session", "agent", "rows", "last_ts")


@_add("chats_topic", """SELECT session, count(*) FILTER (contains(lower(text), 'tern') AND contains(lower(text), 'index')) AS text_rows FROM msgs WHERE session IS NOT NULL GROUP BY session
HAVING bool_or(contains(lower(concat_ws(' ', session, agent, project, concept)), 'tern') AND contains(lower(concat_ws(' ', session, agent, project, concept)), 'index')) OR text_rows > 0""")
def chats_topic(spark, d):
    return context.chats_about(tables.msgs(spark, d), "tern index", None).select("session", "text_rows")


_HOT = "(SELECT session FROM msgs WHERE who = 'recap' AND session IS NOT NULL GROUP BY session ORDER BY max(turn) DESC NULLS LAST, session LIMIT 1)"


@_add("postcompact_tail", f"""WITH o AS (SELECT * FROM msgs WHERE session = {_HOT}), r AS (SELECT max(turn) AS hi, list_reverse_sort(list_distinct(list(turn)))[2] AS lo FROM o WHERE who = 'recap'),
t AS (SELECT o.*, dense_rank() OVER (ORDER BY turn DESC) AS block FROM o, r WHERE who IN ('user', 'agent') AND turn < coalesce(hi, 2147483647) AND turn > coalesce(lo, -1)) SELECT id, turn, CAST(block AS INT) AS block FROM t WHERE block <= 8""")
def postcompact_tail(spark, d):
    m = tables.msgs(spark, d)
    hot = m.filter("who = 'recap' and session is not null").groupBy("session").agg(F.max("turn").alias("n")).orderBy(F.desc_nulls_last("n"), "session").first()
    return context.compaction_tail(m, hot["session"] if hot else "").select("id", "turn", F.col("block").cast("int").alias("block"))


@_add("tool_runs", """WITH i AS (SELECT *, coalesce(who = 'tool', false) AS tool, row_number() OVER (PARTITION BY session ORDER BY turn, id) - row_number() OVER (PARTITION BY session, coalesce(who = 'tool', false) ORDER BY turn, id) AS isl FROM msgs WHERE session IS NOT NULL AND turn IS NOT NULL)
SELECT session, min(id) AS first_id, count(*) AS rows, min(turn) AS first_turn, max(turn) AS last_turn FROM i WHERE tool GROUP BY session, isl HAVING count(*) >= 3""")
def tool_runs(spark, d):
    return context.tool_runs(tables.msgs(spark, d), 3)


@_add("session_models", "SELECT session, model, turns FROM (SELECT session, model, count(DISTINCT turn) AS turns, row_number() OVER (PARTITION BY session ORDER BY count(DISTINCT turn) DESC, model) AS rn FROM msgs WHERE session IS NOT NULL AND trim(model) <> '' AND NOT starts_with(model, '<') GROUP BY session, model) WHERE rn = 1")
def session_models(spark, d):
    return context.session_models(tables.msgs(spark, d))


_ASKED = "a AS (SELECT DISTINCT session, CASE WHEN id % 2 = 0 THEN turn ELSE turn + 1 END AS turn, content_digest AS digest FROM msgs WHERE content_digest IS NOT NULL AND turn IS NOT NULL AND session IS NOT NULL)"


@_add("handle_resolve", f"""WITH {_ASKED}, t AS (SELECT DISTINCT session, turn AS at_turn, content_digest AS digest FROM msgs WHERE content_digest IS NOT NULL AND turn IS NOT NULL)
SELECT session, turn, digest, CASE WHEN h THEN 'verified' WHEN n = 1 THEN 'moved' WHEN n > 1 THEN 'ambiguous' ELSE 'absent' END AS verdict, CASE WHEN h THEN turn WHEN n = 1 THEN one END AS found
FROM (SELECT a.session, a.turn, a.digest, bool_or(at_turn = a.turn) AS h, count(at_turn) AS n, min(at_turn) AS one FROM a LEFT JOIN t USING (session, digest) GROUP BY ALL)""")
def handle_resolve(spark, d):
    m = tables.msgs(spark, d)
    asked = m.filter("content_digest is not null and turn is not null and session is not null").select("session", F.when(F.col("id") % 2 == 0, F.col("turn")).otherwise(F.col("turn") + 1).alias("turn"), F.col("content_digest").alias("digest")).distinct()
    return context.resolved(m, asked)


@_add("handles_round_trip", "SELECT id, session, turn, content_digest AS digest FROM msgs WHERE content_digest IS NOT NULL AND turn IS NOT NULL AND session IS NOT NULL")
def handles_round_trip(spark, d):
    m = tables.msgs(spark, d).filter("content_digest is not null and turn is not null and session is not null")
    return m.select("id", fx.parse_handle(fx.handle(F.col("session"), F.col("turn"), F.col("content_digest"))).alias("h")).select("id", "h.*")


@_add("shortest_prefix", "WITH s AS (SELECT DISTINCT session FROM msgs WHERE session IS NOT NULL), p AS (SELECT session, n, substr(session, 1, n) AS p FROM s, (SELECT unnest(range(4, 30)) AS n)), u AS (SELECT p, n FROM p GROUP BY ALL HAVING count(*) = 1) SELECT session, arg_min(p.p, p.n) AS prefix FROM p JOIN u USING (p, n) GROUP BY session")
def shortest_prefix(spark, d):
    return context.shortest_prefixes(tables.msgs(spark, d))


@_add("session_lookup", "SELECT DISTINCT session FROM msgs WHERE starts_with(session, '34')")
def session_lookup(spark, d):
    return context.find_session(tables.msgs(spark, d), "34")


# ---------------------------------------------------------------- accounting

_REC = "rec AS (SELECT agent, path, CASE WHEN content_hash IS NULL AND len = 0 THEN 'error' WHEN content_hash IS NULL THEN 'skip' WHEN len > 10000 THEN 'row' WHEN len > 3000 THEN 'agent_row' ELSE 'event' END AS outcome, CASE WHEN mtime_nanos = 0 THEN 'coarse time' ELSE 'no hash' END AS reason FROM source_files)"


def _records(spark, d):
    f = tables.table(spark, d, "source_files")
    outcome = F.when(F.col("content_hash").isNull() & (F.col("len") == 0), "error").when(F.col("content_hash").isNull(), "skip").when(F.col("len") > 10000, "row").when(F.col("len") > 3000, "agent_row").otherwise("event")
    return f.select("agent", "path", outcome.alias("outcome"), F.when(F.col("mtime_nanos") == 0, "coarse time").otherwise("no hash").alias("reason"))


@_add("intake_tallies", f"WITH {_REC} SELECT agent, count(*) AS seen, count(*) FILTER (outcome = 'row') AS row, count(*) FILTER (outcome = 'agent_row') AS agent_row, count(*) FILTER (outcome = 'event') AS event, count(*) FILTER (outcome = 'skip') AS skip, count(*) FILTER (outcome = 'error') AS error FROM rec GROUP BY agent")
def intake_tallies(spark, d):
    return accounting.tallies(_records(spark, d), ["agent"])


@_add("intake_skips", f"WITH {_REC} SELECT agent, reason, count(*) AS n FROM rec WHERE outcome = 'skip' GROUP BY ALL")
def intake_skips(spark, d):
    return accounting.skips(_records(spark, d), ["agent"])


@_add("audit_accounting", "WITH f AS (SELECT agent, path, count(*) AS found FROM source_files WHERE run_no = 7 GROUP BY ALL), b AS (SELECT agent, path, count(*) AS booked FROM source_files WHERE run_no = 4 GROUP BY ALL) SELECT agent, path, found, booked, CASE WHEN booked IS NULL THEN 'missing' WHEN found IS NULL THEN 'stale' WHEN found <> booked THEN 'short' ELSE 'ok' END AS verdict FROM f FULL JOIN b USING (agent, path)")
def audit_accounting(spark, d):
    n = tables.table(spark, d, "source_files").groupBy("run_no", "agent", "path").agg(F.count(F.lit(1)).alias("n"))
    return accounting.audit(n.filter("run_no = 7"), n.filter("run_no = 4"), ["agent", "path"])


@_add("completeness", "SELECT agent, count(*) AS total, count(*) FILTER (turn IS NOT NULL) AS kept, round(count(*) FILTER (turn IS NOT NULL) / count(*), 6) AS share FROM msgs WHERE agent IS NOT NULL GROUP BY agent")
def completeness(spark, d):
    m = tables.msgs(spark, d).filter("agent is not null")
    return accounting.completeness(m, m.filter("turn is not null"))


# ---------------------------------------------------------------- live state

def live_events(spark, d):
    """The event table as a live feed."""
    e = tables.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "user").when(F.col("event_type") == "view", "tool").when(F.col("event_type") == "click", "tool_done").when(F.col("event_type") == "error", "reply").otherwise("done")
    return e.select(
        F.lit("claude").alias("agent"), F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("session"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), kind.alias("type"), F.col("event_type").alias("name"),
        (F.floor("value") % 5).cast("string").alias("call_id"), F.col("props").alias("text"), F.lit(None).cast("string").alias("project"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("op"), F.lit(None).cast("string").alias("why"), F.col("event_id").alias("seq"),
    )


_LIVE = "l AS (SELECT 'u-' || user_id AS session, (epoch_us(ts) // 1000) AS ts, CASE event_type WHEN 'signup' THEN 'user' WHEN 'view' THEN 'tool' WHEN 'click' THEN 'tool_done' WHEN 'error' THEN 'reply' ELSE 'done' END AS type, event_id FROM events)"


@_add("live_snapshot", f"WITH {_LIVE} SELECT session, arg_max(type, (ts, event_id)) <> 'done' AS working, CAST(count(*) FILTER (type = 'user') AS INT) AS turns, max(ts) AS last_ts FROM l GROUP BY session")
def live_snapshot(spark, d):
    return live.fold_table(live_events(spark, d)).select("session", "working", "turns", "last_ts")


_LIVE_STATES = """WITH l AS (SELECT 'u-' || user_id AS session, (epoch_us(ts) // 1000) AS ts, CASE event_type WHEN 'signup' THEN 'user' WHEN 'view' THEN 'tool' WHEN 'click' THEN 'tool_done' WHEN 'error' THEN 'reply' ELSE 'done' END AS type,
  event_type AS name, CAST(floor(value) AS BIGINT) % 5 AS call, trim(regexp_replace(props, '[\\s\\p{Z}]+', ' ', 'g')) AS told, event_id FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS n FROM l),
w AS (SELECT session, arg_max(type, n) AS label, coalesce(max(n) FILTER (type IN ('user', 'done')), 0) AS cleared, coalesce(arg_max(told, n) FILTER (type IN ('user', 'reply') AND told <> ''), '') AS last_text FROM o GROUP BY session),
c AS (SELECT session, arg_max(type, n) AS type, arg_max(name, n) AS name, max(n) AS n FROM o WHERE type IN ('tool', 'tool_done') GROUP BY session, call),
p AS (SELECT session, count(*) AS pending, arg_max(name, c.n) AS newest FROM c JOIN w USING (session) WHERE type = 'tool' AND c.n > cleared GROUP BY session)
SELECT session, CASE label WHEN 'user' THEN 'thinking' WHEN 'reply' THEN 'replying' WHEN 'done' THEN 'done' ELSE CASE WHEN pending IS NULL THEN 'thinking' WHEN pending > 1 THEN '⚙ ' || newest || ' +' || (pending - 1) ELSE '⚙ ' || newest END END AS state,
 CAST(coalesce(pending, 0) AS INT) AS pending, CAST(0 AS INT) AS queued, last_text FROM w LEFT JOIN p USING (session)"""


@_add("live_states", _LIVE_STATES)
def live_states(spark, d):
    return live.fold_table(live_events(spark, d)).select("session", "state", "pending", "queued", "last_text")


@_add("live_stalled", f"WITH {_LIVE}, s AS (SELECT session, arg_max(type, (ts, event_id)) <> 'done' AS w, max(ts) AS last_ts FROM l GROUP BY session) SELECT session, w AND ({schema.NOW_MS} - last_ts) <= 900000 AS working, ({schema.NOW_MS} - last_ts) <= 90000 AS active FROM s WHERE NOT (w AND ({schema.NOW_MS} - last_ts) <= 900000)")
def live_stalled(spark, d):
    return live.decayed(live.fold_table(live_events(spark, d)), schema.NOW_MS).filter("not working").select("session", "working", "active")


@_add("live_tail_filter", f"WITH {_LIVE} SELECT session, type, event_id AS seq FROM l WHERE contains(session, '-1') AND type IN ('user', 'done')")
def live_tail_filter(spark, d):
    return live.tail(live_events(spark, d), agent="CLAU", session="-1", types=("user", "done")).select("session", "type", "seq")


@_add("live_history", f"WITH {_LIVE}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS rn FROM l) SELECT session, event_id AS seq FROM r WHERE rn <= 20 ORDER BY ts DESC, event_id DESC LIMIT 600")
def live_history(spark, d):
    return live.history(live_events(spark, d), 20, 600).select("session", "seq")


@_add("live_stream_fold", f"WITH {_LIVE} SELECT session, arg_max(type, (ts, event_id)) <> 'done' AS working, CAST(count(*) FILTER (type = 'user') AS INT) AS turns, max(ts) AS last_ts FROM l GROUP BY session")
def live_stream_fold(spark, d):
    """The stream's result when it has read everything: the last state that it wrote for each session."""
    from tracelode.plans.workspace import Workspace

    work = Workspace(spark, "stream")
    feed = work.save(live_events(spark, d), "feed")
    stream = spark.readStream.schema(feed.schema).parquet(feed._tracelode_path)
    out = f"{work.path}/out"

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    live.fold_stream(stream).writeStream.outputMode("update").option("checkpointLocation", f"{work.path}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{live.OUT}, batch long").parquet(out)
    return rows.groupBy("session").agg(F.max_by(F.struct("working", "turns", "last_ts"), "batch").alias("r")).select("session", "r.*")
