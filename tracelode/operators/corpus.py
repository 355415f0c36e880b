"""Building the corpus: messages, replies, sessions, events and the flattened search rows, and keeping them current.

Defined results: null keys group together; blank call ids never merge; an unknown time is 0 and never first or last; ties are
decided by the listed columns and finally by the id, so that every result is the same at every run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode import schema
from tracelode.functions import text as fx


def message_id(agent: str = "agent", session: str = "session", turn: str = "turn") -> Column:
    return F.concat_ws(":", agent, session, F.col(turn).cast("string"))


def replies(messages: DataFrame) -> DataFrame:
    """(mid, reply, content_digest, reply_chars, reply_truncated) of the replies that say something."""
    n = F.when(F.coalesce("reply_chars", F.lit(0)) > 0, F.col("reply_chars")).otherwise(F.length("reply")).cast("bigint")
    return messages.filter(F.col("reply").rlike(r"[^\s\p{Z}]")).select(message_id().alias("mid"), "reply", fx.digest(F.col("reply")).alias("content_digest"), n.alias("reply_chars"), (n > schema.REPLY_CAP).alias("reply_truncated"))


def sessions(messages: DataFrame) -> DataFrame:
    """One row a session: rows, first and last known time, opening line and first parent claim."""
    known = F.when(F.col("ts") > 0, F.col("ts"))
    line = F.substring(fx.one_line(F.col("text")), 1, schema.FIRST_TEXT_CAP)
    at = F.struct("turn", "rm_id")
    opening = F.when(F.coalesce(F.col("who") != "recap", F.lit(True)), line) if "who" in messages.columns else line
    claim = F.lower(F.trim("parent"))
    return messages.groupBy("session").agg(
        F.min("agent").alias("agent"), F.min_by("project", at).alias("project"), F.count(F.lit(1)).alias("n"), F.coalesce(F.min(known), F.lit(0)).alias("first_ts"), F.coalesce(F.max(known), F.lit(0)).alias("last_ts"),
        F.min_by(opening, F.when(opening.isNotNull(), at)).alias("first_text"), F.min_by(claim, F.when(claim != "", at)).alias("parent"),
    )


def tool_text(name: Column, kind: Column, ok: Column, payload: Column, output: Column) -> Column:
    """The searchable text of a tool call; empty for control events."""
    title = F.trim(F.concat(F.when(kind == "subagent_start", "subagent ").when(kind == "subagent_result", "subagent result ").otherwise(""), F.trim(F.coalesce(name, F.lit("")))))
    title = F.concat(title, F.when(ok == False, " [failed]").otherwise(""))  # noqa: E712
    head = F.concat_ws(": ", F.when(title != "", title), F.when(F.trim(payload) != "", F.trim(payload)))
    return F.when(kind == "control", "").otherwise(F.trim(F.when(F.coalesce(output, F.lit("")) != "", F.concat(head, F.lit("\n"), output)).otherwise(head)))


def flatten(messages: DataFrame, events: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Search rows without ids: prompts with their role, replies as agent, attributed tool events as tool.

    ``events`` must already have a turn; tool rows need a session with messages of the same agent.
    """
    common = ["session", "turn", "ts", "agent", "project"]
    prompts = messages.filter(F.col("text") != "").select(*common, "model", "model_source", F.coalesce("who", F.lit("user")).alias("who"), "text")
    answers = messages.filter(F.col("reply") != "").select(*common, "model", "model_source", F.lit("agent").alias("who"), F.col("reply").alias("text"))
    rows = prompts.unionByName(answers)
    if events is not None:
        owners = messages.groupBy("agent", "session").agg(F.min_by("project", "turn").alias("project"))
        tools = events.withColumn("text", tool_text(F.col("name"), F.col("kind"), F.col("ok"), F.col("input"), F.col("output"))).filter("text != ''").join(owners, ["agent", "session"])
        rows = rows.unionByName(tools.select(*common, F.lit("").alias("model"), F.lit("tool").alias("model_source"), F.lit("tool").alias("who"), "text"))
    rows = rows.withColumn("content_digest", fx.digest(F.col("text")))
    return rows.withColumn("concept", F.lit(None).cast("string")) if labels is None else rows.join(labels.select("session", "concept"), "session", "left")


def attributed_models(rows: DataFrame) -> DataFrame:
    """Fills missing models: explicit, the session's only one, the one on both (or the only known) sides, else ambiguous or unknown.

    The nearest known models before and after are running frames over the session's order and over its mirror image, as a frame that
    ends at the last row is counted anew for every row; no join.  Rows with one turn and id are ordered by their model, unknown first.
    """
    model = F.when((F.trim("model") != "") & ~F.startswith(F.trim("model"), F.lit("<")), F.trim("model"))
    order = ["turn", "id", "__m"]
    w, mirror = Window.partitionBy("session").orderBy(*order), Window.partitionBy("session").orderBy(*map(F.desc, order))
    whole, earlier = (Window.unboundedPreceding, Window.unboundedFollowing), (Window.unboundedPreceding, -1)
    near = rows.withColumn("__m", model).withColumn("__after", F.last("__m", ignorenulls=True).over(mirror.rowsBetween(*earlier)))
    near = near.withColumns({"__before": F.last("__m", ignorenulls=True).over(w.rowsBetween(*earlier)), "__one": F.min("__m").over(w.rowsBetween(*whole)), "__most": F.max("__m").over(w.rowsBetween(*whole))})
    single = F.col("__one") == F.col("__most")
    agree = F.col("__before").isNull() | F.col("__after").isNull() | (F.col("__before") == F.col("__after"))
    source = F.when(F.col("__m").isNotNull(), "explicit").when(F.col("__one").isNull(), "unknown").when(single, "session").when(agree, "temporal_session").otherwise("ambiguous_session")
    filled = F.when(F.col("__m").isNotNull(), F.col("__m")).when(single, F.col("__one")).when(agree, F.coalesce("__before", "__after", F.lit(""))).otherwise("")
    return near.withColumn("model", filled).withColumn("model_source", source).drop("__m", "__one", "__most", "__before", "__after")


def deduplicated(messages: DataFrame) -> DataFrame:
    """One message of each (agent, session, turn, text): the one that knows most.

    The best by reply length, known time, model and parent, then the earliest row: an aggregate, so copies combine before the
    shuffle and a message delivered a million times meets nowhere.
    """
    keys = ["agent", "session", "turn", "text"]
    rest = [c for c in messages.columns if c not in keys]
    known = F.struct(
        F.length(F.coalesce("reply", F.lit(""))), (F.coalesce("ts", F.lit(0)) > 0).cast("int"), (F.coalesce(F.trim("model"), F.lit("")) != "").cast("int"),
        (F.coalesce(F.trim("parent"), F.lit("")) != "").cast("int"), -F.coalesce("ts", F.lit(0)), -F.col("rm_id"),
    )
    return messages.groupBy(*keys).agg(F.max_by(F.struct(*rest), known).alias("r")).select(*keys, "r.*")


def renumbered(messages: DataFrame, id_col: str = "rm_id") -> DataFrame:
    """Sessions in which a turn number occurs twice get new turns by (unknown time last, time, turn, text)."""
    clash = messages.groupBy("agent", "session", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("agent", "session").agg((F.max("n") > 1).alias("clash"))
    rows = messages.join(clash, ["agent", "session"])
    w = Window.partitionBy("agent", "session").orderBy((F.coalesce("ts", F.lit(0)) <= 0).cast("int"), "ts", "turn", "text", id_col)
    fixed = rows.filter("clash").withColumn("turn", (F.row_number().over(w) - 1).cast("int"))  # only broken sessions are sorted
    return fixed.unionByName(rows.filter("not clash")).drop("clash")


def deduplicated_events(events: DataFrame, order: list[str]) -> DataFrame:
    """First event of each (agent, session, call_id); events without a call id all stay."""
    named = events.filter(F.trim("call_id") != "")
    rest = [c for c in events.columns if c not in ("agent", "session", "call_id")]
    first = named.groupBy("agent", "session", "call_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select("agent", "session", "call_id", "r.*")
    return first.unionByName(events.filter(F.coalesce(F.trim("call_id") == "", F.lit(True))).select(*first.columns))


def with_call_ids(events: DataFrame, columns: list[str]) -> DataFrame:
    """Anonymous events get an id from their content and their ordinal among identical ones."""
    mark = F.hex(F.xxhash64(*columns))
    w = Window.partitionBy("agent", "session", *columns).orderBy(*columns)
    blank = F.coalesce(F.trim("call_id") == "", F.lit(True))
    numbered = events.filter(blank).withColumn("call_id", F.concat(mark, F.lit("-"), F.row_number().over(w).cast("string")))
    return events.filter(~blank).unionByName(numbered)


def event_stats(events: DataFrame, by_name: bool = False) -> DataFrame:
    """Calls, failures, calls with a known outcome and subagent starts by agent, optionally also by tool."""
    keys = ["agent", "name"] if by_name else ["agent"]
    call = F.col("kind") == "tool"
    return events.groupBy(*keys).agg(F.count_if(call).alias("calls"), F.count_if(call & (F.col("ok") == False)).alias("fails"), F.count_if(call & F.col("ok").isNotNull()).alias("known"), F.count_if(F.col("kind") == "subagent_start").alias("subagents"))  # noqa: E712


def session_signatures(rows: DataFrame) -> DataFrame:
    """(session, signature): a digest of a session's rows that doesn't depend on their order.

    Row hashes are added up, so a session of any size is one running sum and is never collected.
    """
    row = F.xxhash64(F.coalesce(F.col("turn").cast("string"), F.lit("")), F.coalesce("who", F.lit("")), F.coalesce("text", F.lit("")))
    return rows.groupBy("session").agg(F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(20,0)")).alias("s")).select("session", F.concat_ws("-", F.col("rows").cast("string"), F.col("s").cast("string")).alias("signature"))


def changed_sessions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(session, change): added, removed or changed by their signatures."""
    a, b = session_signatures(before), session_signatures(after)
    both = a.alias("a").join(b.alias("b"), F.col("a.session").eqNullSafe(F.col("b.session")), "full_outer")
    change = F.when(F.col("a.signature").isNull(), "added").when(F.col("b.signature").isNull(), "removed").when(F.col("a.signature") != F.col("b.signature"), "changed")
    return both.select(F.coalesce("a.session", "b.session").alias("session"), change.alias("change")).filter("change is not null")


def row_difference(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(op, columns...): rows to insert and to delete, counting repeated rows."""
    plus = after.select(*columns).exceptAll(before.select(*columns)).withColumn("op", F.lit("insert"))
    return plus.unionByName(before.select(*columns).exceptAll(after.select(*columns)).withColumn("op", F.lit("delete")))


def refreshed(before: DataFrame, after: DataFrame) -> DataFrame:
    """The corpus with only the sessions that changed replaced."""
    changed = changed_sessions(before, after).select("session")
    keep = before.join(changed, before["session"].eqNullSafe(changed["session"]), "left_anti")
    new = after.join(changed, after["session"].eqNullSafe(changed["session"]), "left_semi")
    return keep.unionByName(new.select(*before.columns))


def boundary_stats(rows: DataFrame, families: DataFrame, most: int = 4) -> DataFrame:
    """(token, n, s): for each run of up to ``most`` letters or digits, the families that contain it and those where it stands
    as a whole word.  ASCII rows are exploded natively; distinct (token, family) pairs are made before they are counted."""
    low = rows.filter(F.col("text").isNotNull() & F.col("session").isNotNull()).join(families.select("session", "root"), "session", "left").select(F.coalesce("root", "session").alias("root"), F.explode(F.array_distinct(F.split(F.lower("text"), r"[^a-z0-9]+"))).alias("word")).filter("word != ''").distinct()

    def runs(n: int) -> Column:
        all_of = F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - n + 1, F.lit(1))), lambda i: F.substring("word", i, F.lit(n)))
        return F.when(F.length("word") >= n, all_of).otherwise(F.array().cast("array<string>"))

    sizes = [runs(n) for n in range(1, most + 1)]
    exploded = low.select("root", "word", F.explode(F.array_distinct(F.flatten(F.array(*sizes)))).alias("token"))
    pairs = exploded.groupBy("token", "root").agg(F.max(F.col("token") == F.col("word")).alias("aligned"))
    return pairs.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("aligned").alias("s"))


def merged_transcript(rows: DataFrame) -> DataFrame:
    """One row a turn: the first prompt-side row and the first reply."""
    prompt = F.col("who").isin("user", "subagent")
    return rows.filter(F.col("session").isNotNull() & F.col("turn").isNotNull()).groupBy("session", "turn").agg(
        F.min_by("text", F.when(prompt, F.col("id"))).alias("prompt"), F.min_by("text", F.when(F.col("who") == "agent", F.col("id"))).alias("reply")).filter("prompt is not null or reply is not null")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
