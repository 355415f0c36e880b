"""Context around hits: turn windows, as-of attribution, intervals, compaction tails, tool runs, addresses, chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions import text as fx


def transcript_order() -> list[Column]:
    side = F.when(F.col("who") == "user", 0).when(F.col("who") == "agent", 1).when(F.col("who") == "tool", 2).otherwise(0)
    return [F.col("turn"), side, F.coalesce("ts", F.lit(0)), F.col("id")]


def nearest_turns(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(session, asked, turn): for each asked (session, turn) the nearest turn that exists, the lower of two."""
    turns = rows.filter(F.col("turn").isNotNull()).select("session", F.col("turn").alias("there")).distinct()
    near = asked.select("session", F.col("turn").alias("asked")).distinct().join(turns, "session")
    return near.groupBy("session", "asked").agg(F.min_by("there", F.struct(F.abs(F.col("there") - F.col("asked")), "there")).alias("turn"))


def windows(rows: DataFrame, centres: DataFrame, radius: int) -> DataFrame:
    """Rows within ``radius`` turns of each (session, turn): the centres are exploded to their turns, so this is an equi-join.

    A row is returned once for each centre, as ``centre``.
    """
    near = nearest_turns(rows, centres).select("session", F.col("turn").alias("centre")).distinct()
    spread = near.select("session", "centre", F.explode(F.sequence(F.col("centre") - radius, F.col("centre") + radius)).alias("turn"))
    return rows.join(spread, ["session", "turn"])


def attributed_events(events: DataFrame, marks: DataFrame) -> DataFrame:
    """As-of join: each event (session, ts, event_id) gets the turn of the last mark (session, ts, turn) not after it.

    An unknown or earlier time gets the first mark's turn.  Marks and events are merged in one order and carried forward.
    """
    m = marks.select("session", F.coalesce("ts", F.lit(0)).alias("ts"), "turn", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("event_id"))
    e = events.select("session", F.coalesce("ts", F.lit(0)).alias("ts"), F.lit(None).cast("int").alias("turn"), F.lit(1).alias("kind"), F.col("event_id").cast("bigint").alias("event_id"))
    w = Window.partitionBy("session").orderBy("ts", "kind", "turn", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    carried = m.unionByName(e).withColumn("at", F.last("turn", ignorenulls=True).over(w)).filter("kind = 1")
    first = m.groupBy("session").agg(F.min_by("turn", F.struct("ts", "turn")).alias("first"))
    known = carried.join(first, "session", "left")
    return known.select("event_id", "session", F.when(F.col("ts") <= 0, F.col("first")).otherwise(F.coalesce("at", "first")).alias("turn"))


def intervals(marks: DataFrame) -> DataFrame:
    """(session, turn, start, end): half-open time of each turn; of turns with the same time the last owns it; end null is open."""
    at = marks.groupBy("session", F.coalesce("ts", F.lit(0)).alias("start")).agg(F.max("turn").alias("turn"))
    return at.select("session", "turn", "start", F.lead("start").over(Window.partitionBy("session").orderBy("start")).alias("end"))


def owned_events(events: DataFrame, marks: DataFrame) -> DataFrame:
    """(event_id, session, turn) of the events within an interval, through the as-of order rather than a range join."""
    owned = attributed_events(events, intervals(marks).select("session", F.col("start").alias("ts"), "turn"))
    begins = marks.groupBy("session").agg(F.min(F.coalesce("ts", F.lit(0))).alias("b"))
    return owned.join(events.select(F.col("event_id").cast("bigint").alias("event_id"), F.coalesce("ts", F.lit(0)).alias("ts")), "event_id").join(begins, "session").filter(F.col("ts") >= F.col("b")).select("event_id", "session", "turn")


def compaction_tail(rows: DataFrame, session: str, blocks: int = 8) -> DataFrame:
    """What was said between the last two recaps of a session: people and agents, the last ``blocks`` turns, numbered from 1."""
    own = rows.filter(F.col("session") == session)
    recaps = own.filter(F.col("who") == "recap").agg(F.max("turn").alias("hi"), F.expr("get(sort_array(collect_set(turn), false), 1)").alias("lo"))  # one session's recaps
    said = own.filter(F.col("who").isin("user", "agent")).join(F.broadcast(recaps)).filter((F.col("turn") < F.coalesce("hi", F.lit(2**31 - 1))) & (F.col("turn") > F.coalesce("lo", F.lit(-1))))
    return said.withColumn("block", F.dense_rank().over(Window.partitionBy("session").orderBy(F.desc("turn")))).filter(F.col("block") <= blocks).drop("hi", "lo")


def tool_runs(rows: DataFrame, least: int = 5) -> DataFrame:
    """(session, first_id, rows, first_turn, last_turn): stretches of ``least`` or more tool rows without other rows between."""
    w = Window.partitionBy("session").orderBy("turn", "id")
    islands = rows.filter(F.col("session").isNotNull() & F.col("turn").isNotNull()).withColumn("tool", F.coalesce(F.col("who") == "tool", F.lit(False))).withColumn("place", F.row_number().over(w))
    own = Window.partitionBy("session", "tool").orderBy("turn", "id")
    runs = islands.withColumn("island", F.col("place") - F.row_number().over(own)).filter("tool").groupBy("session", "island").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("rows"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    return runs.filter(F.col("rows") >= least).drop("island")


def latest_rows(rows: DataFrame) -> DataFrame:
    """The last row with text of each session, by turn, time and id: an aggregate, not a sort."""
    said = rows.filter(F.col("text").rlike(r"[^\s\p{Z}]") & F.col("session").isNotNull())
    return said.groupBy("session").agg(F.max_by(F.struct("id", "turn", "who", "text"), F.struct(F.coalesce("turn", F.lit(-1)), F.coalesce("ts", F.lit(0)), "id")).alias("r")).select("session", "r.*")


def session_models(rows: DataFrame) -> DataFrame:
    """(session, model, turns): the model in most turns of a session, the first by name of several; placeholders don't count."""
    real = rows.filter(F.col("session").isNotNull() & (F.trim("model") != "") & ~F.startswith("model", F.lit("<")))
    n = real.groupBy("session", "model").agg(F.count_distinct("turn").alias("turns"))
    best = n.withColumn("rn", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("turns"), "model")))
    return best.filter("rn = 1").drop("rn")


def chats(rows: DataFrame, limit: int | None = 40, sides: DataFrame | None = None) -> DataFrame:
    """(session, agent, project, rows, first_ts, last_ts), newest first; ``sides`` (session, side) hides side chats."""
    known = F.when(F.col("ts") > 0, F.col("ts"))
    out = rows.filter(F.col("session").isNotNull()).groupBy("session").agg(F.min("agent").alias("agent"), F.min("project").alias("project"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.min(known), F.lit(0)).alias("first_ts"), F.coalesce(F.max(known), F.lit(0)).alias("last_ts"))
    if sides is not None:
        out = out.join(sides.filter(F.col("side") == 1).select("session"), "session", "left_anti")
    ordered = out.orderBy(F.desc("last_ts"), F.desc("session"))
    return ordered.limit(limit) if limit else ordered


def chats_about(rows: DataFrame, topic: str, limit: int | None = 40) -> DataFrame:
    """Chats whose agent, project or name holds every word of a topic, or whose texts do within one row; with matching rows."""
    words = fx.tokens(topic)
    name = F.concat_ws(" ", "session", "agent", "project", "concept")
    by_name, by_text = F.lit(bool(words)), F.lit(bool(words))
    for w in words:
        by_name, by_text = by_name & fx.has(name, w), by_text & fx.has(F.coalesce("text", F.lit("")), w)
    hits = rows.filter(F.col("session").isNotNull()).groupBy("session").agg(F.count_if(by_text).alias("text_rows"), F.max(by_name).alias("by_name"), F.max(F.coalesce("ts", F.lit(0))).alias("last_ts"))
    ordered = hits.filter("by_name or text_rows > 0").orderBy(F.desc("by_name"), F.desc("text_rows"), F.desc("last_ts"), "session")
    return ordered.limit(limit) if limit else ordered


def find_session(rows: DataFrame, name: str) -> DataFrame:
    """The sessions a name stands for: the exact one, else all that begin with it."""
    found = rows.select("session").filter(F.startswith("session", F.lit(name))).distinct().withColumn("exact", F.col("session") == name)
    return found.withColumn("any", F.max("exact").over(Window.partitionBy(F.lit(1)))).filter("exact or not any").select("session")


def shortest_prefixes(sessions: DataFrame, least: int = 4) -> DataFrame:
    """(session, prefix): the shortest unique prefix of each name, at least ``least`` characters.

    The neighbours in sorted order share the longest prefixes; sorting is split by the first characters, so no task sorts all.
    """
    names = sessions.select("session").filter(F.col("session").isNotNull()).distinct()
    w = Window.partitionBy(F.substring("session", 1, least)).orderBy("session")

    def shared(a: Column, b: Column) -> Column:
        n = F.least(F.length(a), F.length(b))
        spots = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
        return F.when(b.isNull(), 0).otherwise(F.coalesce(F.array_min(spots) - 1, n))

    near = names.withColumn("p", F.lag("session").over(w)).withColumn("n", F.lead("session").over(w))
    longest = F.greatest(shared(F.col("session"), F.col("p")), shared(F.col("session"), F.col("n"))) + 1
    return near.select("session", F.substring("session", F.lit(1), F.greatest(longest, F.lit(least))).alias("prefix"))


def resolved(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(session, turn, digest, verdict, found): whether an address still holds: verified in place, moved to one other turn,
    ambiguous, or absent."""
    there = rows.filter(F.col("content_digest").isNotNull() & F.col("turn").isNotNull()).select("session", F.col("turn").alias("at"), F.col("content_digest").alias("digest")).distinct()
    both = asked.join(there, ["session", "digest"], "left").groupBy("session", "turn", "digest").agg(F.max(F.col("at") == F.col("turn")).alias("here"), F.count("at").alias("n"), F.min("at").alias("one"))
    verdict = F.when(F.col("here"), "verified").when(F.col("n") == 1, "moved").when(F.col("n") > 1, "ambiguous").otherwise("absent")
    return both.select("session", "turn", "digest", verdict.alias("verdict"), F.when(F.col("here"), F.col("turn")).when(F.col("n") == 1, F.col("one")).alias("found"))


def digest_windows(rows: DataFrame, centres: DataFrame, radius: int, *, prose_only: bool = True) -> DataFrame:
    """``windows`` in transcript order, by default without tool rows."""
    pool = rows.filter(F.coalesce(F.col("who") != "tool", F.lit(True))) if prose_only else rows
    return windows(pool, centres, radius).orderBy("session", "centre", *transcript_order())
