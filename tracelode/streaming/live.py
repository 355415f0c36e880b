"""The state of running sessions: over a table by native aggregates, over a stream with state, both from one table of effects.

Events have agent, session, ts, type (user, reply, tool, tool_done, subagent_result, queued, done), name, call_id, text, project, model,
op, why, and their order within a time, seq.  What a session's state says follows from a few last events, so a table needs no
sort of a session: the last event that sets the label, the last that clears its calls, the last of each call, and the lowest point
of its queue.  A stream keeps just these per session, and drops a session that was silent for long.

Defined results: null and unknown types are ignored; a tool without a call id gets one from its time; a result without its call
changes nothing but that the session is at work; late events merge, the last time is a maximum; an empty table yields no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STALLED_MS, EXPIRED_MS, ACTIVE_MS = 240_000, 900_000, 90_000
OUT = "agent string, session string, state string, working boolean, turns int, pending int, queued int, last_ts bigint, project string, model string, last_text string"
LAST_TEXT = 1000


@dataclass(frozen=True)
class Effect:
    """What an event of a type does: its label (calls: that of the pending calls, why: the event's own), and whether it says that the
    session works, begins a turn, clears the pending calls, opens or closes one, and holds what was said."""

    label: str
    works: bool = True
    turn: bool = False
    clears: bool = False
    opens: bool = False
    closes: bool = False
    says: bool = False


EFFECTS = {
    "user": Effect("thinking", turn=True, clears=True, says=True),
    "reply": Effect("replying", says=True),
    "tool": Effect("calls", opens=True),
    "tool_done": Effect("calls", closes=True),
    "subagent_result": Effect("calls", closes=True),
    "done": Effect("why", works=False, clears=True),
}


def _types(**wanted) -> list[str]:
    return [t for t, e in EFFECTS.items() if all(getattr(e, k) == v for k, v in wanted.items())]


def fold_table(events: DataFrame) -> DataFrame:
    """Final state of every session of a table of events.

    Three aggregates that combine before they shuffle: by session, by call, and again by session; only the events of queues, which are
    few, are put in order.
    """
    keys = ["agent", "session"]
    at, kind = F.struct(F.coalesce("ts", F.lit(0)).alias("ts"), F.coalesce("seq", F.lit(0)).alias("seq")), F.col("type")
    rows = events.withColumn("at", at).withColumn("call", F.coalesce(F.when(F.col("call_id") != "", F.col("call_id")), F.concat(F.lit("anon-"), F.coalesce("ts", F.lit(0)).cast("string"))))
    told = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    counted = kind.isin(*EFFECTS, "queued")
    last = lambda value, when: F.max_by(value, F.when(when, F.col("at")))
    real = (F.col("project") != "") & (F.col("project") != "~")
    whole = rows.groupBy(*keys).agg(
        last(F.struct("type", "why"), kind.isin(*EFFECTS)).alias("labels"), F.max(F.when(kind.isin(*_types(clears=True)), F.col("at"))).alias("cleared"),
        F.count_if(kind.isin(*_types(turn=True))).cast("int").alias("turns"), F.coalesce(F.max(F.when(counted, F.col("ts"))), F.lit(0)).alias("last_ts"),
        F.coalesce(last(F.col("project"), counted & real), F.max(F.when(counted & (F.col("project") == "~"), "~")), F.lit("")).alias("project"),
        F.coalesce(last(F.col("model"), counted & (F.col("model") != "")), F.lit("")).alias("model"),
        F.coalesce(last(F.substring(told, 1, LAST_TEXT), kind.isin(*_types(says=True)) & (told != "")), F.lit("")).alias("last_text"))
    calls = rows.filter(kind.isin(*_types(opens=True), *_types(closes=True))).groupBy(*keys, "call").agg(F.max_by(F.struct("type", "name", "at"), "at").alias("c")).filter(F.col("c.type").isin(*_types(opens=True)))
    w, c = whole.alias("w"), calls.alias("c")
    same = F.col("w.agent").eqNullSafe(F.col("c.agent")) & F.col("w.session").eqNullSafe(F.col("c.session"))
    open_calls = c.join(w, same).filter(F.col("w.cleared").isNull() | (F.col("c.c.at") > F.col("w.cleared"))).groupBy("c.agent", "c.session").agg(F.count(F.lit(1)).cast("int").alias("pending"), F.max_by(F.coalesce("c.c.name", F.lit("?")), "c.c.at").alias("newest"))
    queue = rows.filter(kind == "queued").withColumn("step", F.when(F.coalesce(F.col("op") == "enqueue", F.lit(False)), 1).otherwise(-1))
    level = F.sum("step").over(Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    # a queue never falls below nothing: what it would have fallen to is what it is off by
    queue = queue.withColumn("level", level).groupBy(*keys).agg((F.sum("step") - F.least(F.lit(0), F.min("level"))).cast("int").alias("queued"))
    o, q = open_calls.alias("o"), queue.alias("q")
    both = lambda x: F.col("w.agent").eqNullSafe(F.col(f"{x}.agent")) & F.col("w.session").eqNullSafe(F.col(f"{x}.session"))
    pending, label = F.coalesce("o.pending", F.lit(0)), F.col("w.labels.type")
    tools = F.when(pending > 0, F.concat(F.lit("⚙ "), F.col("o.newest"), F.when(pending > 1, F.concat(F.lit(" +"), (pending - 1).cast("string"))).otherwise(""))).otherwise("thinking")
    state = F.when(label.isin(*_types(label="calls")), tools).when(label.isin(*_types(label="why")), F.coalesce(F.when(F.col("w.labels.why") != "", F.col("w.labels.why")), F.lit("done")))
    for name in ("thinking", "replying"):
        state = state.when(label.isin(*_types(label=name)), name)
    return w.join(o, both("o"), "left").join(q, both("q"), "left").select(
        "w.agent", "w.session", state.otherwise("").alias("state"), F.coalesce(label.isin(*_types(works=True)), F.lit(False)).alias("working"), "w.turns", pending.alias("pending"), F.coalesce("q.queued", F.lit(0)).alias("queued"),
        F.col("w.last_ts").cast("bigint").alias("last_ts"), "w.project", "w.model", "w.last_text")


class Kept:
    """What a stream keeps of a session between its micro-batches; small, and serialised as JSON."""

    def __init__(self, text: str | None = None):
        held = json.loads(text) if text else {}
        self.label, self.works, self.turns, self.queued, self.last_ts = (held.get(k, d) for k, d in (("label", ""), ("works", False), ("turns", 0), ("queued", 0), ("last_ts", 0)))
        self.calls: dict[str, str] = held.get("calls", {})  # in the order in which they were opened
        self.words: dict[str, str] = held.get("words", {})
        self.silent = held.get("silent", "")

    def dump(self) -> str:
        return json.dumps(self.__dict__)

    def see(self, event: dict) -> None:
        """Apply one event by the table of effects."""
        kind, moment = event.get("type"), int(event.get("ts") or 0)
        effect = EFFECTS.get(kind)
        if effect is None and kind != "queued":
            return
        self.last_ts, self.silent = max(self.last_ts, moment), ""
        for name in ("project", "model"):
            value = event.get(name)
            if value and not (name == "project" and value == "~" and self.words.get(name)):
                self.words[name] = value
        if effect is None:
            self.queued = max(0, self.queued + (1 if event.get("op") == "enqueue" else -1))
            return
        told = " ".join((event.get("text") or "").split())
        if effect.says and told:
            self.words["text"] = told[:LAST_TEXT]
        call = event.get("call_id") or f"anon-{moment}"
        if effect.clears:
            self.calls = {}
        if effect.opens or effect.closes:
            self.calls.pop(call, None)
        if effect.opens:
            self.calls[call] = event.get("name") or "?"
        self.turns, self.works = self.turns + effect.turn, effect.works
        self.label = (event.get("why") or "done") if effect.label == "why" else effect.label

    def row(self, agent: str, session: str) -> tuple:
        state = self.label
        if state == "calls":
            names = list(self.calls.values())
            state = f"⚙ {names[-1]}" + (f" +{len(names) - 1}" if len(names) > 1 else "") if names else "thinking"
        word = self.words.get
        return (agent, session, self.silent or state, self.works and not self.silent, self.turns, len(self.calls), self.queued, self.last_ts, word("project", ""), word("model", ""), word("text", ""))


_NAMES = [c.split(" ")[0] for c in OUT.split(", ")]


def visit(key: tuple, batches: Iterable, state, timers: bool) -> Iterator:
    """One visit of a session: its new events, or a timer that ran out.

    With timers a session that talks falls silent after ``STALLED_MS`` (stalled), one that works after ``EXPIRED_MS`` (expired); after
    that the session is forgotten, as is a finished one, and an event that comes later begins a new one.
    """
    import pandas as pd

    kept = Kept(state.get[0] if state.exists else None)
    if timers and state.hasTimedOut:
        talking = kept.works and kept.label in ("thinking", "replying") and not kept.silent
        if talking:
            kept.silent = "stalled"
            state.update((kept.dump(),))
            state.setTimeoutDuration(EXPIRED_MS - STALLED_MS)
        else:
            kept.silent = "expired" if kept.works else ""
            state.remove()
        yield pd.DataFrame([kept.row(*key)], columns=_NAMES)
        return
    frames = list(batches)  # one session's rows of one micro-batch, which maxFilesPerTrigger bounds
    if frames:
        pdf = pd.concat(frames).sort_values(["ts", "seq"], kind="stable")
        columns = {c: pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in pdf.columns}
        for values in zip(*columns.values()):
            kept.see(dict(zip(columns, values)))
    state.update((kept.dump(),))
    if timers:
        state.setTimeoutDuration(STALLED_MS if kept.works and kept.label in ("thinking", "replying") else EXPIRED_MS)
    yield pd.DataFrame([kept.row(*key)], columns=_NAMES)


def fold_stream(events: DataFrame, timeout: str = "NoTimeout") -> DataFrame:
    """The state of each session that a micro-batch touched or, with ``ProcessingTimeTimeout``, whose timer ran out."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterable, state: GroupState) -> Iterator:
        yield from visit(key, batches, state, timeout != "NoTimeout")

    return events.groupBy("agent", "session").applyInPandasWithState(run, OUT, "s string", "update", getattr(GroupStateTimeout, timeout))


def decayed(snapshot: DataFrame, now_ms: int) -> DataFrame:
    """A snapshot at a moment: silent sessions stall, then expire; ``active`` marks recent ones."""
    quiet = F.lit(now_ms) - F.col("last_ts")
    talking = F.col("working") & F.col("state").isin("thinking", "replying")
    expired, stalled = F.col("working") & (quiet > EXPIRED_MS), talking & (quiet > STALLED_MS)
    state = F.when(expired, "expired").when(stalled, "stalled").otherwise(F.col("state"))
    return snapshot.withColumn("state", state).withColumn("working", F.col("working") & ~expired & ~stalled).withColumn("active", quiet <= ACTIVE_MS)


def board(snapshot: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Sessions in order: working families first, the latest first, children after their root."""
    rows = snapshot if parents is None else snapshot.join(parents.select("session", "root"), "session", "left")
    root = F.coalesce("root", "session") if parents is not None else F.col("session")
    return rows.withColumn("family", root).orderBy(F.desc("working"), F.desc(F.floor(F.col("last_ts") / 30_000)), "agent", "family", (F.col("session") != F.col("family")).cast("int"), "session")


def tail(events: DataFrame, *, agent: str | None = None, session: str | None = None, types: tuple[str, ...] = ()) -> DataFrame:
    """The events of a live feed by agent, part of a session's name and type."""
    out = events
    if agent:
        out = out.filter(F.contains(F.lower("agent"), F.lit(agent.lower())))
    if session:
        out = out.filter(F.contains("session", F.lit(session)))
    return out.filter(F.col("type").isin(*types)) if types else out


def history(events: DataFrame, per_session: int = 200, overall: int = 600) -> DataFrame:
    """The latest events, bounded per session and overall; the per-session bound is applied before the shuffle."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("agent", "session").orderBy(F.desc("ts"), F.desc("seq")))
    return events.withColumn("rn", rn).filter(F.col("rn") <= per_session).drop("rn").orderBy(F.desc("ts"), F.desc("seq")).limit(overall)


def streamed_hits(events: DataFrame, query: str, sink, trigger: dict | None = None):
    """Searches rows while they arrive: ``sink(hits, batch_no)`` gets each micro-batch's hits."""
    from tracelode.operators import lexical
    from tracelode.operators.filters import QuerySpec

    spec = QuerySpec(query)
    return events.writeStream.foreachBatch(lambda batch, n: sink(lexical.merged(batch, spec), n)).trigger(**(trigger or {"availableNow": True})).start()
