"""The live fold: table and stream give the same states."""

from tracelode.plans.workspace import Workspace
from tracelode.streaming import live

SCHEMA = "agent string, session string, ts bigint, type string, name string, call_id string, text string, project string, model string, op string, why string, seq bigint"


def feed(spark):
    rows = [
        ("a", "s", 1, "user", None, None, "fix  it", "web", "m", None, None, 0), ("a", "s", 2, "tool", "grep", "1", None, "~", None, None, None, 1), ("a", "s", 3, "tool", "read", "2", None, None, None, None, None, 2),
        ("a", "s", 4, "tool_done", None, "2", None, None, None, None, None, 3), ("a", "s", 4, "queued", None, None, "next", None, None, "enqueue", None, 4), ("a", "t", 9, "tool", "ls", None, None, None, None, None, None, 5),
        ("a", "t", 10, "done", None, None, None, None, None, None, "finished", 6), ("a", "u", 1, None, None, None, None, None, None, None, None, 7), ("a", "v", 5, "tool_done", None, "none", None, None, None, None, None, 8)]
    return spark.createDataFrame(rows, SCHEMA)


def states(df):
    return {r.session: (r.state, r.working, r.turns, r.pending, r.queued, r.last_ts, r.project, r.last_text) for r in df.collect()}


WANT = {"s": ("⚙ grep", True, 1, 1, 1, 4, "web", "fix it"), "t": ("finished", False, 0, 0, 0, 10, "", ""), "u": ("", False, 0, 0, 0, 0, "", ""), "v": ("thinking", True, 0, 0, 0, 5, "", "")}


def test_table_fold(spark):
    assert states(live.fold_table(feed(spark))) == WANT
    assert live.fold_table(feed(spark).filter("false")).count() == 0


def test_stream_equals_table(spark):
    work = Workspace(spark, "s")
    rows = feed(spark)
    path = f"{work.path}/in"
    rows.filter("seq < 3").coalesce(1).write.parquet(path)
    out = {}

    def keep(batch, n):
        out.update(states(batch))

    def run():
        s = spark.readStream.schema(SCHEMA).parquet(path)
        live.fold_stream(s).writeStream.outputMode("update").option("checkpointLocation", f"{work.path}/cp").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()

    run()
    rows.filter("seq >= 3").coalesce(1).write.mode("append").parquet(path)
    run()
    assert out == WANT


def test_decay_and_board(spark):
    now = live.decayed(live.fold_table(feed(spark)), 300_000)
    assert {r.session: r.state for r in now.collect()}["v"] == "stalled"
    assert {r.state for r in live.decayed(live.fold_table(feed(spark)), 10**9).filter("session = 's'").collect()} == {"expired"}
    assert live.board(now).first().session == "s"
    assert live.history(feed(spark), 2, 100).count() == 6


class Held:
    """A session's state as the engine hands it to a visit."""

    def __init__(self):
        self.value, self.timer, self.hasTimedOut = None, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):  # noqa: N802 - the engine's name
        self.timer = ms


def test_timers_stall_expire_and_forget():
    import pandas as pd

    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    event = lambda kind, ts: pd.DataFrame([{**dict.fromkeys(names), "ts": ts, "seq": ts, "type": kind, "call_id": "1", "name": "grep"}])
    see = lambda held, *frames: next(live.visit(("a", "s"), frames, held, True)).iloc[0]
    held = Held()
    assert see(held, event("user", 1)).state == "thinking" and held.timer == live.STALLED_MS
    held.hasTimedOut = True
    row = see(held)
    assert (row.state, row.working) == ("stalled", False) and held.exists and held.timer == live.EXPIRED_MS - live.STALLED_MS
    held.hasTimedOut = False
    assert see(held, event("tool", 5)).state == "⚙ grep" and held.timer == live.EXPIRED_MS  # it went on
    held.hasTimedOut = True
    row = see(held)
    assert (row.state, row.working) == ("expired", False) and not held.exists
    held.hasTimedOut = False
    assert see(held, event("done", 9)).turns == 0  # a new session
    held.hasTimedOut = True
    assert see(held).state == "done" and not held.exists


def test_queues_and_calls_agree_with_the_stream(spark):
    import random

    import pandas as pd

    rng = random.Random(2)
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    rows = [("a", f"s{rng.randrange(6)}", rng.randrange(40) or None, rng.choice(["user", "reply", "tool", "tool_done", "subagent_result", "queued", "queued", "done", "other", None]), rng.choice(["grep", "read", None]), rng.choice(["1", "2", "3", "", None]),
             rng.choice(["say  it", " ", None]), rng.choice(["web", "~", "", None]), rng.choice(["m", "n", "", None]), rng.choice(["enqueue", "dequeue", None]), rng.choice(["finished", None, ""]), i) for i in range(300)]
    table = {r.session: tuple(r) for r in live.fold_table(spark.createDataFrame(rows, SCHEMA)).collect()}
    for session, want in table.items():
        held = Held()
        own = pd.DataFrame([r for r in rows if r[1] == session], columns=names)
        own["ts"] = own["ts"].fillna(0).astype("int64")
        assert tuple(next(live.visit(("a", session), [own], held, False)).iloc[0]) == want
