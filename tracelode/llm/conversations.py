"""Rebuilding conversations from message rows.

The rows are an event log that is folded into final turns.  A row creates a message in its slot (session, turn, side); a later row with
the same text is a retry and folds into the first.  A log that has versions and actions (``version`` and ``action`` name their columns)
first folds edits and deletes: in each slot and message the row with the highest version counts, and a delete withdraws it.  A log
without them holds creates and retries only, all of version 0.

Defined results: rows without session and rows of other speakers are ignored; a conversation survives only if no
counted row has a null turn, its turns are 0, 1, 2 ... without a gap, and each turn has exactly one prompt and
one reply with at least one letter or digit; an empty table yields no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.plans.skew import join_hot

# Spellings of the two sides.
PROMPT_SIDE = ("user", "human", "subagent")
REPLY_SIDE = ("agent", "assistant", "ai")


def side_of(who: Column) -> Column:
    """0 prompt side, 1 reply side, null for any other speaker; case and padding are ignored."""
    name = F.lower(F.regexp_replace(who, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(name.isin(*PROMPT_SIDE), 0).when(name.isin(*REPLY_SIDE), 1)


def fold_log(log: DataFrame, slot: list[str], version: Column, action: Column, order: Column) -> DataFrame:
    """Final state of a create/edit/delete log: the row with the highest version of each slot, unless it deletes.

    Ties on the version go to the lowest ``order``, so a retried write changes nothing; null slots group together.  One hash
    aggregate with map-side combine; no window, so a hot slot never meets in one task before it is reduced.
    """
    others = [c for c in log.columns if c not in slot]
    deletes = F.coalesce(F.lower(F.trim(action)) == "delete", F.lit(False))
    last = F.max_by(F.struct(*others, deletes.alias("__gone")), F.struct(F.coalesce(version, F.lit(0)), -order)).alias("last")
    return log.groupBy(*slot).agg(last).filter("not last.__gone").select(*slot, *(F.col(f"last.{c}").alias(c) for c in others))


def spoken_rows(msgs: DataFrame, *, version: str | None = None, action: str | None = None, message: str | None = None) -> DataFrame:
    """(session, turn, side, id, said): one row per message after the log is folded.

    ``message`` names the column that tells which message of its slot a row is about; without one an edit or a delete is about the
    slot's only message, and a log without versions knows a message by its text.
    """
    text = [F.xxhash64("text").alias("h1"), F.hash("text").alias("h2")]  # 96 hash bits stand for the exact text within a slot
    which = [F.col(message).alias("h1"), F.lit(0).alias("h2")] if message else [F.lit(0).alias("h1"), F.lit(0).alias("h2")] if version else text
    rows = msgs.select("session", "turn", side_of(F.col("who")).alias("side"), "id", *which, F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False)).alias("said"),
                       (F.col(version) if version else F.lit(0)).alias("version"), (F.col(action) if action else F.lit("create")).alias("action"))
    rows = rows.filter(F.col("session").isNotNull() & F.col("side").isNotNull())
    return fold_log(rows, ["session", "turn", "side", "h1", "h2"], F.col("version"), F.col("action"), F.col("id")).select("session", "turn", "side", "id", "said")


def conversations(msgs: DataFrame, **log) -> DataFrame:
    """(session, pos, id) of the kept conversations; pos counts from 0, the prompt before the reply of its turn.

    ``log`` names the columns of a versioned log, see ``spoken_rows``.  Three hash aggregates on keys that share the prefix
    ``session``: message, turn, session.  Since a kept conversation has exactly one prompt and one reply in each turn 0..n-1, the
    position is 2 * turn + side: no sort and no window over a session, so that the largest session is as cheap as any.
    """
    turns = (
        spoken_rows(msgs, **log)
        .groupBy("session", "turn")
        .agg(
            F.count_if(F.col("side") == 0).alias("prompts"), F.count_if(F.col("side") == 1).alias("replies"), F.min("said").alias("said"),
            F.min(F.when(F.col("side") == 0, F.col("id"))).alias("prompt_id"), F.min(F.when(F.col("side") == 1, F.col("id"))).alias("reply_id"),
        )
    )
    ok = F.col("turn").isNotNull() & (F.col("prompts") == 1) & (F.col("replies") == 1) & F.col("said")
    kept = (
        turns.groupBy("session")
        .agg(F.min(F.coalesce(ok, F.lit(False))).alias("ok"), F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"), F.max("turn").alias("last"))
        .filter(F.col("ok") & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1))
        .select("session", "n")
    )
    joined = join_hot(turns.select("session", "turn", "prompt_id", "reply_id"), kept, ["session"], "n", F.col("turn"))
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("prompt_id").alias("id")), F.struct(F.lit(1).alias("side"), F.col("reply_id").alias("id")))
    return joined.select("session", "turn", F.explode(both).alias("m")).select(
        "session", (F.col("turn").cast("bigint") * 2 + F.col("m.side")).alias("pos"), F.col("m.id").alias("id")
    )
