"""The request of a search and its row filters, as one predicate that Catalyst can push down."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode import schema
from tracelode.functions import text as fx


@dataclass(frozen=True)
class QuerySpec:
    """A normalised request; every field narrows the rows before they are ranked or counted."""

    query: str = ""
    agent: str | None = None
    project: str | None = None
    exclude_project: str | None = None
    chat: str | None = None
    who: tuple[str, ...] = ()
    exclude_who: tuple[str, ...] = ()
    tools: bool = True
    model: str | None = None
    model_like: str | None = None
    since: int | None = None
    until: int | None = None
    exclude_sessions: tuple[str, ...] = ()
    caller: str | None = None
    caller_from_turn: int | None = None
    sort: str = "score"
    limit: int = 40
    explicit: bool = False
    now_ms: int = field(default=schema.NOW_MS)

    def __post_init__(self):
        if self.since is not None and self.until is not None and self.since >= self.until:
            raise ValueError("since must be before until")


def predicate(spec: QuerySpec) -> Column:
    """All row filters of a request; null columns never match an inclusion and never fail an exclusion."""
    terms: list[Column] = []
    yes = F.lit(True)

    def like(column: str, value: str) -> Column:
        return F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lower(F.lit(value)))

    if spec.agent:
        terms.append(like("agent", spec.agent))
    if spec.project:
        terms.append(like("project", spec.project))
    if spec.exclude_project:
        terms.append(~like("project", spec.exclude_project))
    if spec.chat:
        terms.append(F.startswith(F.lower(F.coalesce("session", F.lit(""))), F.lower(F.lit(spec.chat))))
    if spec.who:
        terms.append(F.col("who").isin(*spec.who))
    if spec.exclude_who:
        terms.append(F.coalesce(~F.col("who").isin(*spec.exclude_who), yes))
    if not spec.tools:
        terms.append(F.coalesce(F.col("who") != "tool", yes))
    if spec.model:
        terms.append(F.lower("model") == spec.model.lower())
    if spec.model_like:
        terms.append(like("model", spec.model_like))
    ts = F.coalesce("ts", F.lit(0))
    if spec.since is not None:
        terms.append(ts >= spec.since)
    if spec.until is not None:
        terms.append(ts < spec.until)
    if spec.exclude_sessions:
        terms.append(F.coalesce(~F.col("session").isin(*spec.exclude_sessions), yes))
    if spec.caller and spec.caller_from_turn is not None:
        terms.append(F.coalesce(~((F.col("session") == spec.caller) & (F.col("turn") >= spec.caller_from_turn)), yes))
    return reduce(Column.__and__, terms, yes)


def without_family(rows: DataFrame, families: DataFrame, session: str) -> DataFrame:
    """Rows outside the family of a session; ``families`` is (session, root)."""
    root = families.filter(F.col("session") == session).select("root")
    members = families.join(F.broadcast(root), "root", "left_semi").select("session")  # one root
    return rows.join(members, "session", "left_anti")


def literal_of(pattern: str, least: int = 3) -> str | None:
    """The longest ASCII literal that every match of a regular expression must contain; None if there is none.

    Only plain runs at the top level count: whatever is quantified, grouped, escaped or in an alternation may be absent.
    """
    if "|" in pattern or re.search(r"\(\?[^:)]", pattern):
        return None
    flat = re.sub(r"\\.", "\0", pattern)
    flat = re.sub(r"\[[^\]]*\]", "\0", flat)
    while re.search(r"\([^()]*\)", flat):
        flat = re.sub(r"\([^()]*\)[*+?]?(?:\{[^}]*\})?", "\0", flat)
    flat = re.sub(r".[*?]|.\{[^}]*\}", "\0", flat)
    runs = re.findall(r"[A-Za-z0-9 _/:,\-]+", flat.replace("+", "\0").replace(".", "\0"))
    best = max(runs, key=len, default="")
    return best if len(best) >= least else None


# What marks a query as no prose.
_IDENTIFIER = re.compile(r"^(?:[0-9a-f]{7,}|v?\d+(?:\.\d+)+\S*|\S*[_/\\:=<>{}()\[\]$#@]\S*|[a-z]+[A-Z]\S*)$")


def semantic_admission(query: str) -> str | None:
    """Why a query shouldn't go to the vectors: empty, control-characters, identifier or no-words; None if it may."""
    q = query.strip()
    if not q:
        return "empty"
    if any(ord(c) < 32 and c not in "\t\n" for c in q):
        return "control-characters"
    words = q.split()
    if len(words) == 1 and _IDENTIFIER.match(words[0]):
        return "identifier"
    if not any(re.search(r"[aeiouyäöüàéèêíóúаеиоуыэюя]", w, re.I) and re.search(r"[^\W\d_]{2}", w) for w in words):
        return "no-words"
    return None


def census(rows: DataFrame) -> DataFrame:
    """(dimension, value, rows) of the columns that filters name."""
    columns = ["agent", "project", "who", "model", "concept"]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in columns)))
    return rows.select(pairs.alias("p")).select("p.*").filter(F.col("value").isNotNull() & (F.col("value") != "")).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("rows"))


def coverage(rows: DataFrame, spec: QuerySpec) -> DataFrame:
    """(rows, kept, chats, kept_chats): how much of the corpus the filters leave."""
    p = predicate(spec)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(p).alias("kept"), F.count_distinct("session").alias("chats"), F.count_distinct(F.when(p, F.col("session"))).alias("kept_chats"))


def matching(rows: DataFrame, spec: QuerySpec) -> DataFrame:
    return rows.filter(predicate(spec))


def has_terms(text: Column, terms: list[str]) -> Column:
    return reduce(Column.__and__, [fx.has(text, t) for t in terms], F.lit(True))
