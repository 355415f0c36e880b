"""Scores of hits and their orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode import schema
from tracelode.functions import boundary
from tracelode.functions import text as fx
from tracelode.operators.filters import QuerySpec


def recency(ts: Column, who: Column, now_ms: int, floor: float = 0.0) -> Column:
    """Half after every fortnight; what people said never falls below a floor, nor does an explicit search."""
    days = F.greatest(F.lit(0.0), (F.lit(now_ms) - F.coalesce(ts, F.lit(0))).cast("double")) / schema.DAY_MS
    aged = F.greatest(F.pow(F.lit(0.5), days / schema.HALF_LIFE_DAYS), F.when(who == "user", schema.USER_RECENCY_FLOOR).otherwise(0.0))
    return F.greatest(aged, F.lit(floor))


def _by_value(column: Column, table: dict[str, float], default: float) -> Column:
    return reduce(lambda c, kv: c.when(column == kv[0], kv[1]), table.items(), F.when(F.lit(False), 0.0)).otherwise(default)


def is_meta(who: Column, turn: Column) -> Column:
    """Rows about the tooling rather than the work."""
    return F.coalesce(who.isin("harness", "synthetic") | ((who == "subagent") & (turn == 0)), F.lit(False))


def tightness(snippet: Column, query: str) -> Column:
    """How compactly and how often a query stands in a snippet: 1 - 0.5^n for n exact occurrences."""
    pattern, qlen = fx.phrase_pattern(query), sum(len(t) for t in fx.tokens(query))
    lengths = F.transform(F.regexp_extract_all(snippet, F.lit(fx.ci(pattern)), F.lit(0)), lambda m: F.length(m))
    tight = F.least(F.lit(1.0), F.lit(float(qlen)) / F.array_min(lengths))
    return F.when(F.size(lengths) > 0, tight * (1 - F.pow(F.lit(0.5), F.size(lengths)))).otherwise(0.0)


def proximity(snippet: Column, query: str) -> Column:
    """How close together the query's words stand; every cut between them counts as eighty characters."""
    words = fx.tokens(query)
    qlen = sum(len(t) for t in words)
    low = fx.folded(snippet)
    starts = F.array_compact(F.array(*(F.when(fx.has(snippet, w), F.instr(low, F.lit(w.lower()))) for w in words)))
    ends = F.array_compact(F.array(*(F.when(fx.has(snippet, w), F.instr(low, F.lit(w.lower())) + len(w)) for w in words)))
    first, last = F.array_min(starts), F.array_max(ends)
    between = F.substring(snippet, first, last - first)
    spread = last - first + 80 * (F.length(between) - F.length(F.replace(between, F.lit("…"), F.lit(""))))
    share = F.size(starts) / F.lit(float(len(words)))
    return F.when(F.size(starts) < 2, share).otherwise(share * (0.5 + 0.5 * F.least(F.lit(1.0), F.lit(float(qlen)) / spread)))


def scored(hits: DataFrame, spec: QuerySpec, *, stats: dict | None = None, boundaries: bool = True) -> DataFrame:
    """Hits with score (four decimals), evidence, boundary class and meta; ``boundaries=False`` stays native throughout."""
    match = tightness(F.col("snippet"), spec.query)
    if "coverage" in hits.columns:
        match = F.when(F.col("matched") == "content-terms", F.greatest(match, F.col("coverage"))).otherwise(match)
    match = F.when(F.col("matched") == "all-terms", F.greatest(match, proximity(F.col("snippet"), spec.query))).otherwise(match)
    rows = hits.withColumn("match", match)
    if boundaries:
        rows = rows.withColumn("__b", boundary.graded(F.col("snippet"), F.col("matched"), spec.query, stats))
        factor, kind = F.col("__b.factor"), F.col("__b.class")
    else:
        factor, kind = F.lit(1.0), F.lit(None).cast("string")
    rec = recency(F.col("ts"), F.col("who"), spec.now_ms, schema.EXPLICIT_RECENCY_FLOOR if spec.explicit else 0.0)
    who = F.coalesce(F.col("who"), F.lit(""))
    meta = is_meta(F.col("who"), F.col("turn"))
    value = F.col("match") * rec * _by_value(who, schema.WHO_WEIGHT, schema.WHO_WEIGHT_OTHER) * factor * _by_value(who, schema.SOURCE_SCALE, 1.0) * F.when(meta, schema.META_SCALE).otherwise(1.0)
    return rows.select(*hits.columns, F.round(value, 4).alias("score"), F.round(F.col("match") * factor, 6).alias("evidence"), kind.alias("boundary_class"), meta.alias("meta"))


def rank_key(sort: str = "score") -> list[Column]:
    """The complete order of a page, every part ascending: by score (phrases before scattered terms), by time or by place."""
    lane = _by_value(F.coalesce("matched", F.lit("")), {k: float(v) for k, v in schema.LANE_CLASS.items()}, 0.0)
    place = [F.col("session"), F.coalesce("turn", F.lit(-1))]
    if sort == "position":
        return [*place, F.col("id")]
    ties = [-F.coalesce("ts", F.lit(0)), *place, F.coalesce("who", F.lit("")), F.col("id")]
    return ties if sort == "time" else [lane, -F.col("score"), *ties]


def order(sort: str = "score") -> list[Column]:
    return [c.asc_nulls_first() for c in rank_key(sort)]


def page(hits: DataFrame, spec: QuerySpec) -> DataFrame:
    """The first rows in order; with a limit this is a top-k without a full sort."""
    ordered = hits.orderBy(*order(spec.sort))
    return ordered.limit(spec.limit) if spec.limit else ordered


def ranked(hits: DataFrame, limit: int, sort: str = "score") -> DataFrame:
    """The first ``limit`` hits with their positions from 0: a top-k on every task first, and only its rows are numbered."""
    return hits.orderBy(*order(sort)).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order(sort))) - 1)


def heads(hits: DataFrame, key: str, sort: str = "score") -> DataFrame:
    """The best hit of each ``key`` with the number of its hits: one aggregate that combines before the shuffle; null keys have none."""
    best = F.min_by(F.struct(*(c for c in hits.columns if c != key)), F.struct(*(c.alias(f"k{i}") for i, c in enumerate(rank_key(sort)))))
    return hits.filter(F.col(key).isNotNull()).groupBy(key).agg(best.alias("best"), F.count(F.lit(1)).alias("hits")).select(key, "best.*", "hits")


def tiers(hits: DataFrame) -> DataFrame:
    """(tier, rows): phrase_aligned, partial, interior and all_terms."""
    tier = F.when(F.col("matched") == "all-terms", "all_terms").when(F.col("boundary_class") == "aligned", "phrase_aligned").when(F.col("boundary_class") == "interior", "interior").otherwise("partial")
    return hits.select(tier.alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("rows"))
