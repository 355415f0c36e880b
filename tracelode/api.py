"""The engine's verbs over a corpus of search rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions import text as fx
from tracelode.operators import context, filters, fusion, lexical, ranking, semantic
from tracelode.operators.filters import QuerySpec

LANES = {"keyword": lexical.merged, "word": lexical.word, "regex": lexical.regex, "terms": lexical.all_terms}


def search(rows: DataFrame, query: str, *, mode: str = "keyword", stats: dict | None = None, **options) -> DataFrame:
    """A ranked page.  Keyword searches that find nothing and are shaped like a question fall back to the idf-weighted OR."""
    spec = QuerySpec(query, explicit=mode in ("word", "regex"), **options)
    hits = LANES[mode](rows, spec)
    if mode == "keyword" and fx.Reading(query).sentence and hits.limit(1).count() == 0:
        hits = lexical.content(rows, replace(spec, query=" ".join(fx.Reading(query).content)))
    return ranking.page(ranking.scored(hits, spec, stats=stats, boundaries=mode == "keyword"), spec)


def count(rows: DataFrame, query: str, **options) -> DataFrame:
    return lexical.counts(rows, QuerySpec(query, **options))


def chats(rows: DataFrame, topic: str | None = None, limit: int = 40) -> DataFrame:
    return context.chats_about(rows, topic, limit) if topic else context.chats(rows, limit)


def around(rows: DataFrame, session: str, turn: int, radius: int = 4, *, tools: bool = False) -> DataFrame:
    """The transcript around a turn, or the nearest turn that exists."""
    name = context.find_session(rows, session)
    centre = name.withColumn("turn", F.lit(turn))
    return context.digest_windows(rows, centre, radius, prose_only=not tools)


def recall(rows: DataFrame, queries: list[str], *, families: DataFrame | None = None, limit: int = 8, radius: int = 2) -> DataFrame:
    """Context windows around the best hits of several queries, in rounds over the queries and one a family."""
    pages = None
    for n, q in enumerate(queries):
        page = fusion.page_of(search(rows, q)).withColumn("query_no", F.lit(n)).select("query_no", "id", "session", "turn", "score", "place")
        pages = page if pages is None else pages.unionByName(page)
    known = pages.withColumn("family", F.col("session")) if families is None else pages.join(families.select("session", F.col("root").alias("family")), "session", "left").withColumn("family", F.coalesce("family", "session"))
    chosen = fusion.recalled(known, limit)
    return context.digest_windows(rows, chosen.filter("session is not null and turn is not null").select("session", "turn"), radius)


def pack(rows: DataFrame, queries: list[str]) -> DataFrame:
    """Hits of many queries from one scan of the corpus."""
    return fusion.packed(rows, queries)


def similar(vectors: DataFrame, query: list[float], k: int = 10, *, group: str | None = None, heads: int = 8, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows by cosine to a query vector, flat or the best of each of the best groups."""
    scored = semantic.similar(vectors, query)
    return semantic.grouped_topk(scored, group, k, heads, list(ties)) if group else semantic.topk(scored, k, list(ties))


def after_compaction(rows: DataFrame, session: str, blocks: int = 8) -> DataFrame:
    return context.compaction_tail(rows, session, blocks)


def coverage(rows: DataFrame, **options) -> DataFrame:
    return filters.coverage(rows, QuerySpec(**options))
