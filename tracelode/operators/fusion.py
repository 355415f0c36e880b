"""Fusing and showing results: folds, diversity, packs and pages.

Corpus-sized steps are DataFrame operators.  Page composition is a greedy program over at most ``PAGE`` rows that were
limited before, so it runs on those rows alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions import text as fx
from tracelode.operators import ranking

PAGE = 40


def folded(hits: DataFrame) -> DataFrame:
    """Copies of a row in other chats fold into the best-ranked one (``place``); copies in its own chat stay.

    A group is the same digest, snippet and speaker; a lived row represents it before a meta row.  Tool rows don't fold unless
    known to have succeeded.  Adds ``also_in``, the number of other chats.
    """
    can = F.col("content_digest").isNotNull() & F.coalesce(F.col("who") != "tool", F.lit(True))
    keys = [F.col("content_digest"), F.col("snippet"), F.col("who")]
    w = Window.partitionBy(*keys).orderBy(F.col("meta").cast("int"), "place")
    rows = hits.filter(can).withColumn("rep", F.first("session").over(w))
    same = F.col("session").eqNullSafe(F.col("rep"))
    others = Window.partitionBy(*keys)
    rows = rows.withColumn("also_in", F.size(F.array_remove(F.collect_set("session").over(others), F.col("rep")))).filter(same)
    return rows.drop("rep").unionByName(hits.filter(~can).withColumn("also_in", F.lit(0)))


def meta_last(hits: DataFrame) -> DataFrame:
    """Meta rows sink below lived ones; nothing is dropped."""
    return hits.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("meta").cast("int"), "place")) - 1)


def without_meta(hits: DataFrame, query: str = "query_no") -> DataFrame:
    """Meta rows go, except the best one of a query that has nothing else."""
    w = Window.partitionBy(query)
    first = F.row_number().over(w.orderBy("place"))
    return hits.withColumn("lived", F.max((~F.col("meta")).cast("int")).over(w)).withColumn("rn", first).filter(~F.col("meta") | ((F.col("lived") == 0) & (F.col("rn") == 1))).drop("lived", "rn")


def echoes_last(hits: DataFrame, query: str) -> DataFrame:
    """Rows that quote the whole query sink."""
    echo = F.coalesce(F.col("text").rlike(fx.ci(fx.phrase_pattern(query))), F.lit(False)) & (F.lit(len(fx.tokens(query))) > 3)
    return hits.withColumn("echo", echo).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("echo").cast("int"), "place")) - 1)


def diversified(hits: DataFrame) -> DataFrame:
    """The first hit of each family before the others within each lane; up to three aligned phrases lead, then meaning, the
    other phrases, phrases within words, scattered terms; meta rows last.  ``hits`` has lane (phrase, semantic, all), family,
    boundary_class, meta and place."""
    own = Window.partitionBy("lane", "family").orderBy("place")
    rows = hits.withColumn("nth", F.when(F.col("family").isNull() | (F.row_number().over(own) > 1), 1).otherwise(0))
    interior = F.coalesce(F.col("boundary_class") == "interior", F.lit(False))
    meaning = F.max((F.col("lane") == "semantic").cast("int")).over(Window.partitionBy(F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("lane", interior).orderBy("nth", "place"))
    rows = rows.withColumn("meaning", meaning).withColumn("rank", rank)
    block = (
        F.when(F.col("lane") == "all", 4).when(F.col("lane") == "semantic", 1)
        .when(F.col("meaning") == 0, 0).when(interior, 3).when(F.col("rank") <= 3, 0).otherwise(2)
    )
    ordered = Window.partitionBy(F.lit(1)).orderBy(F.col("meta").cast("int"), block, "nth", "place")
    return rows.withColumn("place", F.row_number().over(ordered) - 1).drop("nth", "meaning", "rank")


def recalled(hits: DataFrame, limit: int) -> DataFrame:
    """Rows of several queries (``query_no``, ``place``, ``session``, ``family``) in rounds: each query's next best family in turn.

    A session is taken once, by the query that ranks it best; a family once a query.
    """
    by_session = hits.withColumn("s", F.row_number().over(Window.partitionBy("session").orderBy("place", "query_no"))).filter("s = 1").drop("s")
    by_family = by_session.withColumn("f", F.row_number().over(Window.partitionBy("query_no", "family").orderBy("place"))).filter("f = 1").drop("f")
    rounds = by_family.withColumn("round", F.row_number().over(Window.partitionBy("query_no").orderBy("place")))
    return rounds.orderBy("round", "query_no").limit(limit)


def packed(rows: DataFrame, queries: list[str]) -> DataFrame:
    """All-terms hits of several queries from one scan: (query_no, id, session, phrase)."""
    flags = []
    for n, q in enumerate(queries):
        every = F.lit(bool(fx.tokens(q)))
        for w in fx.tokens(q):
            every = every & fx.has(F.col("text"), w)
        flags.append(F.when(every, F.struct(F.lit(n).alias("query_no"), F.col("text").rlike(fx.ci(fx.phrase_pattern(q))).alias("phrase"))))
    return rows.select("id", "session", "turn", "ts", "who", F.explode(F.array_compact(F.array(*flags))).alias("q")).select("q.query_no", "id", "session", "turn", "ts", "who", "q.phrase")


def hybrid(lexical: DataFrame, semantic: DataFrame, limit: int = PAGE, most: int = 3) -> DataFrame:
    """At most ``most`` vector rows among lexical ones: rows whose turn or text the lexical lane has are left out; after up to
    three strong lexical rows, before the rest, or first where all lexical rows are weak."""
    text_key = F.lower(fx.one_line(F.coalesce("snippet", F.lit(""))))
    lex = lexical.withColumn("key", text_key).withColumn("weak", F.coalesce(F.col("evidence") < 0.25, F.lit(False)) | (F.coalesce("matched", F.lit("")) == "content-terms"))
    seen_turn = lex.select("session", "turn").distinct()
    seen_text = lex.filter("key != ''").select("key").distinct()
    sem = semantic.withColumn("key", text_key).join(seen_turn, ["session", "turn"], "left_anti").join(seen_text, "key", "left_anti")
    sem = sem.orderBy(F.desc("score"), "id").limit(most)
    strong = F.sum((~F.col("weak")).cast("int")).over(Window.partitionBy(F.lit(1)))
    lex = lex.withColumn("strong", strong).withColumn("slot", F.when((F.col("strong") > 0) & (F.col("place") < F.least(F.lit(3), F.col("strong"))), 0).otherwise(2))
    cols = ["id", "session", "turn", "who", "snippet", "score"]
    both = lex.select(*cols, F.lit("lexical").alias("lane"), "slot", F.col("place").cast("double").alias("inner")).unionByName(
        sem.select(*cols, F.lit("semantic").alias("lane"), F.lit(1).alias("slot"), (-F.col("score")).cast("double").alias("inner")))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("slot", "inner", "id")) - 1
    return both.withColumn("place", place).filter(F.col("place") < limit).drop("slot", "inner")


def probe(hits: DataFrame, evidence: float = 0.55, cosine: float = 0.82) -> DataFrame:
    """The one row that answers with confidence: a phrase, scattered terms with enough evidence, or a close enough vector."""
    sure = (F.col("lane") == "semantic") & (F.col("score") >= cosine) | (F.col("lane") == "phrase") | (F.col("lane") == "all") & (F.col("evidence") >= evidence)
    return hits.filter(sure).orderBy("place").limit(1)


def composed(hits: DataFrame, *, most: int = 16, least: int = 4, per_family: int = 3, budget: int = 3584, fraction: float = 0.35) -> list[dict]:
    """A page from at most ``PAGE`` ranked rows: few of a family, one a turn, within a byte budget, nothing far below the best."""
    rows = [r.asDict() for r in hits.orderBy("place").limit(PAGE).collect()]
    best = max((r["score"] or 0 for r in rows), default=0)
    page, used, families, turns = [], 0, {}, set()
    for r in rows:
        family, turn, size = r.get("family") or r["session"], (r["session"], r["turn"]), len((r["snippet"] or "").encode())
        if len(page) >= most or families.get(family, 0) >= per_family or turn in turns:
            continue
        if len(page) >= least and ((r["score"] or 0) < fraction * best or used + size > budget):
            continue
        page.append(r)
        used += size
        families[family] = families.get(family, 0) + 1
        turns.add(turn)
    return page


def near_folded(hits: DataFrame, *, shingle: int = 5, least: float = 0.92, min_chars: int = 48) -> DataFrame:
    """Near copies on a page (at most a few hundred rows) fold into the better-placed row: Dice of word runs of five.

    Rows of the same speaker are compared; adds ``like``, the id of the row that represents a folded one (null if kept).
    """
    words = F.filter(F.split(F.lower("snippet"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    sh = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - shingle + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, shingle), " "))))
    rows = hits.filter(F.length("snippet") >= min_chars).select("id", "who", "place", sh.alias("sh"))
    cells = rows.select("id", "who", "place", "sh", F.explode("sh").alias("cell"))
    pairs = cells.alias("a").join(cells.alias("b"), (F.col("a.cell") == F.col("b.cell")) & F.col("a.who").eqNullSafe(F.col("b.who")) & (F.col("a.place") < F.col("b.place")))
    both = F.size(F.array_intersect("a.sh", "b.sh"))
    near = pairs.filter(2 * both / (F.size("a.sh") + F.size("b.sh")) >= least).groupBy(F.col("b.id").alias("id")).agg(F.min_by("a.id", "a.place").alias("like"))
    return hits.join(near, "id", "left")


def page_of(rows: DataFrame, limit: int = PAGE) -> DataFrame:
    return ranking.ranked(rows, limit)
