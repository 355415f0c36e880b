"""Queries of filters, lexical lanes, ranking, vectors and fusion, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode import schema
from tracelode.operators import filters, fusion, lexical, ranking, semantic
from tracelode.operators.filters import QuerySpec
from tracelode.plans.workspace import Workspace
from tracelode.sources import tables

QUERIES: dict = {}
SQL: dict = {}


def _add(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# ---------------------------------------------------------------- filters

_FILTERS = {
    "filter_agent": (QuerySpec(agent="CODE"), "contains(lower(agent), 'code')"),
    "filter_project": (QuerySpec(project="ern"), "contains(lower(project), 'ern')"),
    "filter_exclude_project": (QuerySpec(exclude_project="sable"), "NOT contains(lower(coalesce(project, '')), 'sable')"),
    "filter_chat_prefix": (QuerySpec(chat="3"), "starts_with(lower(session), '3')"),
    "filter_who": (QuerySpec(who=("user", "human")), "who IN ('user', 'human')"),
    "filter_no_who": (QuerySpec(exclude_who=("tool", "control")), "who IS NULL OR who NOT IN ('tool', 'control')"),
    "filter_no_tools": (QuerySpec(tools=False), "who IS NULL OR who <> 'tool'"),
    "filter_model_exact": (QuerySpec(model="CEDAR-PRO"), "lower(model) = 'cedar-pro'"),
    "filter_model_soft": (QuerySpec(model_like="alder"), "contains(lower(model), 'alder')"),
    "filter_time_window": (QuerySpec(since=1704500000000, until=1705500000000), "coalesce(ts, 0) >= 1704500000000 AND coalesce(ts, 0) < 1705500000000"),
    "filter_exclude_session": (QuerySpec(exclude_sessions=("3475cc7b-8d6d-89ce-fa8d",)), "session IS NULL OR session <> '3475cc7b-8d6d-89ce-fa8d'"),
    "filter_exclude_window": (QuerySpec(caller="3475cc7b-8d6d-89ce-fa8d", caller_from_turn=20), "NOT coalesce(session = '3475cc7b-8d6d-89ce-fa8d' AND turn >= 20, false)"),
}
for _name, (_spec, _where) in _FILTERS.items():
    QUERIES[_name] = lambda spark, d, spec=_spec: filters.matching(tables.msgs(spark, d), spec).select("id", "session", "who")
    SQL[_name] = f"SELECT id, session, who FROM msgs WHERE {_where}"


@_add("filter_exclude_family", "WITH fam AS (SELECT session, coalesce(root, session) AS root FROM session_family), r AS (SELECT root FROM fam WHERE session = (SELECT min(session) FROM session_family WHERE root IS NOT NULL AND root <> session)) SELECT rm_id, session FROM raw_messages WHERE session NOT IN (SELECT session FROM fam JOIN r USING (root))")
def filter_exclude_family(spark, d):
    fam = tables.families(spark, d)
    one = tables.table(spark, d, "session_family").filter("root is not null and root <> session").agg(F.min("session")).first()[0]
    return filters.without_family(tables.messages(spark, d), fam, one or "").select("rm_id", "session")


@_add("filter_coverage", "SELECT count(*) AS rows, count(*) FILTER (who = 'user') AS kept, count(DISTINCT session) AS chats, count(DISTINCT session) FILTER (who = 'user') AS kept_chats FROM msgs")
def filter_coverage(spark, d):
    return filters.coverage(tables.msgs(spark, d), QuerySpec(who=("user",)))


@_add("dimension_census", "WITH p AS (SELECT unnest(['agent', 'project', 'who', 'model', 'concept']) AS dimension, unnest([agent, project, who, model, concept]) AS value FROM msgs) SELECT dimension, value, count(*) AS rows FROM p WHERE value <> '' GROUP BY ALL")
def dimension_census(spark, d):
    return filters.census(tables.msgs(spark, d))


# ---------------------------------------------------------------- lanes

_PHRASE = r"publish[^\p{L}\p{N}]*marker"
_OPEN = r"open[^\p{L}\p{N}]*snapshot"
_SNIP = """CASE WHEN p > 81 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, greatest(p - 80, 1), least(p + n + 79, length(text)) - greatest(p - 80, 1) + 1), '[\\s\\p{Z}]+', ' ', 'g')) || CASE WHEN p + n + 79 < length(text) THEN '…' ELSE '' END"""


def _hits_sql(pattern: str, extra: str = "true") -> str:
    return f"""hits AS (SELECT *, {_SNIP} AS snippet FROM (SELECT *, strpos(text, regexp_extract(text, '(?i){pattern}')) AS p, length(regexp_extract(text, '(?i){pattern}')) AS n FROM msgs WHERE regexp_matches(text, '(?i){pattern}') AND {extra}))"""


@_add("keyword_single", "SELECT id, session, turn, who FROM msgs WHERE contains(lower(text), 'lease')")
def keyword_single(spark, d):
    return lexical.phrase(tables.msgs(spark, d), QuerySpec("Lease")).select("id", "session", "turn", "who")


@_add("keyword_phrase", f"SELECT id, session, turn, who FROM msgs WHERE regexp_matches(text, '(?i){_PHRASE}')")
def keyword_phrase(spark, d):
    return lexical.phrase(tables.msgs(spark, d), QuerySpec("publish marker")).select("id", "session", "turn", "who")


@_add("keyword_all_terms", "SELECT id, session FROM msgs WHERE contains(lower(text), 'retry') AND contains(lower(text), 'commit')")
def keyword_all_terms(spark, d):
    return lexical.all_terms(tables.msgs(spark, d), QuerySpec("retry commit")).select("id", "session")


@_add("keyword_terms_merged", f"SELECT id, CASE WHEN NOT regexp_matches(text, '(?i){_OPEN}') THEN 'all-terms' END AS matched FROM msgs WHERE contains(lower(text), 'open') AND contains(lower(text), 'snapshot')")
def keyword_terms_merged(spark, d):
    return lexical.merged(tables.msgs(spark, d), QuerySpec("open snapshot")).select("id", "matched")


@_add("word_search", r"SELECT id FROM msgs WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])page($|[^\p{L}\p{N}_])')")
def word_search(spark, d):
    return lexical.word(tables.msgs(spark, d), QuerySpec("page")).select("id")


@_add("regex_search", r"SELECT id FROM msgs WHERE regexp_matches(text, '(?i)needed [0-9]{2} edits')")
def regex_search(spark, d):
    return lexical.regex(tables.msgs(spark, d), QuerySpec("needed [0-9]{2} edits")).select("id")


@_add("regex_literal_prefilter", r"SELECT id FROM msgs WHERE regexp_matches(text, '(?i)exit code [0-9]+\n?$')")
def regex_literal_prefilter(spark, d):
    return lexical.regex(tables.msgs(spark, d), QuerySpec(r"exit code [0-9]+$")).select("id")


@_add("snippets", f"WITH {_hits_sql(_PHRASE)} SELECT id, snippet FROM hits")
def snippets(spark, d):
    return lexical.phrase(tables.msgs(spark, d), QuerySpec("publish_marker")).select("id", "snippet")


_SPANS = r"""WITH h AS (SELECT id, text, [strpos(lower(text), 'lease'), strpos(lower(text), 'never'), strpos(lower(text), 'path')] AS spots, [5, 5, 4] AS sizes FROM msgs WHERE contains(lower(text), 'lease') AND contains(lower(text), 'never') AND contains(lower(text), 'path')),
w AS (SELECT id, text, list_sort(list_transform([1, 2, 3], lambda i: {'a': greatest(spots[i] - 80, 1), 'b': least(spots[i] + sizes[i] + 79, length(text))})) AS w FROM h),
j AS (SELECT *, w[2].a <= w[1].b + 1 AS j2, greatest(w[1].b, w[2].b) AS b2 FROM w),
r AS (SELECT id, text, CASE WHEN j2 AND w[3].a <= b2 + 1 THEN [{'a': w[1].a, 'b': greatest(b2, w[3].b)}] WHEN j2 THEN [{'a': w[1].a, 'b': b2}, w[3]] WHEN w[3].a <= w[2].b + 1 THEN [w[1], {'a': w[2].a, 'b': greatest(w[2].b, w[3].b)}] ELSE w END AS r FROM j)
SELECT id, CASE WHEN r[1].a > 1 THEN '…' ELSE '' END || array_to_string(list_transform(r, lambda x: trim(regexp_replace(substr(text, x.a, x.b - x.a + 1), '[\s\p{Z}]+', ' ', 'g'))), '…') || CASE WHEN r[-1].b < length(text) THEN '…' ELSE '' END AS snippet FROM r"""


@_add("snippets_multi_span", _SPANS)
def snippets_multi_span(spark, d):
    return lexical.all_terms(tables.msgs(spark, d), QuerySpec("lease never path")).select("id", "snippet")


@_add("content_idf", """WITH c AS (SELECT count(*) AS n, count(*) FILTER (contains(lower(text), 'boundary')) AS d1, count(*) FILTER (contains(lower(text), 'scorer')) AS d2, count(*) FILTER (contains(lower(text), 'zebra')) AS d3, count(*) FILTER (contains(lower(text), 'drains')) AS d4 FROM msgs),
i AS (SELECT ln(1 + n / (d1 + 1)) AS i1, ln(1 + n / (d2 + 1)) AS i2, ln(1 + n / (d3 + 1)) AS i3, ln(1 + n / (d4 + 1)) AS i4 FROM c),
s AS (SELECT id, session, turn, text, round(((CASE WHEN contains(lower(text), 'boundary') THEN i1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'scorer') THEN i2 ELSE 0 END) + (CASE WHEN contains(lower(text), 'zebra') THEN i3 ELSE 0 END) + (CASE WHEN contains(lower(text), 'drains') THEN i4 ELSE 0 END)) / (i1 + i2 + i3 + i4), 4) AS coverage, i1, i2, i3, i4 FROM msgs, i)
SELECT id, coverage FROM s WHERE (contains(lower(text), 'boundary') OR contains(lower(text), 'scorer') OR contains(lower(text), 'zebra') OR contains(lower(text), 'drains'))
 AND (SELECT count(*) FROM (SELECT unnest(list_slice(list_reverse_sort([{'i': i1, 'o': -1, 't': 'boundary'}, {'i': i2, 'o': -2, 't': 'scorer'}, {'i': i3, 'o': -3, 't': 'zebra'}, {'i': i4, 'o': -4, 't': 'drains'}]), 1, 3)) AS a) WHERE contains(lower(text), a.t)) > 0""")
def content_idf(spark, d):
    return lexical.content(tables.msgs(spark, d), QuerySpec("boundary scorer zebra drains")).select("id", "coverage")


@_add("coverage_bm25", """WITH t AS (SELECT *, lower(text) AS low, greatest(length(text) - 2, 0) AS dl FROM msgs WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (contains(low, 'shadow')) AS d1, count(*) FILTER (contains(low, 'rows')) AS d2 FROM t),
w AS (SELECT *, greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) AS w1, greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) AS w2 FROM s),
f AS (SELECT t.*, w.*, (length(low) - length(replace(low, 'shadow', ''))) / 6 AS f1, (length(low) - length(replace(low, 'rows', ''))) / 4 AS f2 FROM t, w)
SELECT id, round(w1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) + w2 * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM f WHERE f1 + f2 > 0""")
def coverage_bm25(spark, d):
    return lexical.bm25(tables.msgs(spark, d), QuerySpec("shadow rows")).select("id", "score")


_LONG = "reply buffer in some ticket needed edits unless the session is a side chat"


def _overspec_sql() -> str:
    terms = list(dict.fromkeys(_LONG.split()))
    usable = [i for i, t in enumerate(terms) if len(t) >= 3]
    each = lambda f, which=range(len(terms)): ", ".join(f(i, terms[i]) for i in which)
    plus = lambda f, which=range(len(terms)): " + ".join(f(i, terms[i]) for i in which)
    return f"""WITH t AS (SELECT *, lower(text) AS low, greatest(length(text) - 2, 0) AS dl FROM msgs WHERE text IS NOT NULL),
c AS (SELECT count(*) AS n, avg(dl) AS avgdl, {each(lambda i, t: f"count(*) FILTER (contains(low, '{t}')) AS d{i}")} FROM t),
w AS (SELECT *, {each(lambda i, t: f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) AS w{i}", usable)}, {each(lambda i, t: f"ln(1 + n / ({f'd{i}' if i in usable else 'n'} + 1)) AS i{i}")} FROM c),
f AS (SELECT t.*, w.*, {each(lambda i, t: f"(length(low) - length(replace(low, '{t}', ''))) / {len(t)} AS f{i}")} FROM t, w),
s AS (SELECT id, session, ts, turn, who, low, round({plus(lambda i, t: f"w{i} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))", usable)}, 6) AS score,
  round(({plus(lambda i, t: f"(CASE WHEN f{i} > 0 THEN i{i} ELSE 0 END)")}) / ({plus(lambda i, t: f"i{i}")}), 4) AS coverage_mass FROM f WHERE {plus(lambda i, t: f"f{i}", usable)} > 0),
h AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY {_RANKED}) AS rn FROM s WHERE session IS NOT NULL AND coverage_mass >= 0.55 AND NOT regexp_matches(low, '{"[^\\p{L}\\p{N}]*".join(terms)}'))
SELECT id, session, score, coverage_mass FROM h WHERE rn = 1 ORDER BY score DESC, session LIMIT 5"""


_RANKED = "score DESC, coalesce(ts, 0) DESC, coalesce(turn, -1), coalesce(who, ''), id"


@_add("overspec_retry", _overspec_sql())
def overspec_retry(spark, d):
    """Rows that cover much of an over-specified query without quoting it, at most one a session."""
    hits = lexical.bm25(tables.msgs(spark, d), QuerySpec(_LONG))
    good = hits.filter(~F.col("query_echo") & (F.col("coverage_mass") >= 0.55)).withColumn("matched", F.lit("content-terms"))
    return ranking.heads(good, "session").orderBy(F.desc("score"), "session").limit(5).select("id", "session", "score", "coverage_mass")


@_add("term_session_df", "WITH s AS (SELECT session, bool_or(coalesce(contains(lower(text), 'lease'), false)) AS a, bool_or(coalesce(contains(lower(text), 'ticket'), false)) AS b FROM msgs WHERE session IS NOT NULL GROUP BY session) SELECT 'lease' AS term, round(count(*) FILTER (a) / count(*), 6) AS share FROM s UNION ALL SELECT 'ticket', round(count(*) FILTER (b) / count(*), 6) FROM s")
def term_session_df(spark, d):
    return lexical.session_frequencies(tables.msgs(spark, d), ["lease", "ticket"])


@_add("keyword_count", "SELECT count(*) AS total, count(DISTINCT session) AS chats, count(*) FILTER (who = 'tool') AS tool_hits FROM msgs WHERE contains(lower(text), 'path') AND contains(lower(text), 'limit')")
def keyword_count(spark, d):
    return lexical.counts(tables.msgs(spark, d), QuerySpec("path limit"))


@_add("keyword_count_capped", "SELECT least(count(*), 100) AS floor, count(*) <= 100 AS exact FROM msgs WHERE contains(lower(text), 'path')")
def keyword_count_capped(spark, d):
    return lexical.counts_up_to(tables.msgs(spark, d), QuerySpec("path"), 100)


@_add("short_token", "SELECT id FROM msgs WHERE contains(lower(text), 'ok')")
def short_token(spark, d):
    return lexical.phrase(tables.msgs(spark, d), QuerySpec("OK")).select("id")


@_add("corpus_anchor", "SELECT unnest(['lease', 'zebra']) AS word, unnest([bool_or(coalesce(contains(lower(text), 'lease'), false)), bool_or(coalesce(contains(lower(text), 'zebra'), false))]) AS present FROM msgs")
def corpus_anchor(spark, d):
    return lexical.anchors_present(tables.msgs(spark, d), "where is the lease zebra")


@_add("session_term_turns", "SELECT session, turn, CAST(max(CAST(coalesce(contains(lower(text), 'lease'), false) AS INT)) + max(CAST(coalesce(contains(lower(text), 'released'), false) AS INT)) AS INT) AS terms FROM msgs WHERE session IS NOT NULL GROUP BY ALL HAVING terms > 0")
def session_term_turns(spark, d):
    return lexical.term_turns(tables.msgs(spark, d), ["lease", "released"])


@_add("session_text_sizes", "SELECT session, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM msgs WHERE session IS NOT NULL AND (who IS NULL OR who <> 'tool') GROUP BY session")
def session_text_sizes(spark, d):
    return lexical.text_sizes(tables.msgs(spark, d))


# ---------------------------------------------------------------- ranking

_WEIGHED = f"""greatest(pow(0.5, greatest(0, {schema.NOW_MS} - coalesce(ts, 0)) / 86400000.0 / 14.0), CASE WHEN who = 'user' THEN 0.35 ELSE 0 END) AS rec,
  CASE who WHEN 'user' THEN 1.0 WHEN 'subagent' THEN 0.85 WHEN 'agent' THEN 0.8 WHEN 'tool' THEN 0.4 ELSE 0.5 END AS ww,
  CASE who WHEN 'subagent' THEN 0.85 WHEN 'recap' THEN 0.65 WHEN 'control' THEN 0.65 WHEN 'synthetic' THEN 0.60 WHEN 'harness' THEN 0.60 WHEN 'tool' THEN 0.55 ELSE 1.0 END AS ss,
  CASE WHEN who IN ('harness', 'synthetic') OR (who = 'subagent' AND turn = 0) THEN 0.45 ELSE 1.0 END AS mm"""


def _scored_sql(pattern: str, letters: int, quality: str = "1.0", accidental: float = 0.0) -> str:
    """Hits of a pattern with their scores; ``quality`` says how well the hit is aligned, ``accidental`` what that counts."""
    return f"""{_hits_sql(pattern)},
m AS (SELECT *, list_transform(regexp_extract_all(snippet, '(?i){pattern}'), lambda x: length(x)) AS ls, CAST({quality} AS DOUBLE) AS q FROM hits),
scored AS (SELECT *, CASE WHEN len(ls) > 0 THEN least(1.0, {letters}.0 / list_min(ls)) * (1 - pow(0.5, len(ls))) ELSE 0 END AS m0, greatest(0.12, 1 - {accidental} * (1 - q)) AS b,
  CASE WHEN q = 1 THEN 'aligned' WHEN q = 0 THEN 'interior' ELSE 'partial' END AS boundary_class, {_WEIGHED} FROM m),
ranked AS (SELECT *, round(CAST(m0 * rec * ww * b * ss * mm AS DOUBLE), 4) AS score FROM scored)"""


def _word_quality(word: str, column: str = "snippet") -> str:
    """SQL of the alignment of a lower-case word in a text.  RE2 looks at no neighbours, so each side is spelled out with them."""
    any_case = lambda t: "".join(f"[{c}{c.upper()}]" for c in t)
    f, s, z, body = word[0], word[1], word[-1], any_case(word[1:-1])
    apart = r"[^\p{Latin}\p{Nd}\p{M}''’ʼ…]"
    begin = rf"(?:(?:^|{apart}|(?:^|[^\p{{L}}])[''’ʼ]|\p{{Nd}})[{f}{f.upper()}]{body}|\p{{Ll}}{f.upper()}{body}|\p{{Lu}}{f.upper()}{s}{any_case(word[2:-1])})"
    end = rf"(?:[{z}{z.upper()}](?:$|{apart}|[''’ʼ](?:$|[^\p{{L}}])|\p{{Nd}})|{z}\p{{Lu}}|{z.upper()}\p{{Lu}}\p{{Ll}})"
    return f"CASE WHEN regexp_matches({column}, '{begin}{end}') THEN 1.0 WHEN regexp_matches({column}, '{begin}[{z}{z.upper()}]') OR regexp_matches({column}, '{any_case(word[:-1])}{end}') THEN 0.5 ELSE 0.0 END"


_SCORED = _scored_sql(_OPEN, 12)
_LEASE = _scored_sql("lease", 5, _word_quality("lease"), 0.05)
_ORDER = "score DESC, coalesce(ts, 0) DESC, session ASC NULLS FIRST, coalesce(turn, -1), coalesce(who, ''), id"


def _scored(spark, d):
    spec = QuerySpec("open_snapshot", limit=20)
    return ranking.scored(lexical.phrase(tables.msgs(spark, d), spec), spec, boundaries=False), spec


@_add("search_ranked", f"WITH {_SCORED} SELECT id, session, turn, who, snippet, score FROM ranked ORDER BY {_ORDER} LIMIT 20")
def search_ranked(spark, d):
    hits, spec = _scored(spark, d)
    return ranking.page(hits, spec).select("id", "session", "turn", "who", "snippet", "score")


@_add("search_boundaries", f"WITH {_LEASE} SELECT id, session, turn, who, score, round(CAST(m0 * b AS DOUBLE), 6) AS evidence, boundary_class FROM ranked ORDER BY {_ORDER} LIMIT 200")
def search_boundaries(spark, d):
    """The ranked page with border factors: a word that stands alone, in longer words and beside them."""
    spec = QuerySpec("lease", limit=200)
    return ranking.page(ranking.scored(lexical.merged(tables.msgs(spark, d), spec), spec), spec).select("id", "session", "turn", "who", "score", "evidence", "boundary_class")


@_add("search_evidence", f"WITH {_SCORED} SELECT id, round(CAST(m0 AS DOUBLE), 6) AS evidence FROM ranked")
def search_evidence(spark, d):
    return _scored(spark, d)[0].select("id", "evidence")


@_add("sort_time", f"WITH {_SCORED} SELECT id, ts FROM ranked ORDER BY coalesce(ts, 0) DESC, session ASC NULLS FIRST, coalesce(turn, -1), coalesce(who, ''), id LIMIT 20")
def sort_time(spark, d):
    hits, _ = _scored(spark, d)
    return ranking.page(hits, QuerySpec("open_snapshot", limit=20, sort="time")).select("id", "ts")


@_add("sort_position", f"WITH {_SCORED} SELECT id, session, turn FROM ranked ORDER BY session ASC NULLS FIRST, coalesce(turn, -1), id LIMIT 20")
def sort_position(spark, d):
    hits, _ = _scored(spark, d)
    return ranking.page(hits, QuerySpec("open_snapshot", limit=20, sort="position")).select("id", "session", "turn")


@_add("session_heads", f"WITH {_SCORED}, h AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY {_ORDER}) AS rn, count(*) OVER (PARTITION BY session) AS hits FROM ranked WHERE session IS NOT NULL) SELECT session, id, score, hits FROM h WHERE rn = 1")
def session_heads(spark, d):
    hits, _ = _scored(spark, d)
    return ranking.heads(hits, "session").select("session", "id", "score", "hits")


@_add("project_heads", f"WITH {_SCORED}, h AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY {_ORDER}) AS rn, count(*) OVER (PARTITION BY project) AS hits FROM ranked WHERE project IS NOT NULL) SELECT project, id, score, hits FROM h WHERE rn = 1")
def project_heads(spark, d):
    hits, _ = _scored(spark, d)
    return ranking.heads(hits, "project").select("project", "id", "score", "hits")


@_add("meta_demote", f"WITH {_SCORED}, p AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS pl FROM ranked), f AS (SELECT *, mm < 1 AS meta FROM p WHERE pl <= 40) SELECT id, meta, CAST(row_number() OVER (ORDER BY meta, pl) - 1 AS INT) AS place FROM f")
def meta_demote(spark, d):
    hits, _ = _scored(spark, d)
    return fusion.meta_last(fusion.page_of(hits)).select("id", "meta", "place")


@_add("count_by_tier", f"WITH {_LEASE} SELECT CASE boundary_class WHEN 'aligned' THEN 'phrase_aligned' ELSE boundary_class END AS tier, count(*) AS rows FROM ranked GROUP BY ALL")
def count_by_tier(spark, d):
    spec = QuerySpec("lease")
    return ranking.tiers(ranking.scored(lexical.merged(tables.msgs(spark, d), spec), spec))


# ---------------------------------------------------------------- vectors

_QV = "q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"
_COS = f"""{_QV}, v AS (SELECT vec_id, label, list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(qv, lambda x: x::DOUBLE)) / (sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) * sqrt(list_dot_product(list_transform(qv, lambda x: x::DOUBLE), list_transform(qv, lambda x: x::DOUBLE)))) AS c FROM embeddings, q),
s AS (SELECT vec_id, label, round(c, 6) AS score FROM v)"""


def _query_vector(spark, d):
    v = tables.vectors(spark, d)
    return v, [float(x) for x in v.orderBy("vec_id").first()["vec"]]


@_add("semantic_flat_topk", f"WITH {_COS} SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 10")
def semantic_flat_topk(spark, d):
    v, q = _query_vector(spark, d)
    return semantic.topk(semantic.similar(v, q), 10, ["vec_id"]).select("vec_id", "score")


@_add("semantic_grouped_topk", f"WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s), b AS (SELECT label FROM r WHERE rank = 1 ORDER BY score DESC, vec_id LIMIT 4) SELECT vec_id, label, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3 AND label IN (SELECT label FROM b)")
def semantic_grouped_topk(spark, d):
    v, q = _query_vector(spark, d)
    return semantic.grouped_topk(semantic.similar(v, q), "label", 4, 3, ["vec_id"]).select("vec_id", "label", "score", F.col("rank").cast("int").alias("rank"))


@_add("q8_quantize", "WITH m AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS t FROM embeddings) SELECT vec_id, list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 127 / t) AS INT)) AS q FROM m")
def q8_quantize(spark, d):
    return semantic.stored_q8(tables.vectors(spark, d), 64).select("vec_id", F.col("q").cast("array<int>").alias("q"))


@_add("q8_topk_rerank", f"WITH {_COS} SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 5")
def q8_topk_rerank(spark, d):
    v, q = _query_vector(spark, d)
    return semantic.quantised_topk(v, q, 5, ["vec_id"]).select("vec_id", "score")


@_add("q8_session_pool", f"WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s), b AS (SELECT label FROM r WHERE rank = 1 ORDER BY score DESC, vec_id LIMIT 3) SELECT vec_id, label, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 4 AND label IN (SELECT label FROM b)")
def q8_session_pool(spark, d):
    v, q = _query_vector(spark, d)
    stored = Workspace(spark, "q8").save(semantic.stored_q8(v, len(q)), "q8")
    return semantic.session_pool(stored, q, 3, 4, "label", ["vec_id"]).select("vec_id", "label", "score", F.col("rank").cast("int").alias("rank"))


_REF_COS = """f AS (SELECT row_ref, batch, vec FROM pending_vectors WHERE len(vec) = 96 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_max(list_transform(vec, lambda x: abs(x))) > 0),
v AS (SELECT row_ref, arg_min(vec, batch) AS vec FROM f GROUP BY row_ref), q AS (SELECT list_transform(vec, lambda x: x::DOUBLE) AS qv FROM v WHERE row_ref = (SELECT min(row_ref) FROM v)),
s AS (SELECT row_ref, round(list_dot_product(list_transform(vec, lambda x: x::DOUBLE), qv) / (sqrt(list_dot_product(list_transform(vec, lambda x: x::DOUBLE), list_transform(vec, lambda x: x::DOUBLE))) * sqrt(list_dot_product(qv, qv))), 6) AS score FROM v, q)"""


def _ref_vectors(spark, d):
    """(row_ref, vec): the first usable vector of each reference, and the query vector, that of the first reference."""
    from tracelode.operators import semantic as sem

    pending = tables.table(spark, d, "pending_vectors").filter("size(vec) = 96")
    usable = sem.stored_q8(pending, 96).filter("inv_norm > 0")
    first = usable.groupBy("row_ref").agg(F.min_by(F.struct("vec", "q", "inv_norm"), "batch").alias("r")).select("row_ref", "r.*")
    return first, [float(x) for x in first.orderBy("row_ref").first()["vec"]]


@_add("semantic_filtered", f"WITH {_REF_COS} SELECT row_ref, score FROM s JOIN refs USING (row_ref) WHERE source_kind = 1 AND turn < 20 ORDER BY score DESC, row_ref LIMIT 25")
def semantic_filtered(spark, d):
    """The best vectors among the replies of early turns."""
    v, q = _ref_vectors(spark, d)
    rows = semantic.filtered(v, tables.table(spark, d, "refs"), "row_ref", (F.col("source_kind") == 1) & (F.col("turn") < 20))
    return semantic.topk(semantic.similar(rows, q), 25, ["row_ref"]).select("row_ref", "score")


@_add("semantic_text_dedup", f"WITH {_REF_COS}, t AS (SELECT text_hash, min(row_ref) AS row_ref FROM refs JOIN v USING (row_ref) GROUP BY text_hash) SELECT row_ref, text_hash, score FROM s JOIN t USING (row_ref) ORDER BY score DESC, row_ref LIMIT 10")
def semantic_text_dedup(spark, d):
    """The ten best texts, each by its first reference."""
    v, q = _ref_vectors(spark, d)
    rows = v.join(tables.table(spark, d, "refs").select("row_ref", "text_hash"), "row_ref")
    return semantic.quantised_topk(rows, q, 10, ["row_ref"], text_key="text_hash").select("row_ref", "text_hash", "score")


@_add("semantic_policy_counts", f"WITH {_COS}, w AS (SELECT score, CASE label % 3 WHEN 0 THEN 'recap' WHEN 1 THEN 'user' ELSE 'agent' END AS who FROM s) SELECT count(*) AS rows, count(*) FILTER (who <> 'recap') AS accepted, count(*) FILTER (who <> 'recap' AND score < 0.82) AS weak, count(*) FILTER (who <> 'recap' AND score >= 0.84) AS strong, count(*) FILTER (who = 'recap') AS machine FROM w")
def semantic_policy_counts(spark, d):
    v, q = _query_vector(spark, d)
    who = F.when(F.col("label") % 3 == 0, "recap").when(F.col("label") % 3 == 1, "user").otherwise("agent")
    return semantic.policy(semantic.similar(v, q).withColumn("who", who))


@_add("semantic_coverage", "WITH k AS (SELECT DISTINCT text_hash FROM refs), v AS (SELECT DISTINCT text_hash FROM refs JOIN pending_vectors USING (row_ref) WHERE vec IS NOT NULL) SELECT count(*) AS total, count(v.text_hash) AS indexed, round(count(v.text_hash) / count(*), 6) AS share FROM k LEFT JOIN v USING (text_hash)")
def semantic_coverage(spark, d):
    refs = tables.table(spark, d, "refs")
    have = refs.join(tables.table(spark, d, "pending_vectors").filter("vec is not null").select("row_ref"), "row_ref", "left_semi")
    return semantic.index_coverage(refs, have, "text_hash")


@_add("summary_chats", "WITH f AS (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) SELECT label, i AS at, round(avg(x::DOUBLE), 6) AS mean FROM f GROUP BY label, i")
def summary_chats(spark, d):
    s = semantic.summaries(tables.vectors(spark, d), "label")
    return s.select("label", F.posexplode("vec").alias("at", "x")).select("label", F.col("at").cast("bigint").alias("at"), F.round("x", 6).alias("mean"))


@_add("segments_live_rows", "WITH n AS (SELECT row_ref, max(batch) AS batch FROM pending_vectors GROUP BY row_ref) SELECT row_ref, batch FROM n WHERE row_ref NOT IN (SELECT row_ref FROM pending_vectors WHERE vec IS NULL)")
def segments_live_rows(spark, d):
    v = tables.table(spark, d, "pending_vectors").select("row_ref", "batch", "vec")
    return semantic.live_rows(v, v.filter("vec is null"), "row_ref", "batch").select("row_ref", "batch")


# ---------------------------------------------------------------- fusion

@_add("pack_multi_query", r"SELECT 0 AS query_no, id, regexp_matches(text, '(?i)shadow[^\p{L}\p{N}]*rows') AS phrase FROM msgs WHERE contains(lower(text), 'shadow') AND contains(lower(text), 'rows') UNION ALL SELECT 1, id, regexp_matches(text, '(?i)tree[^\p{L}\p{N}]*walk') FROM msgs WHERE contains(lower(text), 'tree') AND contains(lower(text), 'walk')")
def pack_multi_query(spark, d):
    return fusion.packed(tables.msgs(spark, d), ["shadow rows", "tree walk"]).select("query_no", "id", "phrase")


_TWO = f"""WITH a AS (WITH {_LEASE} SELECT 0 AS query_no, id, session, score, row_number() OVER (ORDER BY {_ORDER}) AS place FROM ranked), b AS (WITH {_scored_sql("ticket", 6, _word_quality("ticket"), 0.05)} SELECT 1 AS query_no, id, session, score, row_number() OVER (ORDER BY {_ORDER}) AS place FROM ranked),
both_ AS (SELECT * FROM a WHERE place <= 40 UNION ALL SELECT * FROM b WHERE place <= 40),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY place, query_no) AS rn FROM both_) WHERE rn = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY place) AS round FROM (SELECT *, row_number() OVER (PARTITION BY query_no, session ORDER BY place) AS fn FROM s) WHERE fn = 1)
SELECT query_no, id, session, score FROM f ORDER BY round, query_no LIMIT 8"""


@_add("recall_select", _TWO)
def recall_select(spark, d):
    spec = [QuerySpec("lease"), QuerySpec("ticket")]
    pages = [fusion.page_of(ranking.scored(lexical.merged(tables.msgs(spark, d), s), s)).withColumn("query_no", F.lit(n)).withColumn("family", F.col("session")) for n, s in enumerate(spec)]
    return fusion.recalled(pages[0].unionByName(pages[1]), 8).select("query_no", "id", "session", "score")


@_add("exact_fold", f"WITH {_SCORED}, p AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS pl FROM ranked), g AS (SELECT *, first_value(session) OVER (PARTITION BY content_digest, snippet, who ORDER BY mm < 1, pl) AS rep FROM p WHERE pl <= 200 AND content_digest IS NOT NULL AND (who IS NULL OR who <> 'tool')) SELECT id FROM g WHERE session IS NOT DISTINCT FROM rep UNION ALL SELECT id FROM p WHERE pl <= 200 AND NOT (content_digest IS NOT NULL AND (who IS NULL OR who <> 'tool'))")
def exact_fold(spark, d):
    hits, _ = _scored(spark, d)
    return fusion.folded(fusion.page_of(hits, 200)).select("id")


_NEAR = rf"""WITH {_SCORED}, p AS (SELECT id, who, snippet, row_number() OVER (ORDER BY {_ORDER}) AS pl FROM ranked), h AS (SELECT * FROM p WHERE pl <= 200),
w AS (SELECT id, who, pl, list_filter(regexp_split_to_array(lower(snippet), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM h WHERE length(snippet) >= 48),
s AS (SELECT id, who, pl, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh FROM w),
n AS (SELECT b.id, arg_min(a.id, a.pl) AS "like" FROM s a JOIN s b ON a.who IS NOT DISTINCT FROM b.who AND a.pl < b.pl AND 2 * len(list_intersect(a.sh, b.sh)) / (len(a.sh) + len(b.sh)) >= 0.92 GROUP BY b.id)
SELECT id, "like" FROM h LEFT JOIN n USING (id)"""


@_add("near_fold", _NEAR)
def near_fold(spark, d):
    hits, _ = _scored(spark, d)
    return fusion.near_folded(fusion.page_of(hits, 200)).select("id", "like")


_HYBRID = f"""WITH {_REF_COS}, near AS (SELECT row_ref AS id, session, turn, CASE WHEN source_kind = 0 THEN 'user' ELSE 'agent' END AS who, score FROM s JOIN refs USING (row_ref) ORDER BY score DESC, row_ref LIMIT 40),
l AS (WITH {_SCORED} SELECT id, session, turn, who, snippet, score, round(CAST(m0 AS DOUBLE), 6) < 0.25 AS weak, row_number() OVER (ORDER BY {_ORDER}) - 1 AS place FROM ranked QUALIFY place < 40),
x AS (SELECT *, count(*) FILTER (NOT weak) OVER () AS strong FROM l),
v3 AS (SELECT * FROM near n WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.session = n.session AND l.turn = n.turn) ORDER BY score DESC, id LIMIT 3),
u AS (SELECT id, session, turn, who, snippet, score, 'lexical' AS lane, CASE WHEN strong > 0 AND place < least(3, strong) THEN 0 ELSE 2 END AS slot, CAST(place AS DOUBLE) AS rank FROM x UNION ALL SELECT id, session, turn, who, NULL, score, 'semantic', 1, -score FROM v3)
SELECT id, session, turn, who, snippet, score, lane, CAST(row_number() OVER (ORDER BY slot, rank, id) - 1 AS INT) AS place FROM u QUALIFY place < 40"""


@_add("hybrid_merge", _HYBRID)
def hybrid_merge(spark, d):
    """Lexical page with vector rows: the vectors' texts are msgs rows by their reference."""
    hits, spec = _scored(spark, d)
    v, q = _ref_vectors(spark, d)
    near = semantic.topk(semantic.similar(v.join(tables.table(spark, d, "refs"), "row_ref"), q), 40, ["row_ref"])
    rows = near.select(F.col("row_ref").alias("id"), "session", "turn", F.when(F.col("source_kind") == 0, "user").otherwise("agent").alias("who"), F.lit(None).cast("string").alias("snippet"), "score")
    return fusion.hybrid(fusion.page_of(hits), rows)


_PAGED = f"WITH {_LEASE}, p AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS pl FROM ranked)"


@_add("diversify", f"{_PAGED}, n AS (SELECT *, CASE WHEN session IS NULL OR row_number() OVER (PARTITION BY session ORDER BY pl) > 1 THEN 1 ELSE 0 END AS nth FROM p WHERE pl <= 40) SELECT id, 'phrase' AS lane, CAST(row_number() OVER (ORDER BY mm < 1, nth, pl) - 1 AS INT) AS place FROM n")
def diversify(spark, d):
    spec = QuerySpec("lease")
    page = fusion.page_of(ranking.scored(lexical.merged(tables.msgs(spark, d), spec), spec))
    lanes = page.withColumn("lane", F.when(F.col("matched") == "all-terms", "all").otherwise("phrase")).withColumn("family", F.col("session"))
    return fusion.diversified(lanes).select("id", "lane", "place")


@_add("probe_pointer", f"WITH {_SCORED} SELECT id, session, turn, score FROM ranked ORDER BY {_ORDER} LIMIT 1")
def probe_pointer(spark, d):
    hits, _ = _scored(spark, d)
    return fusion.probe(fusion.page_of(hits).withColumn("lane", F.lit("phrase"))).select("id", "session", "turn", "score")


@_add("compose_page")
def compose_page(spark, d):
    hits, _ = _scored(spark, d)
    rows = fusion.composed(fusion.page_of(hits).withColumn("family", F.col("session")))
    return spark.createDataFrame([(i, r["id"], r["session"], r["score"]) for i, r in enumerate(rows)], "place int, id bigint, session string, score double")


_ECHO = r"open[^\p{L}\p{N}]*snapshot[^\p{L}\p{N}]*behind[^\p{L}\p{N}]*a[^\p{L}\p{N}]*flag"


@_add("query_echoes", f"WITH {_SCORED}, p AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS pl, regexp_matches(text, '(?i){_ECHO}') AS echo FROM ranked) SELECT id, echo, CAST(row_number() OVER (ORDER BY echo, pl) - 1 AS INT) AS place FROM p WHERE pl <= 40")
def query_echoes(spark, d):
    hits, _ = _scored(spark, d)
    return fusion.echoes_last(fusion.page_of(hits), "open_snapshot behind a flag").select("id", "echo", "place")
