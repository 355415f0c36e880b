"""Registered queries of the core library: name -> query, and name -> DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.operators import hierarchy, incremental
from tracelode.plans.workspace import Workspace


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _family_sets(spark, sf_dir):
    family = _read(spark, sf_dir, "session_family").select(F.col("session").alias("node"))
    claims = hierarchy.first_claims(_read(spark, sf_dir, "raw_messages"), "session", "parent", ["turn", "rm_id"])
    return hierarchy.nested_sets(spark, family.join(claims, "node", "left"))


def p5_found(spark, sf_dir):
    return _family_sets(spark, sf_dir).select(F.col("node").alias("session"), "root", "depth")


def p5_paths(spark, sf_dir):
    """Full path and number of descendants of every session; null in cycles."""
    return _family_sets(spark, sf_dir).select(F.col("node").alias("session"), F.array_join("path", "/").alias("path"), (F.col("size") - 1).alias("descendants"))


def p5_descendants(spark, sf_dir):
    """Every session, and every parent outside the table, with each descendant and its distance, by their nested-set ranges; none in cycles."""
    sets = Workspace(spark, "family").save(_family_sets(spark, sf_dir), "sets")
    return hierarchy.descendants(sets, hierarchy.named(sets)).select("ancestor", F.col("node").alias("session"), "distance")


def p6_found(spark, sf_dir):
    """All runs from the first on: the target is a new one, so that the query always does the whole work."""
    work = Workspace(spark, "target")
    return incremental.changed_files(spark, _read(spark, sf_dir, "source_files"), _read(spark, sf_dir, "ingest_runs"), work.path)



_P5 = """
WITH RECURSIVE claims AS (
  SELECT session, lower(trim(parent)) AS parent, turn, rm_id FROM raw_messages WHERE trim(coalesce(parent, '')) <> ''),
link AS (
  SELECT f.session AS node, c.parent FROM session_family f LEFT JOIN (SELECT session, arg_min(parent, (turn, rm_id)) AS parent FROM claims GROUP BY session) c USING (session)),
up AS (
  SELECT node, node AS here, 0 AS depth, [node] AS seen, false AS looped FROM link
  UNION ALL
  SELECT u.node, l.parent, u.depth + 1, list_append(u.seen, l.parent), list_contains(u.seen, l.parent)
  FROM up u JOIN link l ON u.here = l.node WHERE l.parent IS NOT NULL AND NOT u.looped),
ends AS (SELECT node, arg_max({'here': here, 'depth': depth, 'seen': seen, 'looped': looped}, depth) AS e FROM up GROUP BY node),
flat AS (SELECT node, e.here AS here, e.depth AS depth, e.seen AS seen, e.looped AS looped FROM ends)
"""

PROBLEM_QUERIES = {"p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants, "p6_found": p6_found}

PROBLEM_SQL = {
    "p5_found": _P5 + """
SELECT node AS session, CASE WHEN looped THEN list_min(seen[list_position(seen, here):]) ELSE here END AS root, CAST(CASE WHEN looped THEN -1 ELSE depth END AS BIGINT) AS depth FROM flat""",
    "p5_paths": _P5 + """
, under AS (SELECT a AS node, count(*) - 1 AS n FROM (SELECT unnest(seen) AS a FROM flat WHERE NOT looped) GROUP BY a)
SELECT node AS session, CASE WHEN NOT looped THEN array_to_string(list_reverse(seen), '/') END AS path, CAST(CASE WHEN NOT looped THEN n END AS BIGINT) AS descendants
FROM flat LEFT JOIN under USING (node)""",
    "p5_descendants": _P5 + """
SELECT seen[i + 1] AS ancestor, node AS session, CAST(i AS BIGINT) AS distance FROM (SELECT node, seen, unnest(range(1, len(seen))) AS i FROM flat WHERE NOT looped)""",
    "p6_found": """
WITH obs AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.run_no, agent, path ORDER BY seen_at DESC, obs_id DESC) AS rn FROM source_files s JOIN ingest_runs r USING (run_no) WHERE r.status = 'ok'),
seq AS (
  SELECT *, lag(run_no) OVER w AS prev, lag(content_hash) OVER w AS h, lag(len) OVER w AS l, lag(mtime_secs) OVER w AS ms, lag(mtime_nanos) OVER w AS mn, lag(change_token) OVER w AS ct
  FROM obs WHERE rn = 1 WINDOW w AS (PARTITION BY agent, path ORDER BY run_no))
SELECT CAST(run_no AS BIGINT) AS run_no, agent, path FROM seq
WHERE prev IS NULL OR CASE WHEN h IS NOT NULL AND content_hash IS NOT NULL THEN h <> content_hash
  ELSE len IS DISTINCT FROM l OR mtime_secs IS DISTINCT FROM ms OR mtime_nanos IS DISTINCT FROM mn OR change_token IS DISTINCT FROM ct END""",
}

from tracelode import catalog_corpus, catalog_search, catalog_sources  # noqa: E402

QUERIES = {**catalog_search.QUERIES, **catalog_corpus.QUERIES, **catalog_sources.QUERIES, **PROBLEM_QUERIES}
SQL = {**catalog_search.SQL, **catalog_corpus.SQL, **catalog_sources.SQL, **PROBLEM_SQL}
FLAGSHIP = "search_ranked"
