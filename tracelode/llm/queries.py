"""Registered queries of this subpackage: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.llm import conversations as _conv
from tracelode.llm import dedup_ledger as _ledger
from tracelode.llm import language as _language
from tracelode.llm import leakage as _leakage
from tracelode.llm import neighbours as _near
from tracelode.llm import pairs as _pairs
from tracelode.llm import tokenization as _tokens
from tracelode.llm import truncation as _truncation
from tracelode.plans.workspace import Workspace


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark, sf_dir):
    keyed = _near.keyed_vectors(_read(spark, sf_dir, "pending_vectors"), _read(spark, sf_dir, "refs"))
    return _near.similar_pairs(spark, keyed, 96).select(F.col("key_a").alias("hash_a"), F.col("key_b").alias("hash_b"))


def p1_search(spark, sf_dir):
    """Greedy graph search: every text whose lowest row_ref is divisible by 20 as a query against all texts."""
    refs = _read(spark, sf_dir, "refs")
    keyed = _near.keyed_vectors(_read(spark, sf_dir, "pending_vectors"), refs)
    keyed = Workspace(spark, "search-input").save(keyed, "keyed")
    asked = refs.groupBy("text_hash").agg(F.min("row_ref").alias("row_ref")).filter("row_ref % 20 = 0").select(F.xxhash64("text_hash").alias("node"))
    nodes, graph = _near.neighbour_graph(spark, keyed.select("node", "vec"), 96)
    found = _near.search(spark, nodes, graph, keyed.join(asked, "node", "left_semi").select("node", "vec"), 96)
    rows = found.select("node", F.posexplode(F.arrays_zip("nbrs", "sims")).alias("rank", "e")).select("node", F.col("e.nbrs").alias("nbr"), "rank", F.col("e.sims").alias("sim"))
    a, b = keyed.select("node", F.col("key").alias("text_hash")), keyed.select(F.col("node").alias("nbr"), F.col("key").alias("similar_hash"))
    return rows.join(a, "node").join(b, "nbr").select("text_hash", "similar_hash", (F.col("rank") + 1).cast("int").alias("rank"), F.round(F.col("sim").cast("double"), 4).alias("cosine"))


def p2_found(spark, sf_dir):
    _, members = _ledger.format_duplicates(spark, _read(spark, sf_dir, "msgs").select("id", "who", "text"))
    return members.select("keep_id", "copy_id")


def p2_copies(spark, sf_dir):
    """One row per text with its number of copies."""
    ledger, _ = _ledger.format_duplicates(spark, _read(spark, sf_dir, "msgs").select("id", "who", "text"))
    return ledger.select("keep_id", "copies")


def p4_found(spark, sf_dir):
    return _conv.conversations(_read(spark, sf_dir, "msgs"))


def p3_found(spark, sf_dir):
    return _pairs.defects(spark, _read(spark, sf_dir, "raw_messages"), _read(spark, sf_dir, "cmsgs"))


def p7_found(spark, sf_dir):
    return _truncation.truncated(spark, _read(spark, sf_dir, "raw_messages"), _read(spark, sf_dir, "cmsgs"))


def p7_rates(spark, sf_dir):
    """How often each agent's replies are cut."""
    return _truncation.rates(spark, _read(spark, sf_dir, "raw_messages"), _read(spark, sf_dir, "cmsgs"))


def p7_limits(spark, sf_dir):
    """The storage limits that the lengths expose, by agent and encoding."""
    return _truncation.storage_limits(spark, _read(spark, sf_dir, "raw_messages"), _read(spark, sf_dir, "cmsgs"))


def p8_ids(spark, sf_dir):
    return _tokens.token_ids(spark, _read(spark, sf_dir, "documents"))


def p8_tree(spark, sf_dir):
    """The ids of every document by way of the tree: pieces of 256 characters, joined level by level; the same as those of ``p8_ids``."""
    return _tokens.token_ids(spark, _read(spark, sf_dir, "documents"), max_chars=256)


def p9_found(spark, sf_dir):
    return _leakage.leaks(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p10_found(spark, sf_dir):
    return _language.mislabelled(_language.document_languages(spark, _read(spark, sf_dir, "documents")))


def p10_segments(spark, sf_dir):
    """Every stretch of one language of every document, with its place and confidence."""
    return _language.document_segments(spark, _read(spark, sf_dir, "documents")).select("doc_id", "seg", "lang", "start", "end", "confidence", "words")


QUERIES = {
    "p1_found": p1_found, "p1_search": p1_search,
    "p2_found": p2_found, "p2_copies": p2_copies, "p3_found": p3_found, "p4_found": p4_found,
    "p7_found": p7_found, "p7_rates": p7_rates, "p7_limits": p7_limits, "p8_ids": p8_ids, "p8_tree": p8_tree, "p9_found": p9_found,
    "p10_found": p10_found, "p10_segments": p10_segments,
}

_P2_KEYS = r"""
WITH parts AS (
  SELECT id, text, lower(trim(who)) = 'tool' AND regexp_matches(text, '(?is)^[^:\n]*:\s*.*?\b(path|offset|limit|pattern|mode|timeout_s)["''”“’`]?\s*[:=]') AS is_tool,
    regexp_extract(text, '(?s)^([^:\n]*):\s*(\{.*?\}|[^\n]*)(.*)$', 1) AS name,
    regexp_extract(text, '(?s)^([^:\n]*):\s*(\{.*?\}|[^\n]*)(.*)$', 2) AS fields,
    regexp_extract(text, '(?s)^([^:\n]*):\s*(\{.*?\}|[^\n]*)(.*)$', 3) AS output
  FROM msgs WHERE text IS NOT NULL),
canon AS (
  SELECT id, CASE WHEN is_tool THEN
    regexp_replace(lower(upper(name)), '[^\p{L}\p{N}]+', '', 'g')
    || array_to_string(list_sort(list_transform(string_split(regexp_replace(fields, '(?i)\b(path|offset|limit|pattern|mode|timeout_s)["''”“’`]?\s*[:=]', chr(1) || '\1=', 'g'), chr(1)),
         lambda x: regexp_replace(lower(upper(x)), '[^\p{L}\p{N}]+', '', 'g'))), '')
    || regexp_replace(lower(upper(output)), '[^\p{L}\p{N}]+', '', 'g')
    ELSE regexp_replace(lower(upper(replace(text, 'ß', 'ss'))), '[^\p{L}\p{N}]+', '', 'g') END AS canon
  FROM parts),
groups AS (SELECT canon, min(id) AS keep_id, count(*) AS copies FROM canon WHERE length(canon) >= 24 GROUP BY canon)
"""

SQL = {
    "p2_found": _P2_KEYS + "SELECT DISTINCT keep_id, id AS copy_id FROM canon JOIN groups USING (canon) WHERE id <> keep_id",
    "p2_copies": _P2_KEYS + "SELECT keep_id, copies FROM groups",
    "p4_found": r"""
WITH rows AS (
  SELECT session, turn, id, text, CASE WHEN lower(trim(who)) IN ('user', 'human', 'subagent') THEN 0 WHEN lower(trim(who)) IN ('agent', 'assistant', 'ai') THEN 1 END AS side
  FROM msgs WHERE session IS NOT NULL),
once AS (SELECT session, turn, side, text, min(id) AS id FROM rows WHERE side IS NOT NULL GROUP BY ALL),
turns AS (
  SELECT session, turn, count(*) FILTER (side = 0) AS p, count(*) FILTER (side = 1) AS r, bool_and(coalesce(regexp_matches(text, '[\p{L}\p{N}]'), false)) AS said FROM once GROUP BY ALL),
kept AS (
  SELECT session FROM turns GROUP BY session
  HAVING bool_and(turn IS NOT NULL AND p = 1 AND r = 1 AND said) AND min(turn) = 0 AND max(turn) = count(*) - 1)
SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY turn, side) - 1 AS BIGINT) AS pos, id FROM once JOIN kept USING (session)""",
}
