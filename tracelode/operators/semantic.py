"""Vector lanes: exact and quantised similarity to a query vector, flat, by group, by session and filtered.

Vectors are scored in Arrow batches by matrix products; int8 vectors are stored once (``stored_q8``) and then scanned, and a task
hands on only the rows that can be among the best.  Rows without a usable vector (null, of another length, with a null or
non-finite component, all zero) have no score and are left out; ties are decided by the columns that the caller names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode import schema


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(usable, rows): which vectors are of a length and without nulls, and those as a matrix."""
    sized = pc.equal(pc.fill_null(pc.list_value_length(column), -1), dim).to_numpy(zero_copy_only=False)
    flat = column.filter(pa.array(sized)).flatten()
    if not len(flat):
        return np.zeros(len(column), bool), np.zeros((0, dim))
    m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
    fine = np.isfinite(m).all(1)
    sized[np.flatnonzero(sized)[~fine]] = False
    return sized, m[fine]


def _with(df: DataFrame, columns: list[tuple[str, T.DataType]], make) -> DataFrame:
    """Adds columns that ``make`` computes for each Arrow batch."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch)], [*batch.schema.names, *(n for n, _ in columns)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in columns)]))


def similar(vectors: DataFrame, query: list[float], vec: str = "vec") -> DataFrame:
    """Rows with ``score``, the cosine to one query vector; rows without one are left out."""
    q = np.asarray(query, dtype=np.float64)
    size = float(np.linalg.norm(q))

    def score(batch):
        usable, m = _matrix(batch.column(vec), len(q))
        own = np.linalg.norm(m, axis=1) * size
        value = np.full(batch.num_rows, np.nan)
        value[usable] = np.divide(m @ q, own, out=np.full(len(m), np.nan), where=own > 0)
        return [pa.array(value, mask=~np.isfinite(value))]

    scored = _with(vectors, [("score", T.DoubleType())], score)
    return scored.withColumn("score", F.round("score", 6)).filter(F.col("score").isNotNull())


def to_q8(m: np.ndarray) -> np.ndarray:
    """Each row in steps of its largest component's 127th part, halves away from zero."""
    top = np.abs(m).max(1, keepdims=True, initial=0)
    scaled = np.divide(m * 127, top, out=np.zeros_like(m), where=top > 0)
    return (np.sign(scaled) * np.floor(np.abs(scaled) + 0.5)).astype(np.int8)


def stored_q8(vectors: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    """Adds q (array of tinyint, null for unusable vectors) and inv_norm; to be written once and scanned by every query."""

    def quantise(batch):
        usable, m = _matrix(batch.column(vec), dim)
        q = to_q8(m)
        size = np.linalg.norm(q.astype(np.float64), axis=1)
        inv = np.zeros(batch.num_rows)
        inv[usable] = np.divide(1.0, size, out=np.zeros(len(m)), where=size > 0)
        ends = np.r_[0, np.cumsum(usable * dim)].astype(np.int32)
        rows = pa.ListArray.from_arrays(pa.array(ends, mask=np.r_[~usable, False]), pa.array(q.ravel(), pa.int8()))  # a null start is a null row
        return [rows, pa.array(inv, mask=~usable)]

    return _with(vectors, [("q", T.ArrayType(T.ByteType())), ("inv_norm", T.DoubleType())], quantise)


def filtered(vectors: DataFrame, rows: DataFrame, key: str, predicate: Column) -> DataFrame:
    """The vectors whose corpus row satisfies a predicate, with that row's columns; filtered before anything is scored."""
    return vectors.join(rows.filter(predicate), key)


def topk(scored: DataFrame, k: int, ties: list[str]) -> DataFrame:
    return scored.orderBy(F.desc("score"), *ties).limit(k)


def grouped_topk(scored: DataFrame, group: str, groups: int, heads: int, ties: list[str]) -> DataFrame:
    """The best ``heads`` rows of each of the best ``groups`` groups, with their rank in the group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), *ties))
    within = scored.withColumn("rank", rank).filter(F.col("rank") <= heads)
    best = within.filter("rank = 1").orderBy(F.desc("score"), *ties).limit(groups).select(group)
    return within.join(F.broadcast(best), group, "left_semi")  # as many rows as groups were asked for


def pool_size(k: int) -> int:
    return min(256, max(6 * k, 40))


def quantised_pool(stored: DataFrame, query: list[float], pool: int, ties: list[str]) -> DataFrame:
    """The ``pool`` best rows of a q8 table by ``rough``, the int8 cosine; each task hands on its own best only."""
    ints = to_q8(np.asarray([query], dtype=np.float64))[0].astype(np.int32)
    size = float(np.linalg.norm(ints)) or 1.0
    dim = len(ints)

    def run(batches):
        least = -np.inf
        for batch in batches:
            usable = pc.equal(pc.fill_null(pc.list_value_length(batch.column("q")), -1), dim)
            batch = batch.filter(usable)
            if not batch.num_rows:
                continue
            q = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            rough = (q.astype(np.int32) @ ints) * batch.column("inv_norm").to_numpy(zero_copy_only=False) / size
            if len(rough) > pool:  # all that tie with the last one stay
                least = max(least, np.partition(rough, -pool)[-pool])
            kept = pa.array(rough >= least)
            yield pa.RecordBatch.from_arrays([*batch.filter(kept).columns, pa.array(rough).filter(kept)], [*batch.schema.names, "rough"])

    scored = stored.mapInArrow(run, T.StructType([*stored.schema.fields, T.StructField("rough", T.DoubleType())]))
    return scored.orderBy(F.desc("rough"), *ties).limit(pool)


def quantised_topk(vectors: DataFrame, query: list[float], k: int, ties: list[str], vec: str = "vec", *, text_key: str | None = None) -> DataFrame:
    """Candidates by int8 scores, then exact cosines of those: the pool is ``pool_size(k)`` rows.

    ``vectors`` is a q8 table or is quantised on the way.  With ``text_key`` rows of one text count once, by the best: the pool is
    taken of texts, so that copies crowd nothing out.
    """
    stored = vectors if "q" in vectors.columns else stored_q8(vectors, len(query), vec)
    if text_key:  # one row a text, the first by ``ties``; a text's rows have the same vector
        first = F.min_by(F.struct(*(c for c in stored.columns if c != text_key)), F.struct(*ties))
        stored = stored.groupBy(text_key).agg(first.alias("r")).select(text_key, "r.*").select(*stored.columns)
    pool = quantised_pool(stored, query, pool_size(k), ties).drop("q", "inv_norm")
    return topk(similar(pool, query, vec), k, ties).drop("rough")


def session_pool(stored: DataFrame, query: list[float], sessions: int, heads: int, group: str, ties: list[str], vec: str = "vec") -> DataFrame:
    """The best ``heads`` rows of each of the best ``sessions`` sessions: int8 scores choose ``pool_size`` sessions by their best row
    and each one's first rows, exact cosines order them."""
    ints = to_q8(np.asarray([query], dtype=np.float64))[0].astype(np.int32)
    size, dim = float(np.linalg.norm(ints)) or 1.0, len(ints)

    def rough(batch):
        usable = pc.equal(pc.fill_null(pc.list_value_length(batch.column("q")), -1), dim).to_numpy(zero_copy_only=False)
        value = np.full(batch.num_rows, np.nan)
        q = batch.column("q").filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        value[usable] = (q.astype(np.int32) @ ints) * batch.column("inv_norm").to_numpy(zero_copy_only=False)[usable] / size
        return [pa.array(value, mask=~usable)]

    scored = _with(stored, [("rough", T.DoubleType())], rough).filter(F.col("rough").isNotNull() & F.col(group).isNotNull())
    best = scored.groupBy(group).agg(F.max("rough").alias("best")).orderBy(F.desc("best"), group).limit(pool_size(sessions)).select(group)
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("rough"), *ties))
    rows = scored.join(F.broadcast(best), group, "left_semi").withColumn("place", place).filter(F.col("place") <= pool_size(heads)).drop("place", "q", "inv_norm", "rough")  # a bounded pool
    return grouped_topk(similar(rows, query, vec), group, sessions, heads, ties)


def policy(scored: DataFrame, who: tuple[str, ...] = ()) -> DataFrame:
    """(rows, accepted, weak, strong, machine): what the acceptance rules make of scored rows."""
    machine = F.coalesce(F.col("who").isin(*schema.MACHINE_ROLES), F.lit(False)) & F.lit(not who)
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~machine).alias("accepted"), F.count_if(~machine & (F.col("score") < schema.WEAK_COSINE)).alias("weak"),
        F.count_if(~machine & (F.col("score") >= schema.STRONG_COSINE)).alias("strong"), F.count_if(machine).alias("machine"),
    )


def index_coverage(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(total, indexed, share): how much of a corpus has a vector."""
    marked = rows.select(key).distinct().join(vectors.select(key).distinct().withColumn("__v", F.lit(True)), key, "left")
    return marked.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("__v").isNotNull()).alias("indexed"), F.round(F.count_if(F.col("__v").isNotNull()) / F.count(F.lit(1)), 6).alias("share"))


def summaries(vectors: DataFrame, group: str, vec: str = "vec") -> DataFrame:
    """(group, rows, vec): each group's mean vector, summed by position so that no group is collected."""
    flat = vectors.select(group, F.posexplode(vec).alias("at", "x"))
    means = flat.groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    return means.groupBy(group).agg(F.max("n").alias("rows"), F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("vec"))  # one entry a dimension


def live_rows(segments: DataFrame, shadows: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of appended segments that no later segment replaced and no tombstone removed."""
    newest = segments.groupBy(key).agg(F.max_by(F.struct(*[c for c in segments.columns if c != key]), F.col(version)).alias("r")).select(key, "r.*")
    return newest.join(shadows.select(key).distinct(), key, "left_anti")
