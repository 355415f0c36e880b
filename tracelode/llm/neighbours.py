"""Most similar vectors for every vector: NN-descent as iterative joins, and greedy search in the graph it builds.

* ``usable`` checks and quantises the vectors: 16 bits a component, which keeps cosines to about 1e-6.
* ``initial_graph`` sorts them by random-hyperplane codes, several times with other planes, cuts each order into blocks of a
  fixed size and takes the best of each block.  Blocks have that size whatever the data, so a third of all vectors in one
  place is no hot group.
* ``descend`` joins each vector's neighbours with each other: whoever finds a better neighbour among its neighbours' takes it,
  until few do.  Reverse neighbours are part of the join through a fixed number of samples, as the method has it; samples are
  aggregates that combine before the shuffle, so a hub is never collected.
* ``search`` answers queries that aren't in the graph: from the blocks' best it walks to better neighbours.

Defined results: vectors that are null, of another length, all zero or with a null, NaN or infinite component are left out;
of several usable vectors of a key the one sent first counts; a vector isn't its own neighbour; ties go to the lower node
number; an empty table yields an empty graph; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.plans.skew import join_hot
from tracelode.plans.workspace import Workspace

K = 10
KEPT = 18  # neighbours kept in the graph; more than K, so that dense places are well linked
TABLES, BLOCK, BITS = 8, 256, 62
REVERSE = 8
HOT = 200_000  # neighbourhoods that may want one vector before it is salted
PLACE = 1024  # nodes whose neighbourhoods are compared in one task at once
MAX_ROUNDS, ENOUGH = 30, 0.001  # a round that proposes fewer than this share of all neighbours is the last; the rounds are a safeguard
SEED = 20240201

NODE = "node bigint, vec binary, codes array<bigint>"


def usable(vectors: DataFrame, key: str, vec: str, order: list[str], dim: int) -> DataFrame:
    """(key, node, vec array<float>): one usable vector of each key; node is the key's 64-bit hash."""
    v = F.col(vec)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) == dim) & fine)
    first = rows.groupBy(key).agg(F.min_by(vec, F.struct(*order)).alias("vec"))
    return first.select(F.col(key).alias("key"), F.xxhash64(key).alias("node"), "vec")


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, TABLES * BITS)).astype(np.float32)


def quantised(vectors: DataFrame, dim: int) -> DataFrame:
    """NODE rows of (node, vec array<float>)."""

    def encode(batches):
        planes, weights = _planes(dim), (1 << np.arange(BITS, dtype=np.int64))[::-1]
        for batch in batches:
            m = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            m /= np.abs(m).max(1, keepdims=True)
            codes = ((m.astype(np.float32) @ planes) > 0).reshape(len(m), TABLES, BITS).astype(np.int64) @ weights
            q = np.rint(m * 32767).astype("<i2")
            raw = [r.tobytes() for r in q]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(raw, pa.binary()), pa.array(list(codes), pa.list_(pa.int64()))], ["node", "vec", "codes"])

    return vectors.select("node", "vec").mapInArrow(encode, NODE)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a binary column."""
    m = np.frombuffer(b"".join(column.to_pylist()), dtype="<i2").reshape(-1, dim).astype(np.float32) / 32767
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


EDGES = "node bigint, nbrs array<bigint>, sims array<float>"
NONE = "array<bigint>"


def _lists(nodes: np.ndarray, nbrs: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array(list(nbrs), pa.list_(pa.int64())), pa.array(list(sims.astype(np.float32)), pa.list_(pa.float32()))], ["node", "nbrs", "sims"])


def _block_neighbours(dim: int, kept: int, block: int):
    """Best neighbours within consecutive blocks of a sorted partition; queries (``asks``) only look at others."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def solve(part: pa.Table):
            n = part.num_rows
            if n < 2:
                return None
            x = _matrix(part.column("vec").combine_chunks() if part.column("vec").num_chunks != 1 else part.column("vec").chunk(0), dim)
            ids, asks = part.column("node").to_numpy(), part.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            s = x @ x.T
            np.fill_diagonal(s, -2)
            s[:, asks] = -2
            keep = min(kept, n - 1)
            top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            return _lists(ids, ids[top], np.take_along_axis(s, top, 1))

        def blocks(table: pa.Table, last: bool):
            tables = table.column("t").to_numpy()
            cuts = np.flatnonzero(np.diff(tables)) + 1 if len(tables) else np.array([], int)
            start = 0
            for end in [*cuts.tolist(), len(tables)]:
                whole = last or end < len(tables)
                while end - start >= 2 * block or (whole and end > start):
                    size = end - start if end - start < 2 * block else block
                    yield table.slice(start, size)
                    start += size
            held[:] = table.slice(start).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 2 * block:
                for part in blocks(pa.Table.from_batches(held), False):
                    out = solve(part)
                    if out is not None:
                        yield out
        if held:
            for part in blocks(pa.Table.from_batches(held), True):
                out = solve(part)
                if out is not None:
                    yield out

    return run


def _best(pairs: DataFrame, kept: int) -> DataFrame:
    """EDGES of (node, nbr, sim): the best ``kept`` of each node, each neighbour once."""
    once = pairs.groupBy("node", "nbr").agg(F.max("sim").alias("sim"))
    ranked = F.slice(F.array_sort(F.array_agg(F.struct((-F.col("sim")).alias("far"), "nbr"))), 1, kept)
    return once.groupBy("node").agg(ranked.alias("top")).select(
        "node", F.transform("top", lambda e: e["nbr"]).alias("nbrs"), F.transform("top", lambda e: (-e["far"]).cast("float")).alias("sims"))


def _exploded(edges: DataFrame) -> DataFrame:
    return edges.select("node", F.explode(F.arrays_zip("nbrs", "sims")).alias("e")).select("node", F.col("e.nbrs").alias("nbr"), F.col("e.sims").alias("sim"))


def _in_blocks(nodes: DataFrame, dim: int, kept: int, block: int) -> DataFrame:
    """(node, nbr, sim) from all block orders; ``nodes`` is NODE and ``asks``."""
    rows = nodes.select("node", "vec", "asks", F.posexplode("codes").alias("t", "code"))
    ordered = rows.repartitionByRange("t", "code", "node").sortWithinPartitions("t", "code", "node")
    return _exploded(ordered.mapInArrow(_block_neighbours(dim, kept, block), EDGES))


def initial_graph(nodes: DataFrame, dim: int, *, kept: int = KEPT, block: int = BLOCK) -> DataFrame:
    return _best(_in_blocks(nodes.withColumn("asks", F.lit(False)), dim, kept, block), kept)


def placed(nodes: DataFrame, *, size: int = PLACE) -> DataFrame:
    """(node, blk): blocks of ``size`` nodes that lie together in the order of the first codes; whatever the data, none is larger."""

    def number(batches):
        from pyspark import TaskContext

        at, part = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            blk = part | (np.arange(at, at + batch.num_rows, dtype=np.int64) // size)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(blk)], ["node", "blk"])

    rows = nodes.select("node", F.col("codes")[0].alias("code"))
    return rows.repartitionByRange("code", "node").sortWithinPartitions("code", "node").select("node").mapInArrow(number, "node bigint, blk bigint")


def _local_join(dim: int, kept: int):
    """Compares all members of each neighbourhood of a block; gives (node, nbr, sim) that beat the node's worst neighbour.

    ``around`` has each node's members, the ``fresh`` ones first, ``there`` each member once, with its vector, worst similarity and known
    neighbours.  A pair that several neighbourhoods propose is given once, and no more than a node can keep.
    """

    def run(around: pa.Table, there: pa.Table) -> pa.Table:
        ids = there.column("m").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        x = _matrix(there.column("vec").combine_chunks(), dim)[order]
        worst = there.column("worst").to_numpy()[order]
        lists = there.column("known").combine_chunks().take(pa.array(order))
        known = np.full((len(ids), kept), -1, np.int64)  # as places of the block; what isn't here can't be proposed
        flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        known[np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.where(ids[at] == flat, at, -1)
        parts = [[], [], []]
        for batch in around.to_batches(256):
            members = batch.column("members")
            flat = members.flatten()
            if not len(flat):
                continue
            counts = np.diff(members.offsets.to_numpy())
            width = int(counts.max())
            rows = np.repeat(np.arange(len(counts)), counts)
            cols = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = np.zeros((len(counts), width), np.int64)
            real = np.arange(width)[None, :] < counts[:, None]
            fresh = np.arange(width)[None, :] < batch.column("fresh").to_numpy()[:, None]
            at[rows, cols] = np.searchsorted(ids, flat.to_numpy())
            v = x[at]
            s = v @ v.transpose(0, 2, 1)
            better = (s > worst[at][:, :, None]) & (fresh[:, :, None] | fresh[:, None, :]) & real[:, :, None] & real[:, None, :] & (at[:, :, None] != at[:, None, :])
            r, a, b = np.nonzero(better)
            i, j, sim = at[r, a], at[r, b], s[r, a, b]
            new = ~(known[i] == j[:, None]).any(1)
            for part, values in zip(parts, (i[new], j[new], sim[new])):
                part.append(values)
        if not parts[0]:
            return pa.table({"node": pa.array([], pa.int64()), "nbr": pa.array([], pa.int64()), "sim": pa.array([], pa.float32())})
        i, j, sim = (np.concatenate(p) for p in parts)
        _, first = np.unique(i * len(ids) + j, return_index=True)
        i, j, sim = i[first], j[first], sim[first]
        best = np.lexsort((ids[j], -sim, i))
        i, j, sim = i[best], j[best], sim[best]
        begin = np.r_[0, np.flatnonzero(i[1:] != i[:-1]) + 1] if len(i) else np.array([], int)
        rank = np.arange(len(i)) - np.repeat(begin, np.diff(np.r_[begin, len(i)]))
        ok = rank < kept
        return pa.table({"node": ids[i[ok]], "nbr": ids[j[ok]], "sim": sim[ok].astype(np.float32)})

    def checked(key, around: pa.Table, there: pa.Table) -> pa.Table:
        return run(around, there)

    return checked


def _hoods(graph: DataFrame, number: int, kept: int) -> DataFrame:
    """(node, blk, nbrs, worst, fresh, old, in_degree): each node's list and its neighbourhood, the members that are fresh and the
    others.  Reverse neighbours enter by a fixed number of samples with replacement: the one with the lowest hash, for some hash
    functions; an aggregate that combines before it shuffles, so that a hub's followers never meet."""
    edges = graph.select("node", F.size("fresh").alias("n"), F.posexplode(F.concat("fresh", F.array_except("nbrs", "fresh"))).alias("at", "m")).select("node", "m", (F.col("at") < F.col("n")).alias("new"))
    draw = [F.xxhash64("node", F.lit(number * 100 + i)) for i in range(REVERSE)]
    back = edges.groupBy(F.col("m").alias("to")).agg(F.count(F.lit(1)).alias("in_degree"), *(F.min_by("node", h).alias(f"b{i}") for i, h in enumerate(draw)), *(F.min_by("new", h).alias(f"f{i}") for i, h in enumerate(draw)))
    drawn = lambda new: F.array_compact(F.array(*(F.when(F.col(f"f{i}") == F.lit(new), F.col(f"b{i}")) for i in range(REVERSE))))
    back = back.select("to", "in_degree", drawn(True).alias("back_new"), drawn(False).alias("back_old"))
    none = F.array().cast(NONE)
    worst = F.when(F.size("nbrs") >= kept, F.element_at("sims", -1)).otherwise(F.lit(-1.5)).cast("float")  # below all if the list isn't full
    fresh = F.array_union("fresh", F.coalesce("back_new", none))
    old = F.array_except(F.concat("nbrs", F.coalesce("back_old", none), F.array("node")), fresh)
    return graph.join(back, graph["node"] == back["to"], "left").select("node", "blk", "nbrs", worst.alias("worst"), fresh.alias("fresh"), old.alias("old"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def _round(nodes: DataFrame, hoods: DataFrame, dim: int, kept: int) -> DataFrame:
    """Proposals (node, nbr, sim) of one local join: only neighbourhoods with a fresh member are worth comparing with that member.

    Neighbourhoods are put together by ids alone.  Those of nodes that lie together are compared in one task, to which each
    member's vector travels once.
    """
    around = hoods.filter(F.size("fresh") > 0).select("blk", F.concat("fresh", "old").alias("members"), F.size("fresh").alias("fresh"))
    wanted = around.select("blk", F.explode("members").alias("m")).distinct()
    payload = nodes.select("node", "vec").join(hoods.select("node", "worst", F.col("nbrs").alias("known"), (F.col("in_degree") + REVERSE + 1).alias("n")), "node").withColumnRenamed("node", "m")
    hottest = hoods.agg(F.max("in_degree")).first()[0] or 0
    there = join_hot(wanted, payload, ["m"], "n", F.col("blk")) if hottest > HOT else wanted.join(payload, "m")
    there = there.select(F.col("blk").alias("at"), "m", "vec", "worst", "known")
    return around.groupBy("blk").cogroup(there.groupBy("at")).applyInArrow(_local_join(dim, kept), "node bigint, nbr bigint, sim float")


def _merged(graph: DataFrame, found: DataFrame, kept: int) -> DataFrame:
    """The graph with what was found: each node's best, and in ``fresh`` those that are new."""
    once = found.groupBy("node", "nbr").agg(F.max("sim").alias("sim")).groupBy(F.col("node").alias("to")).agg(F.array_agg(F.struct((-F.col("sim")).alias("far"), "nbr", F.lit(True).alias("new"))).alias("more"))
    have = F.transform(F.arrays_zip("nbrs", "sims"), lambda e: F.struct((-e["sims"]).alias("far"), e["nbrs"].alias("nbr"), F.lit(False).alias("new")))
    top = F.when(F.col("more").isNull(), have).otherwise(F.slice(F.array_sort(F.concat(have, "more")), 1, kept))
    both = graph.join(once, graph["node"] == once["to"], "left").select("node", "blk", top.alias("top"))
    return both.select("node", "blk", F.col("top.nbr").alias("nbrs"), F.transform("top.far", lambda f: -f).alias("sims"), F.transform(F.filter("top", lambda e: e["new"]), lambda e: e["nbr"]).alias("fresh"))


def descend(work: Workspace, nodes: DataFrame, blocks: DataFrame, graph: DataFrame, dim: int, *, kept: int = KEPT, max_rounds: int = MAX_ROUNDS, enough: float = ENOUGH) -> DataFrame:
    """The graph after as many rounds as bring changes."""
    total, first = nodes.count() * kept, graph
    graph = work.save(graph.join(blocks, "node").select("node", "blk", "nbrs", "sims", F.col("nbrs").alias("fresh")), "placed")
    work.drop(first)
    for number in range(max_rounds):
        hoods = work.save(_hoods(graph, number, kept), f"hoods-{number}")
        found = work.save(_round(nodes, hoods, dim, kept), f"found-{number}")
        changed = found.count()
        if changed:
            following = work.save(_merged(graph, found, kept), f"graph-{number}")
            work.drop(graph)
            graph = following
        work.drop(hoods, found)
        if changed < enough * total or not changed:
            break
    return graph.select("node", "nbrs", "sims")


def neighbour_graph(spark: SparkSession, vectors: DataFrame, dim: int, *, kept: int = KEPT) -> tuple[DataFrame, DataFrame]:
    """(nodes, graph) of (node, vec array<float>)."""
    work = Workspace(spark, "neighbours")
    nodes = work.save(quantised(vectors, dim), "nodes")
    graph = work.save(initial_graph(nodes, dim, kept=kept), "graph")
    blocks = work.save(placed(nodes), "blocks")
    return nodes, descend(work, nodes, blocks, graph, dim, kept=kept)


def similar_pairs(spark: SparkSession, keyed: DataFrame, dim: int, *, k: int = K, least: float = 0.75) -> DataFrame:
    """(key_a, key_b): pairs of which one is among the ``k`` most similar of the other, with a cosine of ``least`` or more."""
    work = Workspace(spark, "pairs")
    keyed = work.save(keyed, "keyed")
    _, graph = neighbour_graph(spark, keyed.select("node", "vec"), dim)
    near = _exploded(graph.select("node", F.slice("nbrs", 1, k).alias("nbrs"), F.slice("sims", 1, k).alias("sims"))).filter(F.col("sim") >= least)
    pairs = near.select(F.least("node", "nbr").alias("a"), F.greatest("node", "nbr").alias("b")).distinct()
    names = keyed.select("key", "node")
    a, b = names.select(F.col("key").alias("ka"), F.col("node").alias("a")), names.select(F.col("key").alias("kb"), F.col("node").alias("b"))
    return pairs.join(a, "a").join(b, "b").select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))


def _score(dim: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = np.einsum("ij,ij->i", _matrix(batch.column("qv"), dim), _matrix(batch.column("vec"), dim))
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("nbr"), pa.array(s.astype(np.float32))], ["node", "nbr", "sim"])

    return run


def search(spark: SparkSession, nodes: DataFrame, graph: DataFrame, queries: DataFrame, dim: int, *, k: int = K, beam: int = 24, max_steps: int = 6) -> DataFrame:
    """(node, nbrs, sims) of the ``k`` best nodes for each query (node, vec array<float>), by greedy graph search.

    A query starts with the best of its blocks and follows the neighbours of its ``beam`` best, until none gets better.
    """
    work = Workspace(spark, "search")
    asked = work.save(quantised(queries, dim), "queries")
    both = nodes.join(asked.select("node"), "node", "left_anti").withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
    starts = _in_blocks(both, dim, beam, BLOCK).join(asked.select("node"), "node", "left_semi")
    beams = work.save(_best(starts, beam), "beams")
    for step in range(max_steps):
        have = _exploded(beams)
        wider = have.select("node", F.col("nbr").alias("via")).join(graph.select(F.col("node").alias("via"), F.explode("nbrs").alias("nbr")), "via")
        fresh = wider.filter(F.col("nbr") != F.col("node")).select("node", "nbr").distinct().join(have.select("node", "nbr"), ["node", "nbr"], "left_anti")
        scored = fresh.join(nodes.select(F.col("node").alias("nbr"), "vec"), "nbr").join(asked.select("node", F.col("vec").alias("qv")), "node").mapInArrow(_score(dim), "node bigint, nbr bigint, sim float")
        following = work.save(_best(have.unionByName(scored), beam), f"beams-{step}")
        moved = following.join(beams.select("node", F.col("nbrs").alias("before")), "node").filter(F.slice("nbrs", 1, k) != F.slice("before", 1, k)).limit(1).count()
        work.drop(beams)
        beams = following
        if not moved:
            break
    return beams.select("node", F.slice("nbrs", 1, k).alias("nbrs"), F.slice("sims", 1, k).alias("sims"))


def keyed_vectors(pending: DataFrame, refs: DataFrame, dim: int = 96) -> DataFrame:
    """(key, node, vec) of the pending vectors by the text hash of their reference."""
    joined = pending.select("row_ref", "batch", "vec").join(refs.select("row_ref", "text_hash"), "row_ref")
    return usable(joined, "text_hash", "vec", ["batch", "row_ref"], dim)
