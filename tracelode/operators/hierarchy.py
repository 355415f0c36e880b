"""Parent-child links to full hierarchies, by nested-set ranges computed in O(log depth) rounds.

Subtree sizes are summed upward and preorder offsets downward with pointer doubling: after round k every node
knows its 2^k-th ancestor, the number of its descendants nearer than 2^k, and the sums along its first 2^k steps
up.  A chain a million deep takes twenty rounds.  Nodes that never come to a root are in a cycle or below one; these are
what is left unprocessed when a round finishes no more nodes.

Defined results: a node given twice keeps its smallest non-null parent; a null, blank or missing parent makes a
root (``keep_missing_parent=True``: a parent without a row becomes the root's name, depth 0, but gets no row); a
node that is its own parent is a cycle of one; null nodes are dropped; an empty table yields no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.plans.skew import join_hot
from tracelode.plans.workspace import Workspace

CHUNKS = 512
HOT = 200_000  # rows that may share an ancestor in one task


def _links(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, up) with up null for roots, and (node) of all; a parent without a row is kept as a node."""
    own = nodes.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("parent").alias("up"))
    listed = own.withColumn("listed", F.lit(True))
    outside = (
        own.select(F.col("up").alias("node")).filter(F.col("node").isNotNull()).distinct().join(own.select("node"), "node", "left_anti")
        .select("node", F.lit(None).cast("string").alias("up"), F.lit(False).alias("listed"))
    )
    return listed.unionByName(outside)


def _sibling_offsets(sized: DataFrame) -> DataFrame:
    """Adds ``step``: the distance of a node's preorder number from its parent's (1 + sizes of earlier siblings).

    A parent may have a third of all nodes as children, so the prefix sum has two levels: within chunks of siblings,
    and over the chunk totals, at most CHUNKS rows a parent.
    """
    chunked = sized.withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(CHUNKS)).cast("int"))
    totals = chunked.groupBy("up", "chunk").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("up").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("up", "chunk", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("up", "chunk").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return (
        chunked.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(starts, [chunked["up"].eqNullSafe(starts["up"]), chunked["chunk"] == starts["chunk"]], "left")
        .select(chunked["*"], (F.lit(1) + F.col("inner") + F.coalesce(F.col("start"), F.lit(0))).alias("step"))
        .drop("chunk", "inner")
    )


def _meet(rows: DataFrame, far: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """``rows`` joined with what is known of their ``anc``, of which the most common has ``most`` rows: salted if those are many."""
    if most <= HOT:
        return rows.join(far, "anc")
    return join_hot(rows, far.join(counts, "anc"), ["anc"], "n", F.xxhash64("node"), rows_per_salt=HOT).drop("n")


def nested_sets(spark: SparkSession, nodes: DataFrame, *, keep_missing_parent: bool = True, max_rounds: int = 40) -> DataFrame:
    """Nodes (node, parent) to (node, root, depth, lft, size, path, cyclic), one row per listed node.

    ``lft`` numbers the nodes of a tree in preorder from 0 at its root; the descendants of x are the nodes y of the
    same root with x.lft < y.lft < x.lft + x.size.  In a cycle or below one ``root`` is the cycle's smallest node,
    ``depth`` is -1 and the other columns are null.
    """
    work = Workspace(spark, "hierarchy")
    links = work.save(_links(nodes.select(F.col("node").cast("string"), F.when(F.trim("parent") != "", F.col("parent")).alias("parent"))), "links")

    # upward: anc = 2^k-th ancestor, top = last node reached, size = descendants (and self) nearer than 2^k,
    # low = smallest name among the 2^k nodes from this one up
    state = links.select("node", "up", "listed", F.col("up").alias("anc"), F.coalesce("up", "node").alias("top"),
                         F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.lit(1).cast("bigint").alias("size"), F.col("node").alias("low"))
    state = work.save(state, "up-0")
    before, hottest = None, []
    for k in range(max_rounds):
        active = state.filter(F.col("anc").isNotNull())
        left, most = active.groupBy("anc").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        # a tree with open nodes always finishes some in a round, so a round that finishes none leaves cycles only; their
        # smallest name is known once 2^k steps go around the longest
        if left == 0 or left == before and 2**k >= left:
            break
        before = left
        hottest.append(most)
        gained = active.groupBy(F.col("anc").alias("node")).agg(F.sum("size").alias("more"), F.count(F.lit(1)).alias("n"))
        far = state.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("top").alias("top2"), F.col("depth").alias("depth2"), F.col("low").alias("low2"))
        jumped = _meet(active.select("node", "anc"), far, gained.select(F.col("node").alias("anc"), "n"), most).drop("anc")
        step = state.join(gained.drop("n"), "node", "left").join(jumped, "node", "left").select(
            "node", "up", "listed", F.col("anc2").alias("anc"), F.coalesce("top2", "top").alias("top"),
            (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"),
            F.least("low", F.coalesce("low2", "low")).alias("low"),
        )
        following = work.save(step, f"up-{k + 1}")
        work.drop(state)
        state = following

    # what still has an ancestor was never finished: it hangs on a cycle, and anc is a node of that cycle
    open_nodes = state.filter(F.col("anc").isNotNull())
    cycle = open_nodes.join(state.select(F.col("node").alias("anc"), F.col("low").alias("cycle_root")), "anc").filter("listed").select(
        "node", F.col("cycle_root").alias("root"), F.lit(-1).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("lft"),
        F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("array<string>").alias("path"), F.lit(True).alias("cyclic"),
    )

    # downward: preorder number and path, the sums along the way to the root
    trees = state.filter(F.col("anc").isNull()).select("node", "up", "listed", "top", "depth", "size")
    down = _sibling_offsets(trees).select("node", "listed", "top", "depth", "size", F.col("up").alias("anc"),
                                          F.when(F.col("up").isNull(), F.lit(0)).otherwise(F.col("step")).cast("bigint").alias("lft"), F.array("node").alias("path"))
    down = work.save(down, "down-0")
    deepest = down.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    for k in range(int(deepest).bit_length()):
        open_, done = down.filter(F.col("anc").isNotNull()), down.filter(F.col("anc").isNull())
        far = down.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("lft").alias("lft2"), F.col("path").alias("path2"))
        counts = open_.groupBy("anc").agg(F.count(F.lit(1)).alias("n"))
        step = _meet(open_, far, counts, hottest[k]).select(
            "node", "listed", "top", "depth", "size", F.col("anc2").alias("anc"), (F.col("lft") + F.col("lft2")).alias("lft"), F.concat("path2", "path").alias("path"),
        ).unionByName(done)
        following = work.save(step, f"down-{k + 1}")
        work.drop(down)
        down = following
    done = down.filter("listed").select("node", F.col("top").alias("root"), "depth", "lft", "size", "path", F.lit(False).alias("cyclic"))
    if not keep_missing_parent:
        listed = down.filter("listed").select(F.col("node").alias("root"))
        missing = done.join(listed, "root", "left_anti").select("node")
        shifted = done.join(missing.withColumn("__shift", F.lit(1)), "node", "left")
        shift = F.coalesce(F.col("__shift"), F.lit(0))
        done = shifted.select("node", F.when(shift == 1, F.element_at("path", 2)).otherwise(F.col("root")).alias("root"), (F.col("depth") - shift).alias("depth"),
                              F.col("lft"), "size", F.expr("CASE WHEN __shift = 1 THEN slice(path, 2, size(path) - 1) ELSE path END").alias("path"), "cyclic")
    return done.unionByName(cycle)


def descendants(sets: DataFrame, of: DataFrame) -> DataFrame:
    """(ancestor, node, distance) for the nodes in ``of``: a range join on the nested sets within each root.

    A root without a row in ``sets`` (a parent that is not in the table) may stand in ``of`` too: all nodes of that root are below it,
    at their depth.  A range is cut into its largest aligned blocks of 2^level numbers, at most two a level, and each number knows its block
    of every level: an equality join that meets descendants only, also where one tree holds most of the rows.
    """
    tree = sets.filter(~F.col("cyclic"))
    largest = tree.agg(F.coalesce(F.max("size"), F.lit(1))).first()[0]
    levels = F.explode(F.sequence(F.lit(0), F.lit(int(largest).bit_length()))).alias("level")
    heads = tree.join(of.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("ancestor"), "root", F.col("depth").alias("d"), "lft", "size", levels)
    first, end = F.expr("shiftright(lft + shiftleft(1L, level), level)"), F.expr("shiftright(lft + size, level)")
    heads = heads.withColumns({"first": first, "end": end}).filter("first < end")
    blocks = F.array(F.when(F.col("first") % 2 == 1, F.col("first")), F.when(F.col("end") % 2 == 1, F.col("end") - 1))
    heads = heads.select("ancestor", "root", "d", "level", F.explode(blocks).alias("block")).filter("block is not null")
    nodes = tree.select("node", "root", "depth", "lft", levels).withColumn("block", F.expr("shiftright(lft, level)")).drop("lft")
    found = heads.join(nodes, ["root", "level", "block"]).select("ancestor", "node", (F.col("depth") - F.col("d")).alias("distance"))
    outside = of.select(F.col("node").alias("root")).distinct().join(sets.select(F.col("node").alias("root")), "root", "left_anti")
    outside = tree.groupBy("root").agg(F.count(F.lit(1)).alias("n")).join(outside, "root", "left_semi")
    below = join_hot(tree.select("root", "node", "depth"), outside, ["root"], "n", F.xxhash64("node"), rows_per_salt=HOT)
    return found.unionByName(below.select(F.col("root").alias("ancestor"), "node", F.col("depth").alias("distance")))


def named(sets: DataFrame) -> DataFrame:
    """(node) of all that ``sets`` names: the nodes, and the roots of trees also where these have no row."""
    return sets.select("node").unionByName(sets.filter(~F.col("cyclic")).select(F.col("root").alias("node"))).distinct()


def ancestors(sets: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(node, ancestor, distance) for the nodes in ``of`` (all by default): the nodes whose range holds theirs, and roots without a row."""
    pairs = descendants(sets, named(sets))
    found = pairs if of is None else pairs.join(of.select("node").distinct(), "node", "left_semi")
    return found.select("node", "ancestor", "distance")


def first_claims(rows: DataFrame, child: str, claim: str, order: list[str]) -> DataFrame:
    """(node, parent): of each child's non-blank claims the first by ``order``, trimmed and in lower case."""
    name = F.lower(F.regexp_replace(F.col(claim), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    claims = rows.select(F.col(child).alias("node"), name.alias("parent"), *order).filter((F.col("parent") != "") & F.col("node").isNotNull())
    return claims.groupBy("node").agg(F.min_by("parent", F.struct(*order)).alias("parent"))
