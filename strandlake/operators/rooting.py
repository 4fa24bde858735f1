"""Roots of trees (node, parent, label, length): distances, paths, new roots.

Ways up are found by jumps that double: a round holds one row per node, and a tree of any
depth takes about log2 of its depth in rounds. A missing length is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.graph import ensure_checkpoints
from strandlake.operators.trees import leaves


def _jumps(tree: DataFrame):
    """Tables (node, up, levels, distance) of 1, 2, 4, ... levels, less where the root is nearer, until all end at the root."""
    ensure_checkpoints(tree.sparkSession)
    now = tree.select("node", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("long").alias("levels"), F.when(F.col("parent").isNotNull(), F.coalesce("length", F.lit(0.0))).otherwise(0.0).alias("distance")).checkpoint()
    rounds, nodes = 0, now.count()
    while True:
        yield now
        if now.filter("up IS NOT NULL").isEmpty():
            return
        if 1 << rounds > 2 * nodes:
            raise ValueError("the tree has a cycle")
        over = now.select(F.col("node").alias("n"), F.col("up").alias("next"), F.col("levels").alias("l"), F.col("distance").alias("d"))
        more = now.join(over, F.col("up") == F.col("n"), "left").select("node", F.col("next").alias("up"), (F.col("levels") + F.coalesce("l", F.lit(0))).alias("levels"), (F.col("distance") + F.coalesce("d", F.lit(0.0))).alias("distance"))
        now, rounds = more.checkpoint(), rounds + 1


def root_distances(tree: DataFrame) -> DataFrame:
    """node, levels, depth: edges and length from the root to each node."""
    for last in _jumps(tree):
        pass
    return last.select("node", "levels", F.col("distance").alias("depth"))


def path_to_root(tree: DataFrame, node: int) -> DataFrame:
    """node, levels, distance: the nodes on the way from a node (levels 0) to the root."""
    held = tree.filter(F.col("node") == node).select("node", F.lit(0).cast("long").alias("levels"), F.lit(0.0).alias("distance"))
    for jump in _jumps(tree):
        to = jump.filter("up IS NOT NULL").select(F.col("node").alias("n"), "up", F.col("levels").alias("l"), F.col("distance").alias("d"))
        further = held.join(to, F.col("node") == F.col("n")).select(F.col("up").alias("node"), F.col("levels") + F.col("l"), F.col("distance") + F.col("d"))
        held = held.union(further).distinct().checkpoint()
    return held


def reroot(tree: DataFrame, node: int) -> DataFrame:
    """The tree with another node as root: the edges on its way to the old root turn round and keep their lengths.

    A node that isn't there, or is the root, changes nothing.
    """
    on = path_to_root(tree, node).select(F.col("node").alias("p"), "levels").checkpoint()
    edges = tree.select(F.col("node").alias("e"), "length")
    # Below a node of the way, in the new tree, is the node that was above it.
    below = on.join(edges, F.col("p") == F.col("e")).select("p", "length", (F.col("levels") + 1).alias("levels"))
    turned = on.select(F.col("p").alias("q"), "levels").join(below.select(F.col("p").alias("new_parent"), F.col("length").alias("new_length"), "levels"), "levels", "left").drop("levels")
    rows = tree.join(turned, F.col("node") == F.col("q"), "left")
    moved = F.col("q").isNotNull()
    return rows.select("node", F.when(moved, F.col("new_parent")).otherwise(F.col("parent")).alias("parent"), "label", F.when(moved, F.col("new_length")).otherwise(F.col("length")).alias("length"))


def with_node_on_branch(tree: DataFrame, node: int, new: int, from_node: float) -> DataFrame:
    """The tree with a new node on the branch above a node, at a distance from it; the root has no branch."""
    own = F.col("node") == node
    over = tree.filter(own & F.col("parent").isNotNull()).select(F.lit(new).cast("long").alias("node"), "parent", F.lit(None).cast("string").alias("label"), (F.coalesce("length", F.lit(0.0)) - from_node).alias("length"))
    split = own & F.col("parent").isNotNull()
    rows = tree.select("node", F.when(split, F.lit(new)).otherwise(F.col("parent")).cast("long").alias("parent"), "label", F.when(split, F.lit(float(from_node))).otherwise(F.col("length")).alias("length"))
    return rows.unionByName(over)


def rerooted_above(tree: DataFrame, node: int, new: int) -> DataFrame:
    """The tree rooted at a new node half way up the branch above a node."""
    length = tree.filter(F.col("node") == node).select(F.coalesce("length", F.lit(0.0)).alias("l")).first()
    return tree if length is None else reroot(with_node_on_branch(tree, node, new, length.l / 2), new)


def farthest_leaves(tree: DataFrame) -> tuple[int, int, float] | None:
    """Two leaves as far apart as any, and their distance: the leaf farthest from the root, and the one farthest from that."""
    tips = leaves(tree).select("node").distinct().checkpoint()
    best = lambda t: root_distances(t).join(tips, "node").agg(F.min(F.struct(-F.col("depth"), "node"))).first()[0]
    one = best(tree)
    if one is None:
        return None
    two = best(reroot(tree, one.node))
    return one.node, two.node, -two[0]


def midpoint_rooted(tree: DataFrame, new: int) -> DataFrame:
    """The tree rooted half way between its two farthest leaves, at a new node, or at a node that lies there."""
    found = farthest_leaves(tree)
    if found is None or found[0] == found[1]:
        return tree
    a, b, far = found
    turned = reroot(tree, a).checkpoint()
    # On the way from b to a: the last node that is not yet beyond the middle.
    at = path_to_root(turned, b).filter(F.col("distance") <= far / 2).agg(F.max(F.struct("distance", "levels", "node"))).first()[0]
    if at.distance == far / 2 and at.node not in (a, b):
        return reroot(turned, at.node)
    return reroot(with_node_on_branch(turned, at.node, new, far / 2 - at.distance), new)
