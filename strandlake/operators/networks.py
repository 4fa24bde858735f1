"""Phylogenetic networks: graphs without cycles whose nodes may have several parents.

Networks are rows (net, node, parent), one per parent, with a null parent for roots;
a leaf goes by its node. What all paths have in common is found from their numbers,
which are sums, level by level: a round holds one row per node and leaf, however
many paths join them. Numbers of paths are exact up to 38 digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators import hierarchy
from strandlake.operators.graph import components, ensure_checkpoints

COUNT = "decimal(38,0)"


def nodes(nets: DataFrame) -> DataFrame:
    """net, node: every node once, also one that is a parent alone."""
    return nets.select("net", "node").union(nets.filter("parent IS NOT NULL").select("net", "parent")).distinct()


def edges(nets: DataFrame) -> DataFrame:
    return nets.filter("parent IS NOT NULL").select("net", "node", "parent").distinct()


def leaves(nets: DataFrame) -> DataFrame:
    return nodes(nets).join(edges(nets).select("net", F.col("parent").alias("node")).distinct(), ["net", "node"], "left_anti")


def roots(nets: DataFrame) -> DataFrame:
    return nodes(nets).join(edges(nets).select("net", "node").distinct(), ["net", "node"], "left_anti")


def _walked(start: DataFrame, steps: DataFrame, longest: int) -> list[DataFrame]:
    """The numbers of paths from ``start`` (net, node, leaf, n) along steps (net, node, next), by their length."""
    found = [start.checkpoint()]
    while True:
        more = found[-1].join(steps, ["net", "node"]).groupBy("net", F.col("next").alias("node"), "leaf").agg(F.sum("n").cast(COUNT).alias("n")).checkpoint()
        if more.isEmpty():
            return found
        if len(found) > longest:
            raise ValueError("the network has a cycle")
        found.append(more)


def _paths_to_leaves(nets: DataFrame) -> list[DataFrame]:
    ensure_checkpoints(nets.sparkSession)
    start = leaves(nets).select("net", "node", F.col("node").alias("leaf"), F.lit(1).cast(COUNT).alias("n"))
    return _walked(start, edges(nets).select("net", "node", F.col("parent").alias("next")), nodes(nets).count())


def heights(nets: DataFrame) -> DataFrame:
    """net, node, height: the edges of the longest path down to a leaf."""
    ensure_checkpoints(nets.sparkSession)
    # Which leaf a path ends at doesn't matter here.
    start = leaves(nets).select("net", "node", F.lit(0).alias("leaf"), F.lit(1).cast(COUNT).alias("n"))
    steps = edges(nets).select("net", "node", F.col("parent").alias("next"))
    rounds = _walked(start, steps, nodes(nets).count())
    out = None
    for k, rows in enumerate(rounds):
        rows = rows.select("net", "node", F.lit(k).cast("long").alias("height"))
        out = rows if out is None else out.union(rows)
    return out.groupBy("net", "node").agg(F.max("height").alias("height"))


def mu_data(nets: DataFrame) -> DataFrame:
    """net, node, leaf, paths: how many paths lead from a node to a leaf, where any does."""
    out = None
    for rows in _paths_to_leaves(nets):
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("net", "node", "leaf").agg(F.sum("n").cast(COUNT).alias("paths"))


def _fingerprint(*of: Column | str) -> list[Column]:
    """Two 64-bit sums over rows: equal for equal sets of rows, in any order."""
    return [F.sum(F.xxhash64(F.lit(k), *of).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]


def mu_distance(nets: DataFrame, pairs: DataFrame) -> DataFrame:
    """net1, net2, distance for pairs (net1, net2): nodes of either whose mu vector, as a multiset, the other lacks.

    Vectors are compared by 128 bits of hash. Leaves are equal by node.
    """
    vectors = mu_data(nets).groupBy("net", "node").agg(*_fingerprint("leaf", "paths"))
    times = vectors.groupBy("net", "h1", "h2").agg(F.count(F.lit(1)).alias("c")).checkpoint()
    sides = pairs.select("net1", "net2", F.col("net1").alias("net"), F.lit(1).alias("sign")).union(pairs.select("net1", "net2", F.col("net2"), F.lit(-1)))
    both = sides.join(times, "net").groupBy("net1", "net2", "h1", "h2").agg(F.abs(F.sum(F.col("sign") * F.col("c"))).alias("apart"))
    return both.groupBy("net1", "net2").agg(F.sum("apart").alias("distance"))


def _passed(nets: DataFrame) -> DataFrame:
    """net, node, leaf, part (A or B) of the leaves that some path through the node leads to.

    The paths through a node are those down to it times those on from it.
    """
    mu = mu_data(nets).checkpoint()
    start = roots(nets).select("net", "node", F.lit(0).alias("leaf"), F.lit(1).cast(COUNT).alias("n"))
    steps = edges(nets).select("net", F.col("parent").alias("node"), F.col("node").alias("next"))
    above = None
    for rows in _walked(start, steps, nodes(nets).count()):
        above = rows if above is None else above.unionByName(rows)
    above = above.groupBy("net", "node").agg(F.sum("n").cast(COUNT).alias("down")).checkpoint()
    total = above.join(leaves(nets), ["net", "node"]).select("net", F.col("node").alias("leaf"), F.col("down").alias("total"))
    through = mu.join(above, ["net", "node"]).join(total, ["net", "leaf"])
    return through.select("net", "node", "leaf", F.when(F.col("down") * F.col("paths") == F.col("total"), "A").otherwise("B").alias("part"))


def tripartitions(nets: DataFrame) -> DataFrame:
    """net, node, leaf, part: A where every path from a root to the leaf passes the node, B where some do, else C.

    A row for every node and leaf, by definition.
    """
    known = _passed(nets)
    grid = nodes(nets).join(leaves(nets).select("net", F.col("node").alias("leaf")), "net")
    return grid.join(known, ["net", "node", "leaf"], "left").withColumn("part", F.coalesce("part", F.lit("C")))


def tripartition_counts(nets: DataFrame) -> DataFrame:
    """net, node, strict, some, others: the sizes of its parts A, B and C, the last of which is what is left of the leaves."""
    known = _passed(nets).groupBy("net", "node").agg(F.count_if(F.col("part") == "A").alias("strict"), F.count_if(F.col("part") == "B").alias("some"))
    size = leaves(nets).groupBy("net").agg(F.count(F.lit(1)).alias("leaves"))
    every = nodes(nets).join(known, ["net", "node"], "left").fillna(0, ["strict", "some"]).join(size, "net")
    return every.select("net", "node", "strict", "some", (F.col("leaves") - F.col("strict") - F.col("some")).alias("others"))


def _tripartition_keys(nets: DataFrame) -> DataFrame:
    """net, node, h1, h2: the fingerprint of a node's rows of ``tripartitions``, without those rows.

    It is that of all leaves in part C, changed by the leaves that are in A or B.
    """
    value = lambda k, part: F.xxhash64(F.lit(k), "leaf", part).cast("decimal(38,0)")
    none = leaves(nets).withColumnRenamed("node", "leaf").groupBy("net").agg(*(F.sum(value(k, F.lit("C"))).alias(f"c{k}") for k in (1, 2)))
    known = _passed(nets).groupBy("net", "node").agg(*(F.sum(value(k, F.col("part")) - value(k, F.lit("C"))).cast("decimal(38,0)").alias(f"d{k}") for k in (1, 2)))
    every = nodes(nets).join(known, ["net", "node"], "left").join(none, "net")
    return every.select("net", "node", *((F.col(f"c{k}") + F.coalesce(f"d{k}", F.lit(0).cast("decimal(38,0)"))).cast("decimal(38,0)").alias(f"h{k}") for k in (1, 2)))


def tripartition_error(nets: DataFrame, pairs: DataFrame) -> DataFrame:
    """net1, net2, error: the mean share of either's edges into nodes whose tripartition no edge of the other leads into."""
    keys = _tripartition_keys(nets)
    into = edges(nets).join(keys, ["net", "node"]).groupBy("net", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    size = into.groupBy("net").agg(F.sum("n").alias("edges"))

    def missed(one: str, other: str) -> DataFrame:
        own = pairs.withColumn("net", F.col(one)).join(into, "net")
        there = into.select(F.col("net").alias(other), "h1", "h2")
        lone = own.join(there, [other, "h1", "h2"], "left_anti").groupBy("net1", "net2").agg(F.sum("n").alias("lone"))
        whole = pairs.join(size.withColumnRenamed("net", one), one)
        return whole.join(lone, ["net1", "net2"], "left").select("net1", "net2", (F.coalesce("lone", F.lit(0)) / F.col("edges")).alias("share"))

    both = missed("net1", "net2").union(missed("net2", "net1"))
    return both.groupBy("net1", "net2").agg((F.sum("share") / 2).alias("error"))


def node_kinds(nets: DataFrame) -> DataFrame:
    """net, node, parents, children, tree_children (those of one parent)."""
    e = edges(nets)
    up = e.groupBy("net", "node").agg(F.count(F.lit(1)).alias("parents"))
    down = e.join(up, ["net", "node"]).groupBy("net", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"), F.count_if(F.col("parents") == 1).alias("tree_children"))
    return nodes(nets).join(up, ["net", "node"], "left").join(down, ["net", "node"], "left").fillna(0, ["parents", "children", "tree_children"])


def is_tree_child(nets: DataFrame) -> DataFrame:
    """net, tree_child: whether every inner node has a child that has no other parent."""
    return node_kinds(nets).groupBy("net").agg(F.bool_and((F.col("children") == 0) | (F.col("tree_children") > 0)).alias("tree_child"))


def is_time_consistent(net: DataFrame) -> bool:
    """Whether the nodes of one network can be dated so that a node with several parents is as old as they, and any other is younger."""
    e = edges(net).select("node", "parent")
    hybrid = e.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")
    alike = components(e.join(hybrid, "node", "left_semi").select(F.col("node").alias("u"), F.col("parent").alias("v"))).select(F.col("node").alias("x"), "component")
    tree = e.join(hybrid, "node", "left_anti")
    named = tree.join(alike, F.col("node") == F.col("x"), "left").select(F.coalesce("component", "node").alias("node"), "parent")
    named = named.join(alike, F.col("parent") == F.col("x"), "left").select("node", F.coalesce("component", "parent").alias("parent"))
    try:
        hierarchy.closure(named)
    except ValueError:
        return False
    return True
