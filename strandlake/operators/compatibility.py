"""Compatibility of two trees (node, parent, label, length) over the labels of their leaves.

A node's cluster is the set of labels below it. Two clusters conflict if they share
labels and each has one that the other lacks. What clusters share is counted through
the leaves: a leaf brings together the nodes above it in either tree, so that rows
grow with leaves and the depths of both trees, not with pairs of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import trees


def cluster_representation(tree: DataFrame) -> DataFrame:
    """node, label: the labels of the leaves at and below each node. Leaves without a label are left out."""
    tips = trees.leaves(tree).filter("label IS NOT NULL").select("node", "label").distinct()
    return trees.ancestors(tree).join(tips, "node").select(F.col("ancestor").alias("node"), "label").distinct()


def common_labels(tree1: DataFrame, tree2: DataFrame) -> DataFrame:
    """label: those that leaves of both trees have."""
    own = lambda t: trees.leaves(t).filter("label IS NOT NULL").select("label").distinct()
    return own(tree1).join(own(tree2), "label", "left_semi")


def topological_restriction(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """The tree of the leaves with these labels: nodes without one below go, and so do inner nodes with one child, also at the root."""
    kept = cluster_representation(tree).join(labels, "label", "left_semi").select("node").distinct().checkpoint()
    whole = trees.contract_linear_paths(tree.join(kept, "node", "left_semi").checkpoint()).checkpoint()
    while True:  # a root with one child leaves its place to that
        only = whole.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("node")
        root = whole.filter("parent IS NULL").join(only, "node", "left_semi").select("node").first()
        if root is None:
            return whole
        below = F.col("parent") == root.node
        whole = whole.filter(F.col("node") != root.node).select("node", F.when(~below, F.col("parent")).alias("parent"), "label", F.when(~below, F.col("length")).alias("length")).checkpoint()


def conflicts(tree1: DataFrame, tree2: DataFrame) -> DataFrame:
    """node1, node2, shared, only1, only2: clusters of two trees that overlap without one holding the other, over the labels of both."""
    common = common_labels(tree1, tree2)
    side = lambda t, k: cluster_representation(t).join(common, "label", "left_semi").select(F.col("node").alias(f"node{k}"), "label")
    one, two = side(tree1, 1).checkpoint(), side(tree2, 2).checkpoint()
    size = lambda rows, k: rows.groupBy(f"node{k}").agg(F.count(F.lit(1)).alias(f"size{k}"))
    shared = one.join(two, "label").groupBy("node1", "node2").agg(F.count(F.lit(1)).alias("shared"))
    both = shared.join(size(one, 1), "node1").join(size(two, 2), "node2")
    return both.select("node1", "node2", "shared", (F.col("size1") - F.col("shared")).alias("only1"), (F.col("size2") - F.col("shared")).alias("only2")).filter("only1 > 0 AND only2 > 0")


def is_compatible(tree1: DataFrame, tree2: DataFrame) -> bool:
    return conflicts(tree1, tree2).isEmpty()
