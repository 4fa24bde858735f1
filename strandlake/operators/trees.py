"""Trees as edge tables (node, parent, label, length): closures and what follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.graph import ensure_checkpoints


def ancestors(tree: DataFrame) -> DataFrame:
    """(node, ancestor, levels, distance), each node its own ancestor at level 0.

    Doubles the levels known per round, so that a tree of any depth takes about
    log2 of its depth in rounds; a cycle raises ValueError.
    """
    ensure_checkpoints(tree.sparkSession)
    own = tree.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("levels"), F.lit(0.0).alias("distance"))
    up = tree.filter("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("levels"), F.coalesce("length", F.lit(0.0)).alias("distance"))
    known, reach, nodes = up.checkpoint(), 1, tree.count()
    while True:
        # Ancestors past the highest one known: those of the node that is ``reach`` levels up.
        top = known.filter(F.col("levels") == reach).select(F.col("node").alias("n"), F.col("ancestor").alias("via"), F.col("distance").alias("so_far"))
        more = top.join(known, F.col("via") == F.col("node")).select(F.col("n").alias("node"), "ancestor", F.col("levels") + reach, F.col("so_far") + F.col("distance"))
        more = more.toDF("node", "ancestor", "levels", "distance").checkpoint()
        if more.isEmpty():
            return own.unionByName(known)
        known, reach = known.unionByName(more), 2 * reach
        if reach > 2 * nodes:
            raise ValueError("the tree has a cycle")


def leaves(tree: DataFrame) -> DataFrame:
    return tree.join(tree.select(F.col("parent").alias("node")).filter("node IS NOT NULL").distinct(), "node", "left_anti")


def depths(tree: DataFrame) -> DataFrame:
    """Levels and branch length from the root to each node."""
    return ancestors(tree).groupBy("node").agg(F.max("levels").alias("levels"), F.max("distance").alias("depth"))


def clade_sizes(tree: DataFrame) -> DataFrame:
    """Per node: leaves below (itself, if one), nodes below, the branch length below, and the height."""
    up = ancestors(tree)
    tip = leaves(tree).select("node").withColumn("tip", F.lit(1))
    own = tree.select("node", F.coalesce("length", F.lit(0.0)).alias("len"))
    below = up.join(tip, "node", "left").join(own, "node")
    return below.groupBy(F.col("ancestor").alias("node")).agg(F.count("tip").alias("leaves"), (F.count(F.lit(1)) - 1).alias("descendants"), F.sum(F.when(F.col("levels") > 0, F.col("len")).otherwise(0.0)).alias("subtree_length"), F.max("distance").alias("height"))


def lowest_common(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """The lowest common ancestor of each pair (a, b), and the path length between them."""
    up = ancestors(tree)
    x = up.select(F.col("node").alias("a"), "ancestor", F.col("distance").alias("da"), F.col("levels").alias("la"))
    y = up.select(F.col("node").alias("b"), "ancestor", F.col("distance").alias("db"))
    both = pairs.join(x, "a").join(y, ["b", "ancestor"])
    first = F.row_number().over(Window.partitionBy("a", "b").orderBy("la"))
    return both.withColumn("k", first).filter("k = 1").select("a", "b", F.col("ancestor").alias("lca"), (F.col("da") + F.col("db")).alias("distance"))


def cherries(tree: DataFrame) -> DataFrame:
    """Nodes with exactly two children, both leaves."""
    tip = leaves(tree).select("node").withColumn("tip", F.lit(1))
    return tree.filter("parent IS NOT NULL").join(tip, "node", "left").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"), F.count("tip").alias("tips")).filter("children = 2 AND tips = 2").select("node")


def is_binary(tree: DataFrame) -> DataFrame:
    n = tree.filter("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    return n.agg((F.coalesce(F.max("n"), F.lit(0)) <= 2).alias("binary"))


def monophyletic(tree: DataFrame, groups: DataFrame) -> DataFrame:
    """Per trait of leaves (node, trait): whether its leaves are all the leaves of one node."""
    up = ancestors(tree)
    tips = groups.join(leaves(tree).select("node"), "node", "left_semi")
    total = tips.groupBy("trait").agg(F.count(F.lit(1)).alias("total"))
    held = tips.join(up, "node").groupBy("trait", "ancestor").agg(F.count(F.lit(1)).alias("held"))
    sizes = clade_sizes(tree).select(F.col("node").alias("ancestor"), F.col("leaves").alias("size"))
    whole = held.join(total, "trait").join(sizes, "ancestor")
    return whole.groupBy("trait").agg(F.bool_or((F.col("held") == F.col("total")) & (F.col("size") == F.col("total"))).alias("monophyletic"))


def clade_support(guide: DataFrame, replicates: DataFrame, reps: int, compat: bool = False) -> DataFrame:
    """Percent of replicate trees (rep, node, leaf) with each clade of the guide (node, leaf); ``compat`` divides by reps + 1."""
    clade = F.array_join(F.array_sort(F.collect_set("leaf")), ",")
    seen = replicates.groupBy("rep", "node").agg(clade.alias("clade")).select("rep", "clade").distinct().groupBy("clade").agg(F.count(F.lit(1)).alias("times"))
    return guide.groupBy("node").agg(clade.alias("clade")).join(seen, "clade", "left").select("node", "clade", F.floor(100 * F.coalesce("times", F.lit(0)) / (reps + compat)).alias("support"))


def contract_linear_paths(tree: DataFrame) -> DataFrame:
    """Without inner nodes that have one child; their lengths go to the child."""
    while True:
        single = tree.filter("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(F.col("parent").alias("s"))
        gone = tree.join(single, F.col("node") == F.col("s")).filter("parent IS NOT NULL")
        # Of a chain only the lowest goes in a round, so that no child's parent is gone too.
        gone = gone.join(gone.select(F.col("parent").alias("node")), "node", "left_anti").select(F.col("node").alias("g"), F.col("parent").alias("g_parent"), F.coalesce("length", F.lit(0.0)).alias("g_length"))
        if gone.isEmpty():
            return tree
        moved = tree.join(gone, F.col("parent") == F.col("g"), "left").select("node", F.coalesce("g_parent", "parent").alias("parent"), "label", (F.coalesce("length", F.lit(0.0)) + F.coalesce("g_length", F.lit(0.0))).alias("length"))
        tree = moved.join(gone.select(F.col("g").alias("node")), "node", "left_anti")


def parse_newick(text: str) -> list[tuple[int, int | None, str | None, float | None]]:
    """(node, parent, label, length) rows of one Newick tree; the root is node 0."""
    rows: list[list] = [[0, None, None, None]]
    stack, at, k, n = [0], 0, 0, len(text.rstrip().rstrip(";"))
    while k < n:
        c = text[k]
        if c == "(":
            stack.append(len(rows))
            rows.append([len(rows), at, None, None])
            at = stack[-1]
        elif c == ",":
            stack.pop()
            at = stack[-1]
            stack.append(len(rows))
            rows.append([len(rows), at, None, None])
            at = stack[-1]
        elif c == ")":
            stack.pop()
            at = stack[-1]
        elif not c.isspace():
            end = k
            if c == "'":
                end = text.index("'", k + 1) + 1
                rows[at][2] = text[k + 1 : end - 1]
            else:
                while end < n and text[end] not in "(),":
                    end += 1
                label, _, length = text[k:end].strip().partition(":")
                if label:
                    rows[at][2] = label
                if length:
                    rows[at][3] = float(length)
            k = end
            continue
        k += 1
    return [tuple(r) for r in rows]


def to_newick(rows: list[tuple[int, int | None, str | None, float | None]]) -> str:
    below: dict = {}
    for r in rows:
        below.setdefault(r[1], []).append(r)

    def text(r) -> str:
        inner = "(" + ",".join(map(text, below[r[0]])) + ")" if r[0] in below else ""
        return inner + (r[2] or "") + (f":{r[3]:g}" if r[3] is not None else "")

    return text(below[None][0]) + ";"
