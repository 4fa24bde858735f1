"""Parsimony of a trait on a tree (node, parent): state sets and scores, level by level.

State sets are rows (node, state), so that a trait may have any number of states and a
node any number of children: what children agree on is a count per node and state,
added up before the shuffle. A round settles all nodes of one height.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.graph import ensure_checkpoints
from strandlake.operators.trees import leaves


def levels(tree: DataFrame) -> DataFrame:
    """node, parent, height: the edges of the longest path down to a leaf. A cycle raises ValueError."""
    ensure_checkpoints(tree.sparkSession)
    up = tree.select("node", "parent").checkpoint()
    rounds, most = [leaves(up).select("node").distinct().checkpoint()], up.count()
    while True:
        above = up.join(rounds[-1], "node").filter("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct().checkpoint()
        if above.isEmpty():
            break
        rounds.append(above)
        if len(rounds) > most:
            raise ValueError("the tree has a cycle")
    if rounds[0].isEmpty() and most:
        raise ValueError("the tree has a cycle")
    out = None
    for k, rows in enumerate(rounds):
        rows = rows.select("node", F.lit(k).alias("height"))
        out = rows if out is None else out.union(rows)
    return up.join(out.groupBy("node").agg(F.max("height").alias("height")), "node")


def fitch_up(tree: DataFrame, states: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sets (node, state) and scores (node, score) from the states (node, state) of the leaves upward.

    A node keeps the states that two of its children or more have; where there are
    none, all of its children's, which costs one change. An only child's states are
    its parent's at no cost; ``compat`` counts a change there, too. A leaf may have
    several states; one without any raises ValueError.
    """
    placed = levels(tree).checkpoint()
    over = placed.select(F.col("node").alias("parent"), F.col("height").alias("at"))
    placed = placed.join(over, "parent", "left").select("node", "parent", "at", "height").checkpoint()
    tips = placed.filter("height = 0").select("node", "parent", "at")
    given = states.select("node", "state").filter("state IS NOT NULL").distinct()
    # Rows of sets, with the parent that waits for them; a node's first state carries its score.
    first = F.row_number().over(Window.partitionBy("node").orderBy("state")) == 1
    now = tips.join(given, "node").select("node", "parent", "at", "state", F.lit(0).cast("long").alias("score"), first.alias("first"), F.lit(True).alias("new")).checkpoint()
    if not tips.join(now, "node", "left_anti").isEmpty():
        raise ValueError("a leaf has no state")
    settled = [now]
    for k in range(1, (placed.agg(F.max("height")).first()[0] or 0) + 1):
        met = now.filter(F.col("at") == k).groupBy("parent", "state").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("first"), F.col("score"))).alias("below"), F.count_if("first").alias("children"))
        whole = met.groupBy("parent").agg((F.max("n") > 1).alias("agreed"), F.sum("below").alias("below"), F.sum("children").alias("children"))
        costs = ~F.col("agreed") if compat else ~F.col("agreed") & (F.col("children") > 1)
        own = met.select("parent", "state", "n").join(whole, "parent").filter("n > 1 OR NOT agreed").select(F.col("parent").alias("node"), "state", (F.col("below") + costs.cast("long")).alias("score"))
        own = own.join(placed.select("node", "parent", "at"), "node").select("node", "parent", "at", "state", "score", first.alias("first"), F.lit(True).alias("new"))
        now = now.filter((F.col("at") > k) & F.col("parent").isNotNull()).withColumn("new", F.lit(False)).unionByName(own).checkpoint()
        settled.append(now.filter("new"))
    whole = settled[0]
    for rows in settled[1:]:
        whole = whole.unionByName(rows)
    return whole.select("node", "state"), whole.filter("first").select("node", "score")


def fitch_down(tree: DataFrame, sets: DataFrame, compat: bool = False) -> DataFrame:
    """(node, state): inner nodes keep the states that their parent has, too, from the root down; all of them where there is none.

    ``compat`` compares with the parent's set as it was before, and leaves no state
    where none is shared. Leaves keep theirs.
    """
    edges = tree.filter("parent IS NOT NULL").select("node", "parent")
    tips = leaves(tree).select("node").distinct()
    inner = edges.join(tips, "node", "left_anti")
    if compat:
        shared = inner.join(sets, "node").join(sets.select(F.col("node").alias("parent"), F.col("state").alias("s")), "parent").filter("state = s").select("node", "state")
        return sets.join(inner.select("node"), "node", "left_anti").unionByName(shared)
    ensure_checkpoints(tree.sparkSession)
    inner = inner.checkpoint()
    out = sets.join(tips, "node", "left_semi")
    now = sets.join(tree.filter("parent IS NULL").select("node"), "node", "left_semi").join(tips, "node", "left_anti").checkpoint()
    while not now.isEmpty():
        out = out.unionByName(now)
        above = now.select(F.col("node").alias("parent"), F.col("state").alias("s"))
        mine = inner.join(now.select(F.col("node").alias("parent")).distinct(), "parent").join(sets, "node")
        marked = mine.join(above, (mine["parent"] == above["parent"]) & (F.col("state") == F.col("s")), "left").select("node", "state", F.col("s").isNotNull().alias("both"))
        any_ = marked.groupBy("node").agg(F.max("both").alias("some"))
        now = marked.join(any_, "node").filter("both OR NOT some").select("node", "state").checkpoint()
    return out


def persistence(tree: DataFrame, sets: DataFrame) -> DataFrame:
    """node, state, persistence: the generations, the node's own included, that all below a node stay in its state.

    A node of several states counts by the first of them.
    """
    placed = levels(tree).join(sets.groupBy("node").agg(F.min("state").alias("state")), "node").checkpoint()
    known = placed.filter("height = 0").select("node", "state", F.lit(1).cast("long").alias("persistence")).checkpoint()
    edges = placed.select("node", "parent").join(placed.select(F.col("node").alias("parent"), F.col("height").alias("at"), F.col("state").alias("above")), "parent").checkpoint()
    for k in range(1, (placed.agg(F.max("height")).first()[0] or 0) + 1):
        held = edges.filter(F.col("at") == k).join(known, "node")
        made = held.groupBy(F.col("parent").alias("node"), F.col("above").alias("state")).agg((1 + F.min(F.when(F.col("state") == F.col("above"), F.col("persistence")).otherwise(0))).alias("persistence"))
        known = known.unionByName(made).checkpoint()
    return known
