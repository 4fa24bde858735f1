"""Terms and taxa as an edge table (node, parent, label): neighbours and closures.

A term has a row per parent, so that terms may form any graph without cycles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import trees
from strandlake.operators.graph import ensure_checkpoints


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, levels): every pair that a path upward joins, once, with the fewest levels of any path.

    Doubles the levels known per round. A pair is known from one row on, so that
    diamonds, however many in a row, add no rows. A cycle raises ValueError.
    """
    ensure_checkpoints(edges.sparkSession)
    known = edges.filter("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("levels")).distinct().checkpoint()
    reach, new = 1, known
    while True:
        if not new.filter("node = ancestor").isEmpty():
            raise ValueError("the terms have a cycle")
        # A shortest path of more levels passes a node that is just so many levels up.
        top = known.filter(F.col("levels") == reach).select(F.col("node").alias("n"), F.col("ancestor").alias("via"))
        more = top.join(known, F.col("via") == F.col("node")).select(F.col("n").alias("node"), "ancestor", (F.col("levels") + reach).alias("levels"))
        new = more.groupBy("node", "ancestor").agg(F.min("levels").alias("levels")).join(known, ["node", "ancestor"], "left_anti").checkpoint()
        if new.isEmpty():
            return known
        known, reach = known.unionByName(new), 2 * reach


def child_terms(terms: DataFrame) -> DataFrame:
    """term, child."""
    return terms.filter("parent IS NOT NULL").select(F.col("parent").alias("term"), F.col("node").alias("child"))


def parent_terms(terms: DataFrame) -> DataFrame:
    """term, parent."""
    return terms.filter("parent IS NOT NULL").select(F.col("node").alias("term"), "parent")


def ancestor_terms(terms: DataFrame) -> DataFrame:
    """term, ancestor, levels (the fewest): everything above a term, once each."""
    return closure(terms).select(F.col("node").alias("term"), "ancestor", "levels")


def descendant_terms(terms: DataFrame) -> DataFrame:
    """term, descendant, levels (the fewest): everything below a term, once each."""
    return ancestor_terms(terms).select(F.col("ancestor").alias("term"), F.col("term").alias("descendant"), "levels")


def root_terms(terms: DataFrame) -> DataFrame:
    """Terms without any parent."""
    return terms.groupBy(F.col("node").alias("term")).agg(F.count("parent").alias("n")).filter("n = 0").select("term")


def leaf_terms(terms: DataFrame) -> DataFrame:
    return trees.leaves(terms).select(F.col("node").alias("term")).distinct()


def find_terms(terms: DataFrame, text: str) -> DataFrame:
    """Terms whose label contains a text, whatever its case."""
    return terms.filter(F.contains(F.lower("label"), F.lit(text.lower()))).select(F.col("node").alias("term"), "label").distinct()


def lineages(terms: DataFrame, mark: str = ";") -> DataFrame:
    """term, lineage: the labels from the root down to the term, by the path of each term's least parent."""
    one = terms.groupBy("node").agg(F.min("parent").alias("parent"), F.min("label").alias("label"), F.lit(None).cast("double").alias("length"))
    up = trees.ancestors(one).join(one.select(F.col("node").alias("n"), F.col("label").alias("name")), F.col("ancestor") == F.col("n"))
    parts = F.reverse(F.array_sort(F.collect_list(F.struct("levels", "name"))))
    return up.groupBy(F.col("node").alias("term")).agg(F.array_join(F.transform(parts, lambda x: x["name"]), mark).alias("lineage"))
