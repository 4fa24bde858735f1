"""Connected components of an edge table, without ever gathering a component.

Edges are first thinned to a forest partition by partition (union-find), then
large-star and small-star steps alternate until nothing changes. Each step is an
aggregate (a minimum per node, combined before the shuffle) and a join of the
edges with one row per node, whose hot keys Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Scratch, lean

EDGE = "u long, v long"


class UnionFind:
    """Sets of ids; a set's root is its least id."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


@lean
def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links each id to its root in this partition: at most as many rows as came in."""
    sets = UnionFind()
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(u, v)
    rows = [(x, sets.find(x)) for x in list(sets.parent)]
    rows = [(u, v) for u, v in rows if u != v]
    yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for every id of ``edges`` (u, v): the least id that it reaches.

    Self-links and repeated edges do nothing; no edges give no rows.
    """
    edges = scratch.keep(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").mapInArrow(_forest, EDGE), f"{name}-0")
    seen, k = _mark(edges), 0
    while seen[0]:
        k += 1
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = large.join(least, F.col("u") == F.col("n")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = scratch.keep(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(ends.select("component", "component").distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
    return tuple(row)
