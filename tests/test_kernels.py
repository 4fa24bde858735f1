"""Kernels and closures against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import distance, seqfn
from strandlake.operators import trees


def test_plane_counts_equal_a_walk_over_both(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("ACGTACGTN-a") for _ in range(n))
    pairs = [(make(n), make(m)) for n, m in ((0, 5), (1, 1), (63, 63), (64, 64), (65, 65), (130, 100), (300, 300))]
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", distance.counts(F.col("a"), F.col("b")).alias("c")).collect():
        both = [(x, y) for x, y in zip(r.a, r.b, strict=False) if x in "ACGT" and y in "ACGT"]
        ts = sum(x + y in ("AG", "GA", "CT", "TC") for x, y in both)
        assert tuple(r.c) == (len(both), ts, sum(x != y for x, y in both) - ts)


@pytest.mark.parametrize(("size", "step"), [(1, 1), (3, 1), (2, 5), (256, 256), (257, 100), (300, 7)])
def test_windows_equal_slices(spark, size, step):
    rng = random.Random(size)
    texts = ["", "ab", "abc", "é日本x", "x" * 255 + "yz", "".join(rng.choice("abé日") for _ in range(1500)), None]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", seqfn.windows(F.col("t"), size, step).alias("w")).collect():
        want = None if r.t is None else [(i + 1, r.t[i : i + size]) for i in range(0, len(r.t) - size + 1, step)]
        assert (None if r.w is None else [tuple(x) for x in r.w]) == want


def test_ancestors_of_a_deep_chain_and_of_a_cycle(spark):
    schema = "node long, parent long, label string, length double"
    chain = spark.createDataFrame([(k, k - 1 if k else None, str(k), 1.0) for k in range(100)], schema)
    found = {(r.node, r.ancestor): (r.levels, r.distance) for r in trees.ancestors(chain).collect()}
    assert found == {(k, j): (k - j, float(k - j)) for k in range(100) for j in range(k + 1)}
    with pytest.raises(ValueError, match="cycle"):
        trees.ancestors(spark.createDataFrame([(1, 2, "a", 1.0), (2, 1, "b", 1.0)], schema))


def test_expansions_are_all_that_a_sequence_stands_for(spark):
    row = spark.createDataFrame([("RAY",)], "s string").select(seqfn.expansions(F.col("s")).alias("e"), seqfn.expansion_count(F.col("s")).alias("n")).first()
    assert (sorted(row.e), row.n) == (["AAC", "AAT", "GAC", "GAT"], 4)
