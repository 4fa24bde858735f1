"""Alignment and tree building on worked examples."""

import random

import pytest

from strandlake.operators import pairwise


def test_documented_alignment():
    # Six matches, two mismatches, one gap of three: 24 - 6 - 2 - 3 = 13. (The example's text sums these to 15.)
    assert pairwise.align("abcdefghajklm", "abbdhijk") == (13, "abcdefghajklm", "abbd---hijk--")


@pytest.mark.parametrize("options", [{}, {"free_ends": False}, {"local": True}])
def test_score_is_that_of_the_alignment(options):
    rng = random.Random(9)
    for _ in range(40):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 12))) for _ in range(2))
        score, x, y = pairwise.align(a, b, **options)
        assert len(x) == len(y)
        if not options.get("local"):
            assert (x.replace("-", ""), y.replace("-", "")) == (a, b)
        inner = range(len(x))
        if not options:
            solid = [k for k in inner if x[k] != "-" and y[k] != "-"]
            inner = range(solid[0], solid[-1] + 1) if solid else range(0)
        total, run = 0, None
        for k in inner:
            kind = "x" if x[k] == "-" else "y" if y[k] == "-" else None
            total += (4 if x[k] == y[k] else -3) if kind is None else -1 - 2 * (kind != run)
            run = kind
        assert total == score


def test_neighbour_joining_of_additive_distances():
    d = {("a", "b"): 5, ("a", "c"): 9, ("a", "d"): 9, ("a", "e"): 8, ("b", "c"): 10, ("b", "d"): 10, ("b", "e"): 9, ("c", "d"): 8, ("c", "e"): 7, ("d", "e"): 3}
    rows = {r[0]: r for r in pairwise.build_tree(list("abcde"), d)}

    def path(x):
        out, at = {x: 0.0}, x
        total = 0.0
        while rows[at][1] is not None:
            total += rows[at][3]
            at = rows[at][1]
            out[at] = total
        return out

    for (x, y), want in d.items():
        p, q = path("abcde".index(x)), path("abcde".index(y))
        assert min(p[k] + q[k] for k in p if k in q) == pytest.approx(want)


def test_upgma_heights(spark):
    pairs = spark.createDataFrame([("g", "a", "b", 2.0), ("g", "a", "c", 6.0), ("g", "b", "c", 6.0)], "grp string, id1 string, id2 string, distance double")
    rows = {r.label or r.node: r.length for r in pairwise.trees_of_groups(pairs, "grp", "upgma").collect()}
    assert rows["a"] == rows["b"] == 1 and rows["c"] == 3


def test_aligned_pairs(spark):
    pairs = spark.createDataFrame([("1", "2", "ACGTT", "ACTT"), ("1", "3", None, "A")], "id1 string, id2 string, seq1 string, seq2 string")
    found = {r.id2: (r.score, r.aligned1, r.aligned2) for r in pairwise.aligned_pairs(pairs).collect()}
    assert found["2"][0] == 13 and found["3"] == (0.0, "-", "A")
