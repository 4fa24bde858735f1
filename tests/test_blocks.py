"""Pairs of texts in blocks: every pair of rows comes once, whatever copies, blocks and words there are, and none is shuffled."""

import itertools
import random
from collections import Counter

import pytest

from strandlake.operators import blocks, codons, otu


def plain(a, b):
    both = [(x, y) for x, y in zip(a, b, strict=True) if x in "ACGT" and y in "ACGT"]
    ts = sum(x + y in ("AG", "GA", "CT", "TC") for x, y in both)
    return len(both), ts, sum(x != y for x, y in both) - ts


@pytest.mark.parametrize("length", [40, 130, 64 * otu.FLAT_WORDS + 1])
def test_all_pairs_in_blocks(spark, monkeypatch, length):
    for name, value in (("COPIES", 2), ("BLOCK", 4), ("LEAST_BLOCK", 2)):
        monkeypatch.setattr(blocks, name, value)
    rng = random.Random(length)
    texts = ["".join(rng.choice("ACGT-N") for _ in range(length)) for _ in range(9)]
    rows = [(f"{k:02}", texts[k * k % 9]) for k in range(25)] + [("98", texts[0]), ("99", None)]
    found = otu.all_pairs(spark.createDataFrame(rows, "id string, seq string").repartition(3), 10, digits=6)
    want = Counter((i, j, *c) for (i, a), (j, b) in itertools.combinations(rows[:-1], 2) if (c := plain(a, b))[0] >= 10)
    assert Counter((r.id1, r.id2, r.n, r.ts, r.tv) for r in found.collect()) == want and len(want) > 200


def test_all_pairs_of_equal_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    # Texts whose keys collide are taken for one, and their rows' pairs come once all the same.
    whole = blocks.texts
    monkeypatch.setattr(blocks, "texts", lambda rows, *by: whole(rows, *by).withColumn("key", F.lit(7).cast("long")))
    rows = [(f"{k}", "ACGT"[k % 3] * 30) for k in range(7)]
    found = [(r.id1, r.id2) for r in otu.all_pairs(spark.createDataFrame(rows, "id string, seq string")).collect()]
    assert sorted(found) == list(itertools.combinations([i for i, _ in rows], 2))


def test_all_pairs_are_not_shuffled(spark):
    rows = spark.createDataFrame([(f"{k}", "ACGT"[k % 3] * 30) for k in range(7)], "id string, seq string")
    plan = otu.all_pairs(rows)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1 and "Exchange" not in plan[: plan.index("Join")]


@pytest.mark.parametrize("by", [None, "g"])
def test_ka_ks_in_blocks(spark, monkeypatch, by):
    rng = random.Random(5)
    parent = "".join(rng.choice("ACGT") for _ in range(60))
    texts = [parent[:k] + rng.choice("ACGT") + parent[k + 1 :] for k in rng.sample(range(60), 9)] + [parent[:30]]
    rows = [(k % 2, f"{k:02}", texts[k * k % 10]) for k in range(24)] + [(0, "99", None)]
    frame = spark.createDataFrame(rows, "g int, id string, seq string")
    whole = {tuple(r) for r in codons.all_ka_ks(frame, by, digits=6).collect()}
    for name, value in (("COPIES", 2), ("BLOCK", 4), ("LEAST_BLOCK", 2)):
        monkeypatch.setattr(blocks, name, value)
    found = codons.all_ka_ks(frame, by, digits=6)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == whole
    # Pairs of two rows alone, for some of them.
    at = found.columns.index("id1")
    for (g, i, a), (h, j, b) in list(itertools.combinations(rows[:-1], 2))[::40]:
        alone = codons.all_ka_ks(spark.createDataFrame([(g, i, a), (h, j, b)], "g int, id string, seq string"), by, digits=6)
        assert [tuple(r) for r in alone.collect()] == [r for r in got if r[at : at + 2] == (i, j)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1 and "Exchange" not in plan[: plan.index("Join")]
