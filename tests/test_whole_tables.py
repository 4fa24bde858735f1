"""Queries on whole tables against brute force."""

import random

import pytest

from strandlake.operators import tables
from strandlake.plans import registry


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_nearest(words, names):
    return {w: min((plain_distance(w, n), n) for n in names) for w in words}


def test_every_part_has_a_nearest_name(spark, sf_dir):
    names = {r.p_name for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    found = registry.queries()["nearest_names_all"](spark, sf_dir).collect()
    assert {r.w: (r.distance, r.nearest) for r in found} == plain_nearest({"x" + n for n in names}, names)
    assert len(found) == len(names) > registry.queries()["nearest_names"](spark, sf_dir).count()


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_nearest_at_any_distance(spark, letters):
    rng = random.Random(3)
    text = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    names = {text(12) for _ in range(60)} | {"é😀"}
    words = {text(14) for _ in range(60)} | set(list(names)[:5]) | {"", "z" * 30, "é"}
    frame = lambda rows, c: spark.createDataFrame([(x,) for x in [*rows, None]], f"{c} string")
    found = tables.nearest(frame(words, "w"), frame(names, "name")).collect()
    assert len(found) == len(words)
    assert {r.w: (r.distance, r.nearest) for r in found} == plain_nearest(words, names)
    assert tables.nearest(frame(words, "w"), frame([], "name")).count() == 0


def test_every_group_is_aligned(spark, sf_dir):
    from strandlake.plans import derived

    column = {}
    for r in derived.columns(derived.gapped(spark, sf_dir, "supplier")).collect():
        column.setdefault((r.grp, r.pos), set()).add(r.base)
    assert len({g for g, _ in column}) > 1
    codes = {"".join(sorted(b)): c for c, b in {"A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT"}.items()}
    run = lambda name: {(r.grp, r.pos): r for r in registry.queries()[name](spark, sf_dir).collect()}
    assert {k: r.code for k, r in run("consensus_iupac_all").items()} == {k: codes.get("".join(sorted(b & set("ACGT"))), "N") for k, b in column.items()}
    lines = {k: (r.mark, r.any_gap, r.all_gap) for k, r in run("match_and_gap_lines_all").items()}
    assert lines == {k: ("*" if len(b) == 1 and b != {"-"} else " ", "-" in b, b == {"-"}) for k, b in column.items()}
    assert {k: r.text for k, r in run("bracket_string_all").items()} == {k: min(b) if len(b) == 1 else f"[{'/'.join(sorted(b))}]" for k, b in column.items()}


@pytest.mark.parametrize(("cutoff", "width", "holes"), [(0.02, 200, 0), (0.05, 64, 1), (0.1, 150, 4), (0.3, 40, 2)])
def test_near_pairs_of_gapped_rows(spark, cutoff, width, holes):
    from strandlake.operators import otu

    rng = random.Random(width)
    parents = ["".join(rng.choices("ACGT", k=width)) for _ in range(3)]
    found = {}
    for k in range(90):
        s = list(parents[k % 3])
        for _ in range(rng.randint(0, int(2 * cutoff * width) + 1)):
            s[rng.randrange(width)] = rng.choice("ACGT")
        for _ in range(rng.randint(0, holes)):
            s[rng.randrange(width)] = rng.choice("-N")
        head, tail = (rng.randint(0, width // (2 if k % 9 == 0 else 4)) for _ in "ab")
        s[:head] = "-" * head
        found["".join(s[: width - tail]) + "-" * (tail if k % 2 else 0)] = f"i{k:02d}"
    rows = spark.createDataFrame([(i, s) for s, i in found.items()] + [("none", None), ("gap", "-" * width), ("empty", "")], "id string, seq string")
    key = lambda f: sorted((r.id1, r.id2, r.n, r.ts, r.tv) for r in f.collect())
    for least in (0, 25):
        want = key(otu.all_pairs(rows, least).filter(f"k2p <= {cutoff}"))
        assert key(otu.near_pairs(rows, cutoff, least)) == want
        assert want


def test_segments_leave_one_whole():
    from strandlake.operators.otu import segment_length

    for cutoff, length, spoiled in ((0.02, 658, 0), (0.02, 658, 2), (0.05, 64, 1), (0.3, 40, 0)):
        size, least = segment_length(cutoff, length // 2, length, spoiled), length // 2
        whole = lambda start, n: (start + n) // size - -(-start // size)
        assert all(whole(start, n) > int(cutoff * n) + 2 * spoiled for n in range(least, length + 1) for start in range(length - n + 1))
    assert segment_length(1.5, 10, 20, 0) == 0
