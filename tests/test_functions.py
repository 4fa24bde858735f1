"""Scalar functions and small operators on fixtures, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import distance, ids, seqfn
from strandlake.operators import alignment, otu, ranges, resample, trees
from strandlake.sources import readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "want"), [("a|b", "a|b"), ("a|b|c", "b|c"), ("a|b|c|d", "c|d"), ("a|b|c|COI_5P", "b|c"), ("a|b|COI_5P|d", "a|b|COI_5P|d"), ("a|b|c|d|e", "c|d"), ("a b c", "a_b c")])
def test_short_id(spark, value, want):
    assert one(spark, ids.short_id(F.lit(value))) == want


def test_sequence_functions(spark):
    assert one(spark, seqfn.mask_ambiguous(F.lit("ANVRt-"))) == "A-V-t-"
    assert one(spark, seqfn.reverse_complement(F.lit("AACGN-"))) == "-CGTT"
    assert one(spark, seqfn.translate(F.lit("ATGTAAGG"))) == "M*?"
    assert one(spark, seqfn.translate(F.lit(""))) == ""
    assert one(spark, seqfn.frame_shift(F.lit("TAACC"))) == 1
    assert one(spark, seqfn.back_translate(F.lit("M-K"), F.lit("ATGAAA"))) == "ATG---AAA"
    assert one(spark, ids.lineage(F.array(*map(F.lit, ["x", "a", "b", "COMMENT", "c"])))) == "a;b"


def test_golden_kmers(spark):
    rows = spark.createDataFrame([("ACCAACCA",)], "seq string").select(F.explode(seqfn.windows(F.col("seq"), 4, 1)).alias("w")).groupBy("w.text").count().collect()
    assert {r[0]: r[1] for r in rows} == {"ACCA": 2, "CCAA": 1, "CAAC": 1, "AACC": 1}


def plain_k2p(a, b):
    pairs = [(x, y) for x, y in zip(a, b, strict=True) if x in "ACGT" and y in "ACGT"]
    n = len(pairs)
    ts = sum(x + y in ("AG", "GA", "CT", "TC") for x, y in pairs)
    tv = sum(x != y for x, y in pairs) - ts
    if not n or 1 - 2 * ts / n - tv / n <= 0 or 1 - 2 * tv / n <= 0:
        return 2.0
    return -math.log(1 - 2 * ts / n - tv / n) / 2 - math.log(1 - 2 * tv / n) / 4


def test_k2p_against_plain(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ACGT-NV") for _ in range(60)), "".join(rng.choice("AACGT-") for _ in range(60))) for _ in range(30)]
    rows += [(a, a) for a, _ in rows] + [("", ""), ("----", "ACGT")]
    found = spark.createDataFrame(rows, "a string, b string").withColumn("c", distance.counts(F.col("a"), F.col("b"))).select("a", "b", distance.k2p(F.col("c.n"), F.col("c.ts"), F.col("c.tv")).alias("d")).collect()
    assert all(abs(r.d - plain_k2p(r.a, r.b)) < 1e-9 for r in found)


def plain_clusters(rows, cutoff, least_bases):
    """The greedy loops as described: representatives, re-matching, components."""
    distinct = {}
    for k, (i, s) in enumerate(rows):
        distinct[s] = (i, min(k, distinct.get(s, (i, k))[1]))
    seqs = {i: s for s, (i, _) in distinct.items()}
    order = {i: k for i, k in distinct.values()}
    near = lambda a, b: plain_k2p(seqs[a], seqs[b]) <= cutoff
    n = lambda a, b: sum(x in "ACGT" and y in "ACGT" for x, y in zip(seqs[a], seqs[b], strict=True))
    alive = sorted(seqs)
    for a in sorted(seqs):
        if any(b != a and near(a, b) and n(a, b) >= least_bases for b in alive):
            alive.remove(a)
    links = {q: [r for r in alive if r == q or near(q, r)] for q in seqs}
    new = []
    for q in sorted(seqs, key=order.get):
        if not links[q] and not any(near(q, r) for r in new):
            new.append(q)
    for q in seqs:
        links[q] += [r for r in new if r == q or (near(q, r) and order[r] < order[q])]
    parent = {i: i for i in seqs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for q, rs in links.items():
        for r in rs:
            a, b = sorted((find(q), find(r)))
            parent[b] = a
    return {i: find(i) for i in seqs}


def test_delimit_with_orphans(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("ACGT") for _ in range(60))

    def changed(s, k):
        at = rng.sample(range(60), k)
        return "".join(rng.choice("ACGT".replace(c, "")) if i in at else c for i, c in enumerate(s))

    seqs = [base]
    for _ in range(25):
        seqs.append(changed(rng.choice(seqs), rng.choice([1, 2, 3])))
    rows = [(k, f"id{rng.randrange(1000):04d}x{k}", "n", s) for k, s in enumerate(seqs)]
    found = otu.delimit(spark.createDataFrame(rows, "ord long, id string, name string, seq string"), 0.04).collect()
    want = plain_clusters([(r[1], r[3]) for r in rows], 0.04, 25)
    assert {r.id: r.otu for r in found} == want


def test_near_pairs_with_gaps_equal_all_pairs(spark):
    rng = random.Random(7)
    base = "".join(rng.choice("ACGT") for _ in range(60))
    rows = []
    for k in range(30):
        s = list(base)
        for i in rng.sample(range(60), rng.choice([0, 1, 2, 5])):
            s[i] = rng.choice("ACGT-N")
        rows.append((f"i{k:02d}", "".join(s)))
    df = spark.createDataFrame(rows, "id string, seq string")
    key = lambda d: {(r.id1, r.id2) for r in d.collect()}
    assert key(otu.near_pairs(df, 0.05)) == key(otu.all_pairs(df).filter("k2p <= 0.05"))


def test_promotion_takes_the_first_independent_set(spark):
    orphans = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "id string, ord long")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "id1 string, id2 string")
    assert {r.id for r in otu.promote(orphans, edges).collect()} == {"a", "c"}


def test_fasta_round_trip(spark, tmp_path):
    rows = [("a|b", "ACGT" * 40), ("c", "A-"), ("d", "")]
    writers.fasta(spark.createDataFrame(rows, "id string, seq string"), 60).coalesce(1).write.text(str(tmp_path / "x"))
    back = readers.fasta(spark, str(tmp_path / "x")).collect()
    assert sorted((r.id, r.seq) for r in back) == sorted(rows)


def test_genbank_scan(spark, tmp_path):
    text = 'LOCUS       AB1\nDEFINITION  Some thing\n            else.\nACCESSION   AB1\n  ORGANISM  Genus species\n            Eukaryota; Metazoa.\nFEATURES\n     source          1..8\n                     /organism="Genus species"\n                     /country="A\n                     B"\nORIGIN\n        1 acgtacgt\n//\n'
    (tmp_path / "x.gb").write_text(text)
    r = readers.genbank(spark, str(tmp_path / "x.gb")).withColumn("country", readers.qualifier("country")).first()
    assert (r.accession, r.organism, r.lineage, r.seq, r.country, r.definition) == ("AB1", "Genus species", ["Eukaryota", "Metazoa"], "ACGTACGT", "A B", "Some thing else.")


def test_newick():
    rows = trees.parse_newick("((a:1,b:2)x:0.5,(c,d:3)):0;")
    assert [r[2] for r in rows] == [None, "x", "a", "b", None, "c", "d"]
    assert trees.parse_newick(trees.to_newick(rows)) == rows


def test_contract_linear_paths(spark):
    t = spark.createDataFrame([(0, None, "r", 0.0), (1, 0, "x", 1.0), (2, 1, "y", 1.0), (3, 2, "a", 1.0), (4, 2, "b", 1.0), (5, 0, "c", 1.0)], "node long, parent long, label string, length double")
    found = {(r.node, r.parent, r.length) for r in trees.contract_linear_paths(t).collect()}
    assert found == {(0, None, 0.0), (2, 0, 2.0), (3, 2, 1.0), (4, 2, 1.0), (5, 0, 1.0)}


def test_map_coordinates(spark):
    rows = spark.createDataFrame([(1, "c", 5, 12)], "id long, seq_id string, start int, end int")
    pairs = spark.createDataFrame([("c", 1, 10, "g", 101, 1), ("c", 11, 20, "h", 1, -1)], "seq_id string, start int, end int, to_id string, to_start int, strand int")
    assert {(r.seq_id, r.start, r.end) for r in ranges.map_coordinates(rows, pairs).collect()} == {("g", 105, 110), ("h", 9, 10)}


def test_wide_form_of_long_form(spark):
    df = spark.createDataFrame([("a", "AC-T"), ("b", "ACGT")], "id string, seq string")
    assert {tuple(r) for r in alignment.wide_form(alignment.long_form(df)).collect()} == {("a", "AC-T"), ("b", "ACGT")}


def test_weights_sum_to_length(spark):
    assert all(sum(r.weights) == 20 for r in resample.column_weights(20, 3, spark).collect())
