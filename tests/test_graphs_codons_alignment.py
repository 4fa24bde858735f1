"""Closures, networks, parsimony, codon changes and quality control against plain Python."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandlake.functions import ids, seqfn
from strandlake.operators import alignment, codons, haplotypes, hierarchy, networks, pairwise, pairwise_batch, parsimony, restriction, rows

TERMS = "node long, parent long, label string"
NET = "net string, node long, parent long"


def diamonds(k):
    """k diamonds in a row: 0 over 1 and 2 over 3, over 4 and 5 over 6 ..."""
    out = [(0, None, "r")]
    for i in range(k):
        top = 3 * i
        out += [(top + 1, top, f"a{i}"), (top + 2, top, f"b{i}"), (top + 3, top + 1, f"c{i}"), (top + 3, top + 2, f"c{i}")]
    return out


def test_diamonds_give_one_row_each(spark):
    terms = spark.createDataFrame(diamonds(6), TERMS)
    found = {(r.term, r.ancestor): r.levels for r in hierarchy.ancestor_terms(terms).collect()}
    assert len(found) == hierarchy.ancestor_terms(terms).count()
    assert found[18, 0] == 12 and found[3, 0] == 2 and found[4, 0] == 3 and (1, 2) not in found
    assert {r.term: r.lineage for r in hierarchy.lineages(terms).collect()}[6] == "r;a0;c0;a1;c1"
    assert [r.term for r in hierarchy.leaf_terms(terms).collect()] == [18]
    assert [r.term for r in hierarchy.root_terms(terms).collect()] == [0]


def test_closure_keeps_the_fewest_levels(spark):
    terms = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 3, "d"), (4, 1, "d"), (5, 4, "e"), (5, 4, "e")], TERMS)
    found = sorted((r.term, r.ancestor, r.levels) for r in hierarchy.ancestor_terms(terms).collect())
    assert found == [(2, 1, 1), (3, 1, 2), (3, 2, 1), (4, 1, 1), (4, 2, 2), (4, 3, 1), (5, 1, 2), (5, 2, 3), (5, 3, 2), (5, 4, 1)]
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.closure(spark.createDataFrame([(1, 2, "a"), (2, 3, "b"), (3, 1, "c")], TERMS))
    assert hierarchy.closure(terms.limit(0)).count() == 0


def random_network(rng, name, size):
    """Inner nodes 0 to size - 1, each but the first under one or two earlier ones, and leaves 100 on."""
    rows = [(name, 0, None)]
    for v in range(1, size):
        rows += [(name, v, p) for p in rng.sample(range(v), min(v, rng.choice([1, 1, 2])))]
    used = {p for _, _, p in rows}
    for k, v in enumerate([v for v in range(size) if v not in used] + [rng.randrange(size)]):
        rows.append((name, 100 + k, v))
    return rows


def plain_network(rows):
    below, above = {}, {}
    for _, v, p in rows:
        above.setdefault(v, set())
        if p is not None:
            below.setdefault(p, set()).add(v)
            above[v].add(p)
    tips = sorted(v for v in above if v not in below)

    def mu(v):
        return Counter({v: 1}) if v not in below else sum((mu(c) for c in below[v]), Counter())

    def height(v):
        return 1 + max(map(height, below[v])) if v in below else 0

    def reach(v, gone):
        return set() if v == gone else {v}.union(*(reach(c, gone) for c in below.get(v, ())))

    parts = {}
    for v in above:
        for leaf in tips:
            parts[v, leaf] = "C" if leaf not in reach(v, None) else "B" if leaf in reach(0, v) else "A"
    return above, below, tips, {v: mu(v) for v in above}, {v: height(v) for v in above}, parts


def test_networks_equal_plain_walks(spark):
    rng = random.Random(4)
    made = {}
    while len(made) < 3:
        rows = random_network(rng, f"n{len(made)}", 6)
        if not made or len(plain_network(rows)[2]) == len(plain_network(next(iter(made.values())))[2]):
            made[f"n{len(made)}"] = rows
    nets = spark.createDataFrame([r for rows in made.values() for r in rows], NET)
    plain = {name: plain_network(rows) for name, rows in made.items()}
    assert {(r.net, r.node): r.height for r in networks.heights(nets).collect()} == {(n, v): h for n, x in plain.items() for v, h in x[4].items()}
    assert {(r.net, r.node, r.leaf): int(r.paths) for r in networks.mu_data(nets).collect()} == {(n, v, leaf): c for n, x in plain.items() for v, m in x[3].items() for leaf, c in m.items()}
    assert {(r.net, r.node, r.leaf): r.part for r in networks.tripartitions(nets).collect()} == {(n, *k): p for n, x in plain.items() for k, p in x[5].items()}
    pairs = [(a, b) for a in made for b in made]
    asked = spark.createDataFrame(pairs, "net1 string, net2 string")

    def vectors(n):
        return Counter(tuple(sorted(m.items())) for m in plain[n][3].values())

    def into(n):
        above, _, tips, *_, parts = plain[n]
        return [tuple(parts[v, leaf] for leaf in tips) for v, ps in above.items() for _ in ps]

    want = {(a, b): sum(((vectors(a) - vectors(b)) + (vectors(b) - vectors(a))).values()) for a, b in pairs}
    assert {(r.net1, r.net2): r.distance for r in networks.mu_distance(nets, asked).collect()} == want
    assert any(want.values())
    missed = lambda a, b: sum(x not in into(b) for x in into(a)) / len(into(a))
    assert {(r.net1, r.net2): round(r.error, 9) for r in networks.tripartition_error(nets, asked).collect()} == {(a, b): round((missed(a, b) + missed(b, a)) / 2, 9) for a, b in pairs}
    tree_child = {n: all(v not in x[1] or any(len(x[0][c]) == 1 for c in x[1][v]) for v in x[0]) for n, x in plain.items()}
    assert {r.net: r.tree_child for r in networks.is_tree_child(nets).collect()} == tree_child


def test_time_consistency(spark):
    good = [("n", 0, None), ("n", 1, 0), ("n", 2, 0), ("n", 3, 1), ("n", 3, 2), ("n", 4, 3), ("n", 5, 1), ("n", 6, 2)]
    # Here 3 is as old as 1 and as its own ancestor 0.
    bad = [("n", 0, None), ("n", 1, 0), ("n", 3, 1), ("n", 3, 0), ("n", 4, 3)]
    assert networks.is_time_consistent(spark.createDataFrame(good, NET))
    assert not networks.is_time_consistent(spark.createDataFrame(bad, NET))


def random_tree(rng, size):
    return [(0, None)] + [(v, rng.randrange(max(0, v - 12), v)) for v in range(1, size)]


def plain_fitch(tree, states, compat):
    below = {}
    for v, p in tree:
        below.setdefault(p, []).append(v)
    sets, score, down, persist = {}, {}, {}, {}

    def up(v):
        if v not in below:
            sets[v], score[v] = set(states[v]), 0
            return
        for c in below[v]:
            up(c)
        met = Counter(s for c in below[v] for s in sets[c])
        both = {s for s, n in met.items() if n > 1}
        sets[v] = both or set(met)
        score[v] = sum(score[c] for c in below[v]) + (not both and (compat or len(below[v]) > 1))

    def lower(v, above):
        if v not in below:
            down[v] = sets[v]
        elif compat:
            down[v] = sets[v] & above if above is not None else sets[v]
        else:
            down[v] = (sets[v] & above or sets[v]) if above is not None else sets[v]
        for c in below.get(v, ()):
            lower(c, sets[v] if compat else down[v])

    def stay(v):
        for c in below.get(v, ()):
            stay(c)
        persist[v] = 1 + min((persist[c] if min(down[c]) == min(down[v]) else 0 for c in below[v]), default=0) if v in below else 1

    up(0)
    lower(0, None)
    if not compat:
        stay(0)
    return sets, score, down, persist


@pytest.mark.parametrize("compat", [False, True])
def test_parsimony_equals_recursion(spark, compat):
    rng = random.Random(7)
    tree = random_tree(rng, 40)
    tips = {v for v, _ in tree} - {p for _, p in tree}
    states = {v: {f"s{rng.choice([1, 1, 1, 2, 70 + v % 5])}"} | ({"s2"} if rng.random() < 0.1 else set()) for v in tips}
    frame = spark.createDataFrame(tree, "node long, parent long")
    sets, scores = parsimony.fitch_up(frame, spark.createDataFrame([(v, s) for v, x in states.items() for s in x], "node long, state string"), compat)
    down = parsimony.fitch_down(frame, sets, compat)
    want = plain_fitch(tree, states, compat)
    pairs = lambda x: {(v, s) for v, y in x.items() for s in y}
    assert {(r.node, r.state) for r in sets.collect()} == pairs(want[0])
    assert {r.node: r.score for r in scores.collect()} == want[1]
    assert {(r.node, r.state) for r in down.collect()} == pairs(want[2]) and down.count() == len(pairs(want[2]))
    if not compat:
        assert {r.node: r.persistence for r in parsimony.persistence(frame, down).collect()} == want[3]


def test_parsimony_refuses_what_it_cannot_score(spark):
    tree = spark.createDataFrame([(0, None), (1, 0)], "node long, parent long")
    with pytest.raises(ValueError, match="state"):
        parsimony.fitch_up(tree, spark.createDataFrame([(0, "x")], "node long, state string"))
    with pytest.raises(ValueError, match="cycle"):
        parsimony.levels(spark.createDataFrame([(0, 1), (1, 0)], "node long, parent long"))


CODE = seqfn.genetic_code()


def plain_changes(a, b):
    """By walking every order of the changes; a path that meets a stop counts no step after it, and no path."""
    at = [k for k in range(3) if a[k] != b[k]]
    one = lambda x, y: 1 if CODE[x] == CODE[y] else -1 if "*" in CODE[x] + CODE[y] else 0
    if len(at) < 2:
        return (one(a, b), 1 - one(a, b)) if at else (0, 0)
    paths, kept = 0, 0
    for order in itertools.permutations(at):
        x, stopped = a, False
        for k in order:
            y = x[:k] + b[k] + x[k + 1 :]
            if CODE[y] == "*":
                stopped = True
                break
            kept += one(x, y)
            x = y
        paths += not stopped
    return (kept / paths, len(at) - kept / paths) if paths else (0, 0)


def plain_sites(codon):
    total = 0
    for k in range(3):
        made = [CODE[codon[:k] + x + codon[k + 1 :]] for x in "ACGT" if x != codon[k]]
        total += made.count(CODE[codon]) / (3 - made.count("*"))
    return total


def plain_ka_ks(a, b):
    cut = lambda s: [s[i : i + 3] for i in range(0, len(s) // 3 * 3, 3)]
    solid = lambda c: set(c) <= set("ACGT")
    x, y = cut(a), cut(b)
    s = sum(plain_sites(c) for c in x + y if solid(c)) / 2
    both = [(p, q) for p, q in zip(x, y, strict=True) if solid(p) and solid(q)]
    changes = [plain_changes(p, q) for p, q in both]
    n = 3 * len(both) - s
    if s <= 0 or n <= 0:
        return None
    sd, nd = (sum(c[k] for c in changes) for k in (0, 1))
    ps, pn = sd / s, nd / n
    if ps >= 0.75 or pn >= 0.75:
        return None
    ds, dn = (-0.75 * math.log(1 - 4 * p / 3) for p in (ps, pn))
    if ds < 0 or dn < 0:
        return None
    vs, vn = (9 * p * (1 - p) / ((3 - 4 * p) ** 2 * 3 * len(both)) for p in (ps, pn))
    return s, n, sd, nd, ps, pn, ds, dn, vs, vn, (dn - ds) / math.sqrt(vs + vn) if vs + vn > 0 else 0.0


def coding_rows(rng, groups=6, members=4, codons_=30):
    out = []
    for g in range(groups):
        parent = [rng.choice([c for c in codons.CODONS if CODE[c] != "*"]) for _ in range(codons_)]
        for k in range(members):
            seq = "".join(c if rng.random() > 0.06 else rng.choice("ACGT-N") for c in "".join(parent))
            out.append((f"g{g}", f"{g}-{k}", seq.lower() if k == 1 else seq + "AC"[: k == 2]))
    return out


def test_ka_ks_equals_plain_paths(spark):
    rows = coding_rows(random.Random(5)) + [("g0", "odd", "ACG"), ("g9", "x", "---"), ("g9", "y", "---"), ("g8", "x", ""), ("g8", "y", ""), ("g7", "n", None), ("g7", "m", "ACG")]
    frame = codons.all_ka_ks(spark.createDataFrame(rows, "g string, id string, seq string"), "g")
    names = ["S", "N", "S_d", "N_d", "P_s", "P_n", "D_s", "D_n", "D_s_var", "D_n_var", "z_score"]
    found = {(r.g, r.id1, r.id2): [round(r[c], 9) + 0.0 for c in names] for r in frame.collect()}
    want = {}
    for (g, i, a), (h, j, b) in itertools.product(rows, repeat=2):
        if g == h and i < j and a is not None and b is not None and len(a) // 3 == len(b) // 3:
            made = plain_ka_ks(a.upper(), b.upper())
            if made:
                want[g, i, j] = [round(x, 9) + 0.0 for x in made]
    assert len(want) > 20 and found == want


def test_average_ka_ks(spark):
    rows = [(g, i, s[:90].upper()) for g, i, s in coding_rows(random.Random(6), 3)]
    frame = spark.createDataFrame(rows, "g string, id string, seq string")
    found = {r.g: r for r in codons.average_ka_ks(frame, "g", reps=12).collect()}
    for g, r in found.items():
        own = [x for (_, a), (_, b) in itertools.combinations([(i, s) for h, i, s in sorted(rows) if h == g], 2) if (x := plain_ka_ks(a, b))]
        assert r.D_s == pytest.approx(sum(x[6] for x in own) / len(own)) and r.D_n == pytest.approx(sum(x[7] for x in own) / len(own))
        assert r.D_s_var > 0 and r.z_score == pytest.approx((r.D_n - r.D_s) / math.sqrt(r.D_s_var + r.D_n_var))
    assert len(found) == 3


def test_tripartitions_are_counted_and_compared_without_the_grid(spark, monkeypatch):
    from pyspark.sql import functions as F

    edges = [(0, None), (1, 0), (2, 0), (3, 1), (4, 1), (4, 2), (5, 2), (6, 4)]
    rows = [("a", *e) for e in edges] + [("b", *e) for e in edges if e != (4, 2)]
    nets = spark.createDataFrame(rows, "net string, node long, parent long")
    whole = networks.tripartitions(nets).cache()
    of = lambda x: F.count_if(F.col("part") == x)
    want = {tuple(r) for r in whole.groupBy("net", "node").agg(of("A"), of("B"), of("C")).collect()}
    keys = {tuple(r) for r in whole.groupBy("net", "node").agg(*networks._fingerprint("leaf", "part")).collect()}
    monkeypatch.setattr(networks, "tripartitions", None)
    assert {tuple(r) for r in networks.tripartition_counts(nets).collect()} == want and len(want) == 14
    assert {tuple(r) for r in networks._tripartition_keys(nets).collect()} == keys
    (r,) = networks.tripartition_error(nets, spark.createDataFrame([("a", "b")], "net1 string, net2 string")).collect()
    assert 0 < r.error < 1


def test_compatible_pairs_of_long_texts_and_without_counts(spark, monkeypatch):
    rng = random.Random(9)
    parent = "".join(rng.choice("ACGT") for _ in range(300))
    texts = set()
    for k in range(60):
        at, hole = rng.choice((5, 100, 290, 299)), rng.choice((0, 4, 99, 280))
        seq = parent[:at] + rng.choice("ACGT") + parent[at + 1 :]
        texts.add((seq[:hole] + "-" * 21 + seq[hole + 21 :])[: rng.choice((60, 256, 257, 300))].ljust(300, "-"))
    rows = [("s", k, x) for k, x in enumerate(sorted(texts | {"-" * 300, parent}))]
    fits = lambda x, y: (both := [(p, q) for p, q in zip(x, y) if p != "-" != q]) and all(p == q for p, q in both)  # noqa: E731, B905
    want = {(i, j) for (_, i, x), (_, j, y) in itertools.combinations(rows, 2) if fits(x, y)}
    # Pairs are told apart by their words in the join, not one by one after it.
    monkeypatch.setattr(haplotypes.distance, "counts", None)
    for segment in (4, 16):
        found = haplotypes.compatible_pairs(spark.createDataFrame(rows, "sample string, ord long, seq string"), segment)
        assert sorted((r.ord1, r.ord2) for r in found.collect()) == sorted(want) != []


def test_ka_ks_tells_saturation_in_whole_numbers(spark):
    # 35 changes at 140 / 3 sites, and so three in four: the quotient of doubles is less than 0.75 by its last bit.
    a, b = "AGCGCGGGTACAACGATGATCACATCGCCGGGCATAAGATCGCGTTGCTGAATCATGAACTGTC", "GCGAGCCCCACAAACACTCCGCCTAGGAAGGAGGTCACAGGGCTGTCGCGTCACCTTGTTGCAC"
    assert codons.all_ka_ks(spark.createDataFrame([("1", a), ("2", b)], "id string, seq string")).collect() == []


def test_ka_ks_compares_distinct_sequences_once(spark, monkeypatch):
    texts = ["ATGAAACCC", "ATGAAGCCC", "ATGTAACCC"]
    rows = [("g", f"{k:03}", texts[k * 7 % 3]) for k in range(60)]
    seen, plain = [], codons.ka_ks
    monkeypatch.setattr(codons, "ka_ks", lambda pairs, *more: seen.append(pairs.count()) or plain(pairs, *more))
    found = codons.all_ka_ks(spark.createDataFrame(rows, "g string, id string, seq string"), "g").collect()
    want = sum(1 for (_, i, a), (_, j, b) in itertools.product(rows, repeat=2) if i < j and plain_ka_ks(a, b))
    assert seen == [9] and len(found) == want > 0


def test_average_ka_ks_weighs_copies(spark, monkeypatch):
    rows = [("g", f"{k:03}", s[:90].upper()) for k, (_, _, s) in enumerate(coding_rows(random.Random(6), 1) * 8)]
    seen, plain = [], codons.ka_ks
    monkeypatch.setattr(codons, "ka_ks", lambda pairs, *more: seen.append(pairs.count()) or plain(pairs, *more))
    (r,) = codons.average_ka_ks(spark.createDataFrame(rows, "g string, id string, seq string"), "g", reps=2).collect()
    own = [x for (_, _, a), (_, _, b) in itertools.combinations(rows, 2) if (x := plain_ka_ks(a, b))]
    assert r.D_s == pytest.approx(sum(x[6] for x in own) / len(own)) and r.D_n == pytest.approx(sum(x[7] for x in own) / len(own))
    assert sum(seen) <= 3 * len({s for _, _, s in rows}) ** 2


@pytest.mark.parametrize("options", [{}, {"free_ends": False}, {"gap_open": -5.5}, {"match": 1, "mismatch": -1, "gap_open": 0}])
def test_blocks_align_as_single_cells_do(options):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 15)))
    a, b = [text() for _ in range(250)] + ["é∂a"], [text() for _ in range(250)] + ["∂a"]
    assert pairwise_batch.align_many(a, b, **options) == [pairwise.align(x, y, **options) for x, y in zip(a, b, strict=True)]
    assert pairwise_batch.align_many([], []) == []


def plain_k2p(x, y):
    n = ts = tv = 0
    for p, q in zip(x, y, strict=True):
        if p in "ACGT" and q in "ACGT":
            n += 1
            ts += {p, q} in ({"A", "G"}, {"C", "T"})
            tv += p != q and {p, q} not in ({"A", "G"}, {"C", "T"})
    if not n or 1 - 2 * ts / n - tv / n <= 0 or 1 - 2 * tv / n <= 0:
        return 2.0
    return -math.log(1 - 2 * ts / n - tv / n) / 2 - math.log(1 - 2 * tv / n) / 4


def plain_control(rows, references, cutoff):
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    left, centres, out, k = dict(rows), dict(references), {}, 0
    while True:
        k += 1
        now = {}
        for i, s in left.items():
            best = []
            for ref, r in centres.items():
                ways = [(pairwise.align(w, r), back) for back, w in ((False, s), (True, turned(s)))]
                (score, x, y), back = max(ways, key=lambda w: (w[0][0], not w[1]))
                best.append((round(plain_k2p(x, y), 12), ref, back, "".join(p for p, q in zip(x, y, strict=True) if q != "-")))
            now[i] = min(best)
        kept = {i: x for i, x in now.items() if x[0] <= cutoff}
        out.update({i: (x[1], x[2], round(x[0], 9), x[3], k, i in kept) for i, x in now.items()})
        if len(kept) in (0, len(now)):
            return out
        left = {i: left[i] for i in kept}
        centres = {}
        for ref in {x[1] for x in kept.values()}:
            own = [x[3] for x in kept.values() if x[1] == ref]
            counts = [Counter(c for c in column if c in "ACGT") for column in itertools.zip_longest(*own, fillvalue="-")]
            centres[ref] = "".join(max(c, key=lambda b: (c[b], -"ACGT".index(b))) for c in counts if c)


def test_quality_control_equals_a_plain_loop(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    references = [("r1", text(60)), ("r2", text(70))]
    rows = []
    for k in range(24):
        base = references[k % 2][1]
        seq = "".join(c if rng.random() > rng.choice([0.02, 0.1, 0.2]) else rng.choice("ACGT") for c in base)
        at = rng.randrange(len(seq))
        seq = seq[:at] + seq[at + 2 :] if k % 3 else seq[:at] + text(3) + seq[at:]
        rows.append((f"q{k}", seq[::-1].translate(str.maketrans("ACGT", "TGCA")) if k % 5 == 0 else seq))
    rows += [("far", text(60)), ("none", "")]
    frame = spark.createDataFrame([*rows, ("null", None)], "id string, seq string")
    found = pairwise_batch.quality_controlled(frame, spark.createDataFrame(references, "ref string, refseq string"), 0.15)
    got = {r.id: (r.ref, r.reverse, round(r.k2p, 9), r.aligned, r.rounds, r.passed) for r in found.collect()}
    want = plain_control([*rows, ("null", "")], references, 0.15)
    assert got == want
    assert {x[5] for x in got.values()} == {True, False} and any(x[1] and x[5] for x in got.values())


def test_tag_rewrites(spark):
    from pyspark.sql import functions as F

    given = [("P1|Gen_sp|COI-5P", "T"), ("P1|COI-5P|Gen_sp", "T"), ("P1", "T"), ("P1|x", None), ("COI-5P", "T")]
    found = spark.createDataFrame(given, "id string, tag string").select(ids.tagged(F.col("id"), F.col("tag")), ids.tagged(F.col("id"), F.col("tag"), compat=True)).collect()
    assert [tuple(r) for r in found] == [("P1|Gen_sp_T",) * 2, ("P1|Gen_sp_T", "P1|Gen_sp|T"), ("P1_T",) * 2, ("P1|x_",) * 2, ("T",) * 2]


def test_an_absent_reference_loses_no_rows(spark):
    given = spark.createDataFrame([(1, "a", "AC-."), (2, "b", "A.GT")], "ord long, id string, seq string")
    assert {r.id: r.place for r in rows.reference_first(given, "zz").collect()} == {"a": 1, "b": 2}
    assert {r.id: r.place for r in rows.reference_first(given, "b").collect()} == {"b": 1, "a": 2}
    assert {r.id: r.seq for r in rows.undotted(given, "zz").collect()} == {"a": "AC-.", "b": "A.GT"}
    assert {r.id: r.seq for r in rows.undotted(given, "a").collect()} == {"a": "AC-.", "b": "ACGT"}
    assert {r.id: r.seq for r in alignment.against_reference(given, "zz").collect()} == {"a": "AC-.", "b": "A.GT"}


def test_sites_of_either_strand_and_codes(spark):
    given = spark.createDataFrame([("x", "AACTGAA"), ("y", "GATTCCCagGAGTC"), ("z", "")], "id string, seq string")
    enzymes = [("one", "CAG", 2), ("wild", "GANTC", 1), ("apart", "CAGG", 1, 3)]
    found = {(r.id, r.enzyme, r.position) for r in restriction.cut_positions(given, enzymes).collect()}
    # CTG, the other strand's CAG, lies at 3 to 5 of x.
    assert found == {("x", "one", 4), ("y", "wild", 1), ("y", "one", 8), ("y", "apart", 7), ("y", "wild", 10)}
    top = {(r.id, r.enzyme, r.position) for r in restriction.cut_positions(given, enzymes, both_strands=False).collect()}
    assert top == found - {("x", "one", 4)}
    assert [(r.start, r.end) for r in sorted(restriction.fragments(given, enzymes).filter("id = 'x'").collect())] == [(1, 4), (5, 7)]


def plain_distances(rows):
    """Between all leaves, over an undirected walk."""
    near, below = {}, Counter(p for _, p, *_ in rows)
    for v, p, _, length in rows:
        if p is not None:
            near.setdefault(v, []).append((p, length or 0.0))
            near.setdefault(p, []).append((v, length or 0.0))
    out = {}

    def walk(start, v, came, far):
        out[start, v] = far
        for w, length in near.get(v, ()):
            if w != came:
                walk(start, w, v, far + length)

    tips = [v for v, *_ in rows if v not in below]
    for v in tips:
        walk(v, v, None, 0.0)
    return {(a, b): round(x, 9) for (a, b), x in out.items() if b in tips}


TREE = "node long, parent long, label string, length double"


def test_new_roots_keep_leaves_apart_as_they_were(spark):
    from strandlake.operators import rooting

    rng = random.Random(3)
    rows = [(v, p, f"n{v}", None if p is None else rng.choice([0.5, 1.0, 2.25, 3.0])) for v, p in random_tree(rng, 25)]
    tree = spark.createDataFrame(rows, TREE)
    want = plain_distances(rows)
    tips = {a for a, _ in want}
    depth = {r.node: (r.levels, r.depth) for r in rooting.root_distances(tree).collect()}
    assert depth[0] == (0, 0.0) and all(depth[v] == (depth[p][0] + 1, depth[p][1] + x) for v, p, _, x in rows if p is not None)
    inner = next(v for v, p, *_ in rows if v not in tips and v)
    turned = [tuple(r) for r in rooting.reroot(tree, inner).collect()]
    assert [v for v, p, *_ in turned if p is None] == [inner] and len(turned) == len(rows)
    got = plain_distances(turned)
    assert {k: got[k] for k in want} == want
    a, b, far = rooting.farthest_leaves(tree)
    assert far == max(want.values()) == want[a, b]
    middle = [tuple(r) for r in rooting.midpoint_rooted(tree, 999).collect()]
    got = plain_distances(middle)
    assert {k: got[k] for k in want} == want and sum(x or 0 for *_, x in middle) == pytest.approx(sum(x or 0 for *_, x in rows))
    root = next(v for v, p, *_ in middle if p is None)
    deep = {r.node: r.depth for r in rooting.root_distances(spark.createDataFrame(middle, TREE)).collect()}
    assert deep[a] == deep[b] == far / 2 and deep[root] == 0
    assert {tuple(r) for r in rooting.reroot(tree, 0).collect()} == set(rows)


def test_tiling_equals_counting_bases(spark, monkeypatch):
    from strandlake.operators import tiling

    monkeypatch.setattr(tiling, "STRETCH", 16)
    rng = random.Random(9)
    rows = []
    for k in range(120):
        start = rng.randint(1, 150)
        end = start + rng.randint(0, 40)
        n = rng.randint(0, end - start + 1)
        rows.append((rng.choice("ab"), rng.choice([1, -1]), k, start, end, n, rng.randint(n, end - start + 1)))
    hits = spark.createDataFrame(rows + rows[:2], "sseqid string, strand int, id long, start long, end long, identities long, conserved long")
    rows += rows[:2]
    by = ["sseqid", "strand"]
    cover = {}
    for s, t, k, start, end, same, kept in rows:
        for x in range(start, end + 1):
            cover.setdefault((s, t, x), []).append((same / (end - start + 1), kept / (end - start + 1)))
    found = {(r.sseqid, r.strand): r for r in tiling.fractions(tiling.statistics(hits, by), F_lit(200)).collect()}
    for key, r in found.items():
        own = [v for (s, t, _), v in cover.items() if (s, t) == key]
        mean = [sum(sum(x[k] for x in v) / len(v) for v in own) for k in (0, 1)]
        assert r.length == len(own) and r.identities == pytest.approx(mean[0]) and r.conserved == pytest.approx(mean[1])
        assert r.frac_aligned == len(own) / 200 and r.frac_identical_aligned == pytest.approx(mean[0] / len(own))
    for r in tiling.components(hits, by).collect():
        assert all(len(cover[r.sseqid, r.strand, x]) == r.covering for x in range(r.start, r.end + 1))
    spans = {(r.sseqid, r.strand, r.start, r.end) for r in tiling.coverage_map(hits, by).collect()}
    assert sum(e - b + 1 for *_, b, e in spans) == len(cover)
    ends = {r[2]: r for r in rows}
    for key in found:
        kept = [r.id for r in tiling.first_tiling(hits, by).collect() if (r.sseqid, r.strand) == key]
        assert {x for k in kept for x in range(ends[k][3], ends[k][4] + 1)} == {x for s, t, x in cover if (s, t) == key}


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def compatible(a, b):
    both = [(x, y) for x, y in zip(a, b, strict=True) if x in "ACGT" and y in "ACGT"]
    return bool(both) and all(x == y for x, y in both)


def gapped_rows(rng, n=150):
    parents = {s: ["".join(rng.choice("ACGT") for _ in range(70)) for _ in range(3)] for s in "xy"}
    out = []
    for k in range(n):
        s = rng.choice("xy")
        seq = list(rng.choice(parents[s]))
        if rng.random() < 0.3:
            seq[rng.randrange(70)] = rng.choice("ACGT")
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            at = rng.randrange(70)
            seq[at : at + rng.choice([1, 3, 9])] = rng.choice(["-", "N"]) * len(seq[at : at + rng.choice([1, 3])])
        text = ("".join(seq) + "-" * 70)[:70]
        out.append((s, k, "-" * 40 + text[40:] if rng.random() < 0.1 else text))
    return out + [("x", n, "-" * 70), ("x", n + 1, "-" * 70), ("y", n + 2, "A" + "-" * 69)]


def test_compatible_pairs_by_blocks_and_least_ones(spark, monkeypatch):
    monkeypatch.setattr(haplotypes, "BLOCK", 16)
    monkeypatch.setattr(haplotypes, "SLAB", 5)
    rows = gapped_rows(random.Random(4), 220)
    texts = [(s, k, t) for k, (s, t) in enumerate(sorted({(s, t) for s, _, t in rows}))]
    frame = spark.createDataFrame(texts, "sample string, ord long, seq string")
    pairs = {(s, i, j) for (s, i, a), (t, j, b) in itertools.combinations(texts, 2) if s == t and compatible(a, b)}
    found = [tuple(r) for r in haplotypes.compatible_pairs(frame).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs
    # Of a row's pairs the least is enough, one or two for a row and a block.
    few = [tuple(r) for r in haplotypes.compatible_pairs(frame, least=True).collect()]
    least = lambda found: {(s, j): min(i for t, i, k in found if (t, k) == (s, j)) for s, _, j in found}
    assert set(few) <= pairs and least(few) == least(pairs)
    many = spark.createDataFrame([("s", k, "ACGT" * 3 + "-" * k + "A" * (60 - k)) for k in range(60)], "sample string, ord long, seq string")
    assert haplotypes.compatible_pairs(many).count() == 60 * 59 // 2
    assert haplotypes.compatible_pairs(many, least=True).count() <= 2 * 60 * 4


def test_collapse_derives_sequences_once(spark):
    # A derived sequence that a join asks for again would be made twice, and once more for its being no null.
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda k: made.add(1) or "ACGT" * 5 + "-" * (k % 4), "string")
    rows = spark.range(40).select(F.lit("s").alias("sample"), F.col("id").alias("ord"), seen("id").alias("seq"))
    assert haplotypes.collapsed(rows).count() == 40
    assert made.value == 40


def test_haplotypes_equal_loops(spark):
    from strandlake.operators import haplotypes

    rows = gapped_rows(random.Random(21))
    frame = spark.createDataFrame(rows, "sample string, ord long, seq string")
    texts = {(s, t): min(k for x, k, u in rows if (x, u) == (s, t)) for s, _, t in rows}
    pairs = {(s, *sorted((i, j))) for ((s, a), i), ((t, b), j) in itertools.combinations(texts.items(), 2) if s == t and compatible(a, b)}
    distinct = spark.createDataFrame([(s, k, t) for (s, t), k in texts.items()], "sample string, ord long, seq string")
    assert {tuple(r) for r in haplotypes.compatible_pairs(distinct).collect()} == pairs and len(pairs) > 40
    want = {k: min([t] + [u for x, u in texts if x == s and compatible(t, u)]) for s, k, t in rows}
    assert {r.ord: r.haplotype for r in haplotypes.collapsed(frame).collect()} == want
    made, loop = {}, {}
    for s, k, t in rows:
        own = made.setdefault(s, set())
        if t not in own:
            near = sorted(h for h in own if compatible(t, h))
            loop[k] = near[0] if near else t
            if not near:
                own.add(t)
        else:
            loop[k] = t
    assert {r.ord: r.haplotype for r in haplotypes.first_compatible(frame).collect()} == loop and loop != want
    assert haplotypes.first_compatible(frame.limit(0)).count() == 0


def test_purge_equals_a_loop(spark):
    from strandlake.operators import haplotypes

    rng = random.Random(22)
    parents = ["".join(rng.choice("ACGT") for _ in range(80)) for _ in range(4)]
    rows = []
    for k in range(90):
        seq = "".join(c if rng.random() > 0.08 else rng.choice("ACGT") for c in rng.choice(parents))
        rows.append((k, "-" * rng.choice([0, 0, 5]) + seq[5:] if k % 3 else seq))
    rows = [(k, t.ljust(80, "-")) for k, t in rows]
    kept = []
    for k, t in rows:
        def like(u, t=t):
            both = [(x, y) for x, y in zip(t, u, strict=True) if x != "-" and y != "-"]
            return sum(x == y for x, y in both) / len(both) if both else 0

        if all(like(u) <= 0.88 for _, u in kept):
            kept.append((k, t))
    found = haplotypes.purged(spark.createDataFrame(rows, "ord long, seq string"), 0.88)
    assert sorted(r.ord for r in found.collect()) == [k for k, _ in kept] and 4 < len(kept) < 80
    starts = haplotypes.by_start(spark.createDataFrame([(1, "--A-C"), (2, "ACG"), (3, "---")], "ord long, seq string"))
    assert [(r.ord, r.start, r.residues) for r in starts.collect()] == [(1, 3, 2), (2, 1, 3), (3, 4, 0)]
