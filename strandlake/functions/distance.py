"""Pairwise distances of aligned sequences, as expressions on two columns.

A position counts when both letters are A, C, G or T (case matters), or when the
letters are equal and not gaps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.seqfn import characters

SATURATED = 2.0


def _count(seq1: Column, seq2: Column, test) -> Column:
    return F.size(F.filter(F.zip_with(characters(seq1), characters(seq2), test), lambda x: x)).cast("long")


def _acgt(x: Column) -> Column:
    return x.isin("A", "C", "G", "T")


def planes(seq: Column) -> Column:
    """The sequence as bit planes, an array with one struct of longs for every 64 positions.

    ``v`` marks A, C, G and T; ``x`` parts purines from pyrimidines, ``y`` the two of
    either kind. To be made once per sequence, before pairs are.
    """
    bits = lambda text, ones: F.conv(F.rpad(F.translate(text, "ACGT.", ones), 64, "0"), 2, -10).cast("long")
    # The blocks come from one walk over the text: cutting each off by its place would take the square of the length.
    blocks = F.regexp_extract_all(F.regexp_replace(seq, "[^ACGT]", "."), F.lit(".{1,64}"), F.lit(0))
    return F.transform(blocks, lambda s: F.struct(bits(s, "11110").alias("v"), bits(s, "01010").alias("x"), bits(s, "00110").alias("y")))


def letter_words(seq: Column, letter: str) -> Column:
    """Where a letter stands, 64 positions a number; to be made once per sequence."""
    blocks = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(seq, f"[^{letter}]", "."), f"[{letter}]", "1"), F.lit(".{1,64}"), F.lit(0))
    return F.transform(blocks, lambda s: F.conv(F.rpad(F.translate(s, ".", "0"), 64, "0"), 2, -10).cast("long"))


def words_in(words1: Column, words2: Column, either: bool = False) -> Column:
    """Positions that both have, or ``either`` has."""
    word = lambda w: F.coalesce(w, F.lit(0).cast("long"))
    join = lambda a, b: F.bit_count(word(a).bitwiseOR(word(b)) if either else word(a).bitwiseAND(word(b))).cast("long")
    return F.aggregate(F.zip_with(words1, words2, join), F.lit(0).cast("long"), lambda s, n: s + n)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plane_counts(planes1: Column, planes2: Column) -> Column:
    """Struct of bases compared, transitions, transversions: three population counts for 64 positions."""
    both = F.slice(F.arrays_zip(planes1.alias("a"), planes2.alias("b")), 1, F.least(F.size(planes1), F.size(planes2)))

    def block(s: Column, pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        valid, odd = a["v"].bitwiseAND(b["v"]), a["x"].bitwiseXOR(b["x"])
        add = lambda name, bits: (s[name] + F.bit_count(bits)).alias(name)
        same_kind = a["y"].bitwiseXOR(b["y"]).bitwiseAND(F.bitwise_not(odd)).bitwiseAND(valid)
        return F.struct(add("n", valid), add("ts", same_kind), add("tv", odd.bitwiseAND(valid)))

    none = F.struct(*(F.lit(0).cast("long").alias(k) for k in ("n", "ts", "tv")))
    return F.aggregate(both, none, block)


def words_of(length: int) -> int:
    """Words that the planes of so many positions have."""
    return (length + 63) // 64


def flat_planes(made: Column, words: int) -> list[Column]:
    """``planes`` of at most so many words as columns v0_, x0_, y0_, v1_ ...: plain numbers, which pairs compare in compiled code."""
    return [F.coalesce(F.get(made, F.lit(w))[c], F.lit(0).cast("long")).alias(f"{c}{w}_") for w in range(words) for c in ("v", "x", "y")]


def flat_counts(words: int) -> dict[str, Column]:
    """As ``plane_counts``, of pairs with the columns of ``flat_planes`` for 1 and 2."""
    add = lambda bits: sum((F.bit_count(bits(w)).cast("long") for w in range(1, words)), F.bit_count(bits(0)).cast("long"))
    both = lambda c, w: (F.col(f"{c}{w}_1"), F.col(f"{c}{w}_2"))
    valid = lambda w: both("v", w)[0].bitwiseAND(both("v", w)[1])
    apart = lambda c, w: both(c, w)[0].bitwiseXOR(both(c, w)[1])
    return {"n": add(valid), "ts": add(lambda w: apart("y", w).bitwiseAND(F.bitwise_not(apart("x", w))).bitwiseAND(valid(w))), "tv": add(lambda w: apart("x", w).bitwiseAND(valid(w)))}


def rounded(value: Column, digits: int) -> Column:
    """A distance (0 or more, and below a million) to so many digits, half up; ``round`` makes a decimal of every value."""
    return F.floor(value * 10.0**digits + 0.5) / 10.0**digits


def counts(seq1: Column, seq2: Column) -> Column:
    """Struct of bases compared, transitions, transversions of two sequences."""
    return plane_counts(planes(seq1), planes(seq2))


def measured(planes1: Column, planes2: Column) -> Column:
    """Struct of n, ts, tv and k2p, each computed once however often it is read."""
    return _let(plane_counts(planes1, planes2), lambda c: F.struct(c["n"].alias("n"), c["ts"].alias("ts"), c["tv"].alias("tv"), k2p(c["n"], c["ts"], c["tv"]).alias("k2p")))


def k2p(n: Column, ts: Column, tv: Column, empty: float = SATURATED, saturated: float = SATURATED) -> Column:
    """Kimura's two-parameter distance."""
    p, q = ts / n, tv / n
    w1, w2 = 1 - 2 * p - q, 1 - 2 * q
    return F.when(n <= 0, F.lit(empty)).when((w1 <= 0) | (w2 <= 0), F.lit(saturated)).otherwise(-F.log(w1) / 2 - F.log(w2) / 4)


def k2p_variance(n: Column, ts: Column, tv: Column) -> Column:
    p, q = ts / n, tv / n
    c1, c2 = 1 / (1 - 2 * p - q), 1 / (1 - 2 * q)
    c3 = (c1 + c2) / 2
    return F.when((n > 0) & (1 - 2 * p - q > 0) & (1 - 2 * q > 0), (c1 * c1 * p + c3 * c3 * q - (c1 * p + c3 * q) ** 2) / n)


def p_distance(n: Column, differences: Column) -> Column:
    return F.when(n > 0, differences / n)


def jukes_cantor(n: Column, differences: Column, b: float = 0.75) -> Column:
    """-1 where saturated. ``b`` is 3/4, or 1 less the sum of squared base frequencies."""
    d = 1 - (differences / n) / b
    return F.when((n <= 0) | (d <= 0), F.lit(-1.0)).otherwise(-b * F.log(d))


def tamura(n: Column, ts: Column, tv: Column, gc1: Column, gc2: Column) -> Column:
    p, q = ts / n, tv / n
    h = gc1 + gc2 - 2 * gc1 * gc2
    w1, w2 = 1 - p / h - q, 1 - 2 * q
    return F.when((n <= 0) | (h <= 0) | (w1 <= 0) | (w2 <= 0), F.lit(-1.0)).otherwise(-h * F.log(w1) - (1 - h) * F.log(w2) / 2)


def protein_kimura(compared: Column, matches: Column) -> Column:
    d = 1 - matches / compared
    return F.when((compared > 0) & (d < 0.8541), -F.log(1 - d - 0.2 * d * d))


def comparable(seq1: Column, seq2: Column) -> Column:
    return _count(seq1, seq2, lambda a, b: F.coalesce(_acgt(a) & _acgt(b), F.lit(False)))


def differences(seq1: Column, seq2: Column) -> Column:
    return _count(seq1, seq2, lambda a, b: F.coalesce(_acgt(a) & _acgt(b) & (a != b), F.lit(False)))


def gaps(seq1: Column, seq2: Column) -> Column:
    return _count(seq1, seq2, lambda a, b: F.coalesce((a == "-") | (b == "-"), F.lit(False)))


def bounds(length: int, cutoff: float) -> tuple[int, int]:
    """Most transitions and most transversions with which a pair of ``length`` bases can be within the cutoff."""
    def most(kind: str) -> int:
        k = 0
        while k < length:
            ts, tv = (k + 1, 0) if kind == "ts" else (0, k + 1)
            w1, w2 = 1 - (2 * ts + tv) / length, 1 - 2 * tv / length
            if w1 <= 0 or w2 <= 0 or -math.log(w1) / 2 - math.log(w2) / 4 > cutoff:
                break
            k += 1
        return k

    return most("ts"), most("tv")


def _equals(text: str):
    return lambda p: p == text


def tajima_nei(seq1: Column, seq2: Column) -> Column:
    """Tajima and Nei's distance, from all sixteen counts of base pairs; null where it can't be told."""
    bases = "ACGT"
    both = F.zip_with(F.split(F.upper(seq1), ""), F.split(F.upper(seq2), ""), lambda x, y: F.concat(x, y))
    solid = F.filter(both, lambda p: p.rlike("^[ACGT]{2}$"))

    return _let(solid, lambda pairs: tajima_nei_of_counts({x + y: F.size(F.filter(pairs, _equals(x + y))) for x in bases for y in bases}))


def tajima_nei_of_counts(times: dict[str, Column]) -> Column:
    """Tajima and Nei's distance of the sixteen counts of base pairs ('AA', 'AC', ...)."""
    bases = "ACGT"

    def value(c: Column) -> Column:
        n, share, apart = c["n"], {x: c[f"share{x}"] for x in bases}, c["apart"]
        h = F.lit(0.0)
        for k, x in enumerate(bases):
            for y in bases[k + 1 :]:
                f = c[x + y] / n
                h = h + F.when(f > 0, f * f / 2 / (share[x] * share[y])).otherwise(0.0)
        same = sum((share[x] * share[x] for x in bases), F.lit(0.0))
        return _let(F.struct(n.alias("n"), apart.alias("apart"), h.alias("h"), same.alias("same")), last)

    def last(c: Column) -> Column:
        n, apart, h = c["n"], c["apart"], c["h"]
        b = (1 - c["same"] + F.try_divide(apart * apart, h)) / 2
        return F.when((n > 0) & (apart == 0), 0.0).when((n > 0) & (h > 0) & (1 - apart / b > 0), -b * F.ln(1 - apart / b))

    def shared(c: Column) -> Column:
        n = c["n"]
        shares = [(sum((c[x + y] + c[y + x] for y in bases), F.lit(0)) / (2 * n)).alias(f"share{x}") for x in bases]
        both = [(c[x + y] + c[y + x]).alias(x + y) for k, x in enumerate(bases) for y in bases[k + 1 :]]
        apart = (1 - sum((c[x + x] for x in bases), F.lit(0)) / n).alias("apart")
        return F.when(n > 0, _let(F.struct(n.alias("n"), *shares, *both, apart), value))

    # Each step's values are computed once, however often the next one reads them.
    counted = F.struct(*(v.alias(k) for k, v in times.items()))
    return _let(counted, lambda c: _let(F.struct(sum((c[k] for k in times), F.lit(0)).alias("n"), *(c[k].alias(k) for k in times)), shared))
