"""Population statistics that take an outgroup, and two sites at a time.

Alignments are in long form (by columns, id, pos, base). Genotypes are rows (by
columns, marker, individual, a, b) of two alleles each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators import popgen

BASES = ("A", "C", "G", "T")


def derived_mutations(ingroup: DataFrame, outgroup: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, external, internal: alleles of the ingroup that the outgroup lacks, seen once, and more often.

    Sites where the outgroup has several alleles, or the ingroup one, tell nothing.
    """
    keys = [*by, "pos"]
    own = ingroup.filter(F.col("base").isin(*BASES)).groupBy(*keys, "base").agg(F.count(F.lit(1)).alias("c"))
    kinds = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    other = outgroup.filter(F.col("base").isin(*BASES)).groupBy(*keys).agg(F.count_distinct("base").alias("out"), F.min("base").alias("state"))
    seen = own.join(kinds.filter("k > 1"), keys).join(other, keys, "left").filter("coalesce(out, 0) <= 1 AND NOT coalesce(base = state, false)")
    found = seen.groupBy(*by).agg(F.count_if(F.col("c") == 1).alias("external"), F.count_if(F.col("c") > 1).alias("internal"))
    if not by:
        return found
    return ingroup.select(*by).distinct().join(found, list(by), "left").fillna(0, ["external", "internal"])


def _constant(n: Column, a: Column) -> Column:
    return 2 * (n * a - 2 * (n - 1)) / ((n - 1) * (n - 2))


def fu_li_d(n: Column, s: Column, external: Column, a: Column, b: Column) -> Column:
    """Fu and Li's D from counts; ``a`` and ``b`` are the sums over i < n of 1 / i and 1 / i**2."""
    v = 1 + a * a / (b + a * a) * (_constant(n, a) - (n + 1) / (n - 1))
    u = a - 1 - v
    return F.when((n > 2) & (u * s + v * s * s > 0), (s - a * external) / F.sqrt(u * s + v * s * s))


def fu_li_f(n: Column, pi: Column, s: Column, external: Column, a: Column, b: Column) -> Column:
    """Fu and Li's F from counts."""
    v = (_constant(n, a) + 2 * (n * n + n + 3) / (9 * n * (n - 1)) - 2 / (n - 1)) / (a * a + b)
    u = (1 + (n + 1) / (3 * (n - 1)) - 4 * (n + 1) / ((n - 1) * (n - 1)) * (a + 1 / n - 2 * n / (n + 1))) / a - v
    return F.when((n > 2) & (u * s + v * s * s > 0), (pi - external) / F.sqrt(u * s + v * s * s))


def fu_li_f_star(n: Column, pi: Column, s: Column, singletons: Column, a: Column, b: Column) -> Column:
    """Fu and Li's F* from counts, with the constants of Simonsen and others; 0 for two samples."""
    v = ((2 * n * n * n + 110 * n * n - 255 * n + 153) / (9 * n * n * (n - 1)) + 2 * (n - 1) * a / (n * n) - 8 * b / n) / (a * a + b)
    u = (4 * n * n + 19 * n + 3 - 12 * (n + 1) * (a + 1 / n)) / (3 * n * (n - 1)) / a - v
    value = F.when(u * s + v * s * s > 0, (pi - singletons * (n - 1) / n) / F.sqrt(u * s + v * s * s))
    return F.when(n == 2, 0.0).when(n > 2, value)


def neutrality(ingroup: DataFrame, outgroup: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, n, pi, segregating, singletons, external, internal, d, f (with the outgroup), d_star, f_star (without)."""
    counts, mutations = popgen.diversity(ingroup, by), derived_mutations(ingroup, outgroup, by)
    both = counts.join(mutations, list(by)) if by else counts.crossJoin(mutations)
    n, s, pi, one, ext = (F.col(c).cast("double") for c in ("n", "segregating", "pi", "singletons", "external"))
    both = both.withColumns({"__a": popgen.harmonic(F.col("n")), "__b": popgen.harmonic(F.col("n"), 2)})
    a, b = F.col("__a"), F.col("__b")
    d_star = F.when((n > 2) & (s > 0), popgen.fu_li_d_star(n, s, one, a, b))
    return both.withColumns({"d": fu_li_d(n, s, ext, a, b), "f": fu_li_f(n, pi, s, ext, a, b), "d_star": d_star, "f_star": fu_li_f_star(n, pi, s, one, a, b)}).select(*by, "n", "pi", "segregating", "singletons", "external", "internal", "d", "f", "d_star", "f_star")


def composite_ld(genotypes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, marker1 < marker2, n, delta, chi_square: composite disequilibrium of unphased genotypes.

    Markers with two alleles of one letter each count; the first letter's number in a
    genotype is 2, 1 or 0. A marker is held as bit planes, 64 individuals a number, one
    for each kind of genotype, so that a pair of markers is compared by counts of bits, 64
    individuals at a time. Individuals that lack either genotype don't count; pairs
    without any variance are left out. As many rows as pairs of such markers, by definition.
    """
    whole = genotypes.filter("a IS NOT NULL AND b IS NOT NULL")
    kinds = whole.select(*by, "marker", "a", "b").distinct()  # few, so alleles are told from these
    alleles = kinds.select(*by, "marker", F.explode(F.array("a", "b")).alias("allele")).groupBy(*by, "marker").agg(F.min("allele").alias("first"), F.max("allele").alias("last"), F.count_distinct("allele").alias("k"))
    two = alleles.filter("k = 2 AND length(first) = 1 AND length(last) = 1").select(*by, "marker", "first")
    dose = (F.col("a") == F.col("first")).cast("int") + (F.col("b") == F.col("first")).cast("int")
    # An individual's bit: its number within a word, which about 48 individuals share by hash.
    people = whole.select(*by, "individual").distinct()
    words = people.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / 48)).alias("words")) if by else people.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / 48)).alias("words"))
    sized = people.join(words, list(by)) if by else people.crossJoin(F.broadcast(words))
    hashed = sized.select(*by, "individual", F.pmod(F.xxhash64("individual"), F.col("words")).alias("h"))
    own = hashed.withColumn("k", F.row_number().over(Window.partitionBy(*by, "h").orderBy("individual")) - 1)
    placed = own.select(*by, "individual", F.struct("h", F.floor(F.col("k") / 64).alias("more")).alias("word"), (F.col("k") % 64).cast("int").alias("at"))
    mask = F.col("bits")
    plane = lambda k: F.bit_or(F.when(F.col("dose") == k, mask).otherwise(F.lit(0).cast("long")))
    # Bits are gathered by pair of alleles first, so that only words meet the markers' first letters.
    known = whole.join(placed, [*by, "individual"]).groupBy(*by, "marker", "word", "a", "b").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))
    planes = known.join(two, [*by, "marker"]).withColumn("dose", dose).groupBy(*by, "marker", "word").agg(plane(2).alias("hom"), plane(1).alias("het"), F.bit_or(mask).alias("known"))
    side = lambda k: planes.select(*by, "word", *(F.col(c).alias(f"{c}{k}") for c in ("marker", "hom", "het", "known")))
    pairs = side(1).join(side(2), [*by, "word"]).filter("marker1 < marker2")
    both = lambda x, y: F.sum(F.bit_count(F.col(x).bitwiseAND(F.col(y)))).cast("double")
    counts = {"n": ("known1", "known2"), "n1": ("hom1", "hom2"), "n2": ("hom1", "het2"), "n4": ("het1", "hom2"), "n5": ("het1", "het2"), "hom_a": ("hom1", "known2"), "het_a": ("het1", "known2"), "hom_b": ("known1", "hom2"), "het_b": ("known1", "het2")}
    c = pairs.groupBy(*by, "marker1", "marker2").agg(*(both(*xy).alias(name) for name, xy in counts.items())).filter("n > 0")
    n = F.col("n")
    p = lambda x: (2 * F.col(f"hom_{x}") + F.col(f"het_{x}")) / (2 * n)
    spread = lambda x: p(x) * (1 - p(x)) + F.col(f"hom_{x}") / n - p(x) * p(x)
    delta = (2 * F.col("n1") + F.col("n2") + F.col("n4") + F.col("n5") / 2) / n - 2 * p("a") * p("b")
    made = c.select(*by, "marker1", "marker2", n.cast("long").alias("n"), delta.alias("delta"), (spread("a") * spread("b")).alias("v"))
    return made.filter("v > 1e-12").select(*by, "marker1", "marker2", "n", "delta", (F.col("n") * F.col("delta") * F.col("delta") / F.col("v")).alias("chi_square"))
