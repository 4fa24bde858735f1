"""Population statistics on long genotypes or alignment columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def site_counts(columns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per site: samples n, alleles k, singletons, and pi = 1 - sum c(c-1) / (n(n-1))."""
    keys = [*by, "pos"]
    n = columns.filter(F.col("base").isin("A", "C", "G", "T")).groupBy(*keys, "base").agg(F.count(F.lit(1)).alias("c"))
    total, same = F.sum("c"), F.sum(F.col("c") * (F.col("c") - 1))
    return n.groupBy(*keys).agg(total.alias("n"), F.count(F.lit(1)).alias("k"), F.count_if(F.col("c") == 1).alias("singletons"), F.when(total > 1, 1 - same / (total * (total - 1))).otherwise(0.0).alias("pi"))


def harmonic(n: Column, power: int = 1) -> Column:
    """Sum over i < n of 1 / i**power."""
    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1).cast("long"), n.cast("long") - 1), F.lit(0.0), lambda s, i: s + 1 / F.pow(i, F.lit(power)))).otherwise(0.0)


def diversity(columns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """pi, segregating sites, singletons, Watterson's theta and Tajima's D per group."""
    per = site_counts(columns, by).groupBy(*by).agg(F.max("n").alias("n"), F.sum("pi").alias("pi"), F.count_if(F.col("k") > 1).alias("segregating"), F.sum(F.when(F.col("k") > 1, F.col("singletons")).otherwise(0)).alias("singletons"))
    a1, a2 = harmonic(F.col("n")), harmonic(F.col("n"), 2)
    per = per.withColumn("a1", a1).withColumn("a2", a2).withColumn("theta", F.when(F.col("a1") > 0, F.col("segregating") / F.col("a1")))
    return per.withColumn("tajima_d", tajima_d(F.col("n"), F.col("segregating"), F.col("pi"), F.col("a1"), F.col("a2"))).drop("a1", "a2")


def tajima_d(n: Column, s: Column, pi: Column, a1: Column, a2: Column) -> Column:
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    c1 = b1 - 1 / a1
    c2 = b2 - (n + 2) / (a1 * n) + a2 / (a1 * a1)
    e1, e2 = c1 / a1, c2 / (a1 * a1 + a2)
    variance = e1 * s + e2 * s * (s - 1)
    return F.when((n > 1) & (s > 0) & (variance > 0), (pi - s / a1) / F.sqrt(variance))


def fu_li_d_star(n: Column, s: Column, singletons: Column, a1: Column, a2: Column) -> Column:
    """Fu and Li's D* from counts."""
    a_next = a1 + 1 / n
    c = F.when(n == 2, F.lit(1.0)).otherwise(2 * (n * a1 - 2 * (n - 1)) / ((n - 1) * (n - 2)))
    d = c + (n - 2) / ((n - 1) * (n - 1)) + 2 / (n - 1) * (F.lit(1.5) - (2 * a_next - 3) / (n - 2) - 1 / n)
    m = n / (n - 1)
    v = (m * m * a2 + a1 * a1 * d - 2 * n * a1 * (a1 + 1) / ((n - 1) * (n - 1))) / (a1 * a1 + a2)
    u = m * (a1 - m) - v
    return (m * s - a1 * singletons) / F.sqrt(u * s + v * s * s)


def heterozygosity(frequency1: Column, frequency2: Column, samples: Column) -> Column:
    return samples / (samples - 1) * (1 - (frequency1 * frequency1 + frequency2 * frequency2))


def fst(alleles: DataFrame) -> DataFrame:
    """Between-population share of haploid allele variance: (population, marker, allele) rows.

    Weir and Cockerham's ratio of sums over markers and alleles, for haploids.
    """
    n = alleles.groupBy("marker", "population").agg(F.count(F.lit(1)).alias("n"))
    seen = alleles.groupBy("marker", "population", "allele").agg(F.count(F.lit(1)).alias("c"))
    kinds = alleles.select("marker", "allele").distinct()
    grid = n.join(kinds, "marker").join(seen, ["marker", "population", "allele"], "left").withColumn("p", F.coalesce("c", F.lit(0)) / F.col("n"))
    r, total = F.count(F.lit(1)), F.sum("n")
    per = grid.groupBy("marker", "allele").agg(r.alias("r"), total.alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"), (F.sum(F.col("n") * F.col("p")) / total).alias("mean"), F.sum(F.col("n") * F.col("p") * F.col("p")).alias("np2"), F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))).alias("within"))
    per = per.filter("r > 1 AND total > r")
    msp = (F.col("np2") - F.col("total") * F.col("mean") * F.col("mean")) / (F.col("r") - 1)
    msg = F.col("within") / (F.col("total") - F.col("r"))
    nc = (F.col("total") - F.col("squares") / F.col("total")) / (F.col("r") - 1)
    return per.agg((F.sum(msp - msg) / F.sum(msp + (nc - 1) * msg)).alias("fst"))


def haplotype_counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy("seq", *by).agg(F.count(F.lit(1)).alias("n"))
