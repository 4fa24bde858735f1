"""Tiling of a subject, or a query, by the hits on it.

Hits are rows (``by`` columns, id, start, end, identities, conserved); ``by`` names
what is tiled, such as query, subject and strand. Every start and every place after an
end is a boundary; between two neighbouring ones lies a component, which the same hits
cover all along. Statistics of all components come from one sweep: what a hit adds per
base is added where it starts and taken away after its end, so that running sums
give, at every boundary, how many hits cover what follows and what they have per
base. Sums are decimals, so that they end at nothing.

A sequence is cut in stretches of ``STRETCH`` positions; a running sum goes over one
stretch and starts from the sum of those before, which is one row per stretch: a
subject that a third of all hits lie on is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 4096
EXACT = "decimal(38,18)"


def _stretch(at: Column) -> Column:
    return F.floor(at / STRETCH).cast("long")


def _per_base(value: str) -> Column:
    return (F.col(value) / (F.col("end") - F.col("start") + 1)).cast(EXACT)


def components(hits: DataFrame, by: list[str]) -> DataFrame:
    """``by``, start, end, covering (hits), identities, conserved (per base, summed over the covering hits)."""
    sums = ["covering", "identities", "conserved"]
    shares = {"covering": F.lit(1).cast(EXACT), "identities": _per_base("identities"), "conserved": _per_base("conserved")}
    at_start = F.struct(F.col("start").cast("long").alias("at"), *(shares[c].alias(c) for c in sums))
    after_end = F.struct((F.col("end") + 1).cast("long").alias("at"), *((-shares[c]).cast(EXACT).alias(c) for c in sums))
    steps = hits.select(*by, F.explode(F.array(at_start, after_end)).alias("s")).select(*by, "s.*")
    steps = steps.groupBy(*by, "at").agg(*(F.sum(c).cast(EXACT).alias(c) for c in sums)).withColumn("stretch", _stretch(F.col("at")))
    whole = steps.groupBy(*by, "stretch").agg(F.min("at").alias("first"), *(F.sum(c).cast(EXACT).alias(f"all_{c}") for c in sums))
    earlier = Window.partitionBy(*by).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = whole.select(*by, "stretch", F.lead("first").over(Window.partitionBy(*by).orderBy("stretch")).alias("next_first"), *(F.coalesce(F.sum(f"all_{c}").over(earlier), F.lit(0)).cast(EXACT).alias(f"to_{c}") for c in sums))
    inside = Window.partitionBy(*by, "stretch").orderBy("at")
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = steps.select(*by, "stretch", "at", F.lead("at").over(inside).alias("next"), *(F.sum(c).over(run).cast(EXACT).alias(c) for c in sums))
    placed = swept.join(base, [*by, "stretch"])
    made = placed.select(*by, F.col("at").alias("start"), (F.coalesce("next", "next_first") - 1).alias("end"), *((F.col(c) + F.col(f"to_{c}")).cast(EXACT).alias(c) for c in sums))
    return made.filter("covering > 0").withColumn("covering", F.col("covering").cast("long"))


def statistics(hits: DataFrame, by: list[str]) -> DataFrame:
    """``by``, length (of what is covered), identities, conserved, components.

    Each component counts the mean of its hits' shares of identities, a hit's spread
    evenly over its bases: the estimate for hits that come without their alignment.
    """
    size = F.col("end") - F.col("start") + 1
    # As doubles: a quotient of decimals of this length would be cut to six places.
    mean = lambda c: F.sum(size * F.col(c).cast("double") / F.col("covering"))
    return components(hits, by).groupBy(*by).agg(F.sum(size).alias("length"), mean("identities").alias("identities"), mean("conserved").alias("conserved"), F.count(F.lit(1)).alias("components"))


def fast_statistics(hits: DataFrame, by: list[str]) -> DataFrame:
    """``by``, length, identities, conserved: means over hits, weighted by their length; nothing is tiled."""
    size = F.col("end") - F.col("start") + 1
    mean = lambda v: F.sum(size * v) / F.sum(size)
    return hits.groupBy(*by).agg(mean(size).alias("length"), mean(F.col("identities")).alias("identities"), mean(F.col("conserved")).alias("conserved"))


def fractions(found: DataFrame, reported: Column | str) -> DataFrame:
    """Statistics with frac_identical and frac_conserved (of the reported length; ``_aligned``: of the covered one) and frac_aligned."""
    whole = F.col(reported) if isinstance(reported, str) else reported
    out = {f"frac_{to}{end}": F.col(of) / under for of, to in (("identities", "identical"), ("conserved", "conserved")) for end, under in (("", whole), ("_aligned", F.col("length")))}
    return found.withColumns(out | {"frac_aligned": F.col("length") / whole})


def coverage_map(hits: DataFrame, by: list[str]) -> DataFrame:
    """``by``, start, end, id: a row per component and hit that covers it.

    Both sides meet by stretch: a hit lies in all that it touches, a component in that
    of its start.
    """
    parts = components(hits, by).select(*by, F.col("start").alias("c_start"), F.col("end").alias("c_end"), _stretch(F.col("start")).alias("stretch"))
    spread = hits.select(*by, "id", "start", "end", F.explode(F.sequence(_stretch(F.col("start")), _stretch(F.col("end")))).alias("stretch"))
    both = parts.join(spread, [*by, "stretch"]).filter((F.col("start") <= F.col("c_start")) & (F.col("end") >= F.col("c_end")))
    return both.select(*by, F.col("c_start").alias("start"), F.col("c_end").alias("end"), "id")


def first_tiling(hits: DataFrame, by: list[str]) -> DataFrame:
    """``by``, id: hits that cover together what all do, the first by id of every component's."""
    return coverage_map(hits, by).groupBy(*by, "start", "end").agg(F.min("id").alias("id")).select(*by, "id").distinct()
