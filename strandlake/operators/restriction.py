"""Restriction digests: an enzyme is (name, site, cut), ``cut`` the bases of the site before the cut.

A site may hold IUPAC codes. A site that differs from its own reverse complement is
also searched for as that, which is where it lies on the other strand. A fourth
value is the place of the other strand's cut, counted like ``cut``; without it the
two lie as far from either end of the site.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import seqfn

Enzymes = list[tuple]


def reversed_site(site: str) -> str:
    return site.upper().translate(str.maketrans(*seqfn.COMPLEMENT))[::-1]


def pattern(site: str) -> str:
    """A regular expression of the sequences that a site stands for."""
    bases = {code: made for made, code in seqfn.IUPAC.items()}
    return "".join(f"[{bases[c]}]" if len(bases[c]) > 1 else c for c in site.upper())


def searched(table: Enzymes, both_strands: bool = True) -> list[tuple[str, str, int]]:
    """(enzyme, site, cut) of every site to look for, the other strand's included."""
    out = []
    for enzyme, site, cut, *other in table:
        site = site.upper()
        out.append((enzyme, site, cut))
        if both_strands and reversed_site(site) != site:
            out.append((enzyme, reversed_site(site), len(site) - other[0] if other else cut))
    return out


def _text_matches(regexp: str) -> Callable[[Column], Column]:
    return lambda w: w["text"].rlike(regexp)


def enzymes(spark, table: Enzymes) -> DataFrame:
    return spark.createDataFrame([e[:3] for e in table], "enzyme string, site string, cut int")


def cut_positions(rows: DataFrame, table: Enzymes, both_strands: bool = True) -> DataFrame:
    """id, enzyme, position: the last base before each cut, either case of letters.

    Sites of one length are found in one walk; what matches none of them is dropped before rows are made.
    """
    out = None
    sites = searched(table, both_strands)
    for size in sorted({len(site) for _, site, _ in sites}):
        own = [(enzyme, f"^{pattern(site)}$", cut) for enzyme, site, cut in sites if len(site) == size]
        any_of = "|".join(sorted({p for _, p, _ in own}))
        places = F.filter(seqfn.windows(F.upper("seq"), size, 1), _text_matches(any_of))
        which: list[Column] = [F.when(F.col("w.text").rlike(p), F.struct(F.lit(enzyme).alias("enzyme"), F.lit(cut).alias("cut"))) for enzyme, p, cut in own]
        found = rows.select("id", F.explode(places).alias("w")).select("id", "w.start", F.explode(F.array_compact(F.array(*which))).alias("e"))
        found = found.select("id", "e.enzyme", (F.col("start") + F.col("e.cut") - 1).cast("long").alias("position"))
        out = found if out is None else out.unionByName(found)
    return out.distinct() if both_strands else out


def cuts_by_enzyme(rows: DataFrame, table: Enzymes, both_strands: bool = True) -> DataFrame:
    """id, enzyme, cuts of every sequence and enzyme, 0 where it has no site."""
    counted = cut_positions(rows, table, both_strands).groupBy("id", "enzyme").agg(F.count(F.lit(1)).alias("n"))
    grid = rows.select("id").crossJoin(F.broadcast(enzymes(rows.sparkSession, table).select("enzyme")))
    return grid.join(counted, ["id", "enzyme"], "left").select("id", "enzyme", F.coalesce("n", F.lit(0)).cast("long").alias("cuts"))


def cutters(counts: DataFrame) -> DataFrame:
    """Per sequence: enzymes that cut, that cut once, that never do, and the most cuts of one."""
    one = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("enzyme"))))
    return counts.groupBy("id").agg(one(F.col("cuts") > 0).alias("cutters"), one(F.col("cuts") == 1).alias("unique_cutters"), one(F.col("cuts") == 0).alias("zero_cutters"), F.max("cuts").alias("max_cuts"))


def fragments(rows: DataFrame, table: Enzymes, both_strands: bool = True) -> DataFrame:
    """id, start, end, size of the pieces that all enzymes together leave."""
    cuts = cut_positions(rows, table, both_strands).select("id", "position").distinct().unionByName(rows.select("id", F.length("seq").cast("long").alias("position"))).distinct()
    before = F.lag("position", 1, 0).over(Window.partitionBy("id").orderBy("position"))
    return cuts.select("id", (before + 1).alias("start"), F.col("position").alias("end")).filter("start <= end").withColumn("size", F.col("end") - F.col("start") + 1)
