"""Ranges (seq_id, start, end; 1-based, closed): bins, joins, merging, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1000


def bin_of(start: Column, end: Column, least: int = 1000, most: int = 100_000_000) -> Column:
    """The smallest tier, by tens, whose bin holds the range whole: 'tier.bin'."""
    found, tier = None, least
    while tier <= most:
        fits = F.floor(start / tier) == F.floor(end / tier)
        name = F.concat(F.lit(f"{tier}."), F.floor(start / tier).cast("string"))
        found = F.when(fits, name) if found is None else found.when(fits, name)
        tier *= 10
    return found.otherwise(F.lit(f"{most}.0"))


def overlap(a: DataFrame, b: DataFrame, width: int = BIN, strand: str = "ignore") -> DataFrame:
    """Pairs of overlapping ranges: (a_*, b_*, start, end of the intersection).

    Both sides are put into every bin they touch and joined on it; a pair is
    kept in the bin where its intersection starts. Strands: ``ignore``, ``weak``
    (0 goes with any) or ``strong``.
    """
    def binned(side: DataFrame, name: str) -> DataFrame:
        side = side.select(*(F.col(c).alias(f"{name}_{c}") for c in side.columns))
        return side.withColumn(f"{name}_bin", F.explode(F.sequence(F.floor(F.col(f"{name}_start") / width), F.floor(F.col(f"{name}_end") / width))))

    same = (F.col("a_seq_id") == F.col("b_seq_id")) & (F.col("a_bin") == F.col("b_bin")) & (F.col("a_start") <= F.col("b_end")) & (F.col("a_end") >= F.col("b_start"))
    if strand != "ignore":
        equal = F.col("a_strand") == F.col("b_strand")
        same &= equal if strand == "strong" else equal | (F.col("a_strand") == 0) | (F.col("b_strand") == 0)
    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    pairs = binned(a, "a").join(binned(b, "b"), same).filter(F.floor(start / width) == F.col("a_bin"))
    return pairs.withColumn("start", start).withColumn("end", end).drop("a_bin", "b_bin")


def contains(pairs: DataFrame) -> DataFrame:
    return pairs.filter("b_start >= a_start AND b_end <= a_end")


def overlap_extent(pairs: DataFrame) -> DataFrame:
    """Bases of a only, of both, of b only."""
    both = F.col("end") - F.col("start") + 1
    return pairs.withColumn("a_only", F.col("a_end") - F.col("a_start") + 1 - both).withColumn("both", both).withColumn("b_only", F.col("b_end") - F.col("b_start") + 1 - both)


def merged(rows: DataFrame) -> DataFrame:
    """Ranges joined where they overlap or touch: seq_id, start, end, parts."""
    order = Window.partitionBy("seq_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("seq_id", "start", "end", (F.col("start") > F.coalesce(reach, F.lit(-2)) + 1).cast("int").alias("new"))
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("island", island).groupBy("seq_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("parts")).drop("island")


def coverage(rows: DataFrame) -> DataFrame:
    """Depth between the points where it changes: seq_id, start, end, depth (0 left out)."""
    steps = rows.select("seq_id", F.col("start").alias("at"), F.lit(1).alias("d")).union(rows.select("seq_id", F.col("end") + 1, F.lit(-1)))
    steps = steps.groupBy("seq_id", "at").agg(F.sum("d").alias("d")).filter("d <> 0")
    order = Window.partitionBy("seq_id").orderBy("at")
    depth = F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return steps.select("seq_id", F.col("at").alias("start"), (F.lead("at").over(order) - 1).alias("end"), depth.alias("depth")).filter("depth > 0")


def gaps(rows: DataFrame) -> DataFrame:
    """What lies between the merged ranges of each sequence."""
    order = Window.partitionBy("seq_id").orderBy("start")
    return merged(rows).select("seq_id", (F.col("end") + 1).alias("start"), (F.lead("start").over(order) - 1).alias("end")).filter("end IS NOT NULL")


def subtract(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Parts of ``rows`` (id, seq_id, start, end) that no range of ``other`` covers."""
    holes = overlap(rows, merged(other)).select(F.col("a_id").alias("id"), "start", "end")
    base = rows.select("id", "seq_id", F.col("start").alias("lo"), F.col("end").alias("hi"))
    cuts = base.join(holes, "id", "left").groupBy("id", "seq_id", "lo", "hi").agg(F.sort_array(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "end")))).alias("h"))
    starts = F.concat(F.array(F.col("lo")), F.transform("h", lambda x: x["end"] + 1))
    ends = F.concat(F.transform("h", lambda x: x["start"] - 1), F.array(F.col("hi")))
    return cuts.select("id", "seq_id", F.explode(F.arrays_zip(starts.alias("start"), ends.alias("end"))).alias("r")).select("id", "seq_id", "r.start", "r.end").filter("start <= end")


def map_coordinates(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Carries ranges over a table of pairs (seq_id, start, end, to_id, to_start, strand); unmapped parts are dropped."""
    found = overlap(rows, pairs)
    shift = F.when(F.col("b_strand") < 0, F.col("b_to_start") + F.col("b_end") - F.col("end")).otherwise(F.col("b_to_start") + F.col("start") - F.col("b_start"))
    return found.select(F.col("a_id").alias("id"), F.col("b_to_id").alias("seq_id"), shift.alias("start"), (shift + F.col("end") - F.col("start")).alias("end"), F.col("b_strand").alias("strand"))


def clear_ranges(qualities: DataFrame, least: int) -> DataFrame:
    """Runs of positions (id, pos, quality) with at least the quality: id, start, end."""
    good = qualities.filter(F.col("quality") >= least)
    run = F.col("pos") - F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return good.withColumn("run", run).groupBy("id", "run").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).drop("run")


def fragments(rows: DataFrame, site: str, offset: int = 0) -> DataFrame:
    """Pieces of each sequence (id, seq) cut ``offset`` bases into every occurrence of a plain site."""
    n = F.length("seq")
    at = F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.substring("seq", i, F.lit(len(site))) == site, i + offset)), lambda x: x.isNotNull() & (x > 1) & (x <= n))
    starts, ends = F.concat(F.array(F.lit(1)), at), F.concat(F.transform(at, lambda x: x - 1), F.array(n))
    cut = rows.select("id", "seq", F.posexplode(F.arrays_zip(starts.alias("start"), ends.alias("end"))).alias("part", "r"))
    return cut.select("id", "part", "r.start", "r.end", F.substring("seq", F.col("r.start"), F.col("r.end") - F.col("r.start") + 1).alias("text"))
