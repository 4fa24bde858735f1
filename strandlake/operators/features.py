"""Features (seq_id, start, end, strand, type, name, and others): stored by tiers of bins, assembled from parts.

A feature lies in one bin, of the smallest tier (by tens, from ``LEAST``) that holds it
whole, however long it is. Two features that overlap have bins one of which holds the
other; so each is looked up in the bins of its own and all coarser tiers, of which
there are a few, and a pair comes up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, TIERS = 1_000, 8
#: Tier of features that no bin of the others holds: a bin per sequence.
TOP = TIERS


def _width(tier: int) -> int:
    return LEAST * 10**tier


def tier_of(start: Column, end: Column) -> Column:
    """How many tiers, from the finest on, have no bin that holds the range whole."""
    return sum(((F.floor(start / _width(t)) != F.floor(end / _width(t))).cast("int") for t in range(TIERS)), F.lit(0))


def bin_at(tier: Column, position: Column) -> Column:
    """The bin of a tier that a position lies in."""
    return F.when(tier < TOP, F.floor(position / (LEAST * F.pow(F.lit(10.0), tier)))).otherwise(0).cast("long")


def bin_bounds(tier: int, start: Column, end: Column) -> tuple[Column, Column]:
    """The first and the last bin of a tier that a range touches, as 'width.bin'."""
    name = lambda at: F.concat(F.lit(f"{_width(tier)}."), F.floor(F.abs(at) / _width(tier)).cast("string"))
    return name(start), name(end)


def stored(features: DataFrame) -> DataFrame:
    """Features with tier and bin, to be written by ``seq_id`` and tier or looked up."""
    tier = tier_of(F.col("start"), F.col("end"))
    return features.withColumn("tier", tier).withColumn("bin", bin_at(F.col("tier"), F.col("start")))


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of features of ``a`` and ``b`` (stored) that overlap: all columns, named a_* and b_*. Neither is copied more than ``TIERS`` + 1 times."""
    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*(F.col(c).alias(f"{name}_{c}") for c in rows.columns))

    def climbed(rows: DataFrame, name: str, least: int) -> DataFrame:
        up = F.filter(F.sequence(F.lit(0), F.lit(TOP)), lambda t: t >= F.col(f"{name}_tier") + least)
        spread = side(rows, name).withColumn("t", F.explode(up))
        return spread.withColumn("at", bin_at(F.col("t"), F.col(f"{name}_start")))

    meet = (F.col("a_seq_id") == F.col("b_seq_id")) & (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end"))
    higher = climbed(a, "a", 0).join(side(b, "b"), meet & (F.col("t") == F.col("b_tier")) & (F.col("at") == F.col("b_bin")))
    lower = climbed(b, "b", 1).join(side(a, "a"), meet & (F.col("t") == F.col("a_tier")) & (F.col("at") == F.col("a_bin")))
    return higher.drop("t", "at").unionByName(lower.drop("t", "at"))


def by_location(features: DataFrame, seq_id: str, start: int, end: int) -> DataFrame:
    """Stored features that overlap a range: of every tier the bins that it touches."""
    first, last = (bin_at(F.col("tier"), F.lit(x)) for x in (start, end))
    return features.filter((F.col("seq_id") == seq_id) & F.col("bin").between(first, last) & (F.col("start") <= end) & (F.col("end") >= start))


def by_type(features: DataFrame, types: list[str]) -> DataFrame:
    """Features of these types, whatever their case."""
    return features.filter(F.lower("type").isin([t.lower() for t in types]))


def by_name(features: DataFrame, name: str) -> DataFrame:
    """Features of that name, whatever its case; * stands for any letters."""
    parts = [f"\\Q{p}\\E" for p in name.lower().split("*")]
    return features.filter(F.lower("name").rlike("^" + ".*".join(parts) + "$"))


def by_attribute(features: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Features whose attributes (a map) have all these values."""
    out = features
    for key, value in wanted.items():
        out = out.filter(F.try_element_at("attributes", F.lit(key)) == value)
    return out


def types(features: DataFrame) -> DataFrame:
    """type, n."""
    return features.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def disaggregated(wanted: list[str], main: str, parts: list[str]) -> list[str]:
    """Types to look for where composites of type ``main`` are wanted: their parts and their main type in its place."""
    out = [t for t in wanted if t.lower() != main.lower()]
    return out + ([*parts, main] if len(out) < len(wanted) or not wanted else [])


def aggregated(features: DataFrame, main: str, parts: list[str], group: str = "name") -> DataFrame:
    """Composites of features of one group and sequence: seq_id, group, start, end, strand, type, parts.

    The composite is the group's feature of type ``main``, if there is one (the first),
    reaching as far as its parts; ``parts`` counts them. Groups with neither are left out, and
    features without a group.
    """
    kinds = [p.lower() for p in parts]
    is_main, is_part = F.lower("type") == main.lower(), F.lower("type").isin(kinds)
    rows = features.filter(F.col(group).isNotNull() & (is_main | is_part))
    own = F.min(F.when(is_main, F.struct("start", "end", "strand"))).alias("main")
    made = rows.groupBy("seq_id", group).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("strand").alias("low"), F.max("strand").alias("high"), own, F.count_if(is_part).alias("parts"))
    strand = F.coalesce("main.strand", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(0))
    return made.select("seq_id", group, "start", "end", strand.alias("strand"), F.lit(main).alias("type"), "parts")
