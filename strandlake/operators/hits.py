"""Similarity hits: filters with reasons, ranks, unique queries, tiling, genome slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators import ranges


def judged(hits: DataFrame, query_length, identity: float = 80.0, fraction: float = 0.6) -> DataFrame:
    """Hits with ``aligned`` (length over query length), ``passed`` and the reason if not."""
    aligned = F.col("length") / query_length
    reason = F.when(F.col("pident") < identity, "identity").when(aligned < fraction, "length")
    return hits.withColumn("aligned", aligned).withColumn("reason", reason).withColumn("passed", reason.isNull())


def ranked(hits: DataFrame) -> DataFrame:
    """Rank of each hit of a query: by bit score, then subject, identity and start."""
    order = Window.partitionBy("qseqid").orderBy(F.col("bitscore").desc(), "sseqid", F.col("pident").desc(), "sstart")
    return hits.withColumn("rank", F.row_number().over(order))


def best(hits: DataFrame) -> DataFrame:
    key = F.struct(F.col("bitscore"), F.col("pident"))
    return hits.groupBy("qseqid").agg(F.max(F.struct(key.alias("k"), F.col("sseqid"))).alias("b")).select("qseqid", F.col("b.sseqid").alias("sseqid"), F.col("b.k.bitscore").alias("bitscore"))


def unique_queries(hits: DataFrame) -> DataFrame:
    """Queries with exactly one hit."""
    return hits.groupBy("qseqid").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("qseqid")


def hit_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("qseqid").agg(F.count(F.lit(1)).alias("n"))


def genome_interval(hits: DataFrame, query_length, genome_length) -> DataFrame:
    """start, end and strand on the genome: flipped where reversed, extended by the query's missing ends, clamped."""
    back = F.col("sstart") > F.col("send")
    left, right = F.col("qstart") - 1, query_length - F.col("qend")
    low, high = F.least("sstart", "send"), F.greatest("sstart", "send")
    start = F.greatest(F.lit(1), low - F.when(back, right).otherwise(left))
    end = F.least(genome_length, high + F.when(back, left).otherwise(right))
    return hits.withColumn("start", start.cast("long")).withColumn("end", end.cast("long")).withColumn("strand", F.when(back, -1).otherwise(1))


def tiled(hits: DataFrame) -> DataFrame:
    """Per query and subject: bases of the subject that hits cover, once each, and the tiles."""
    low, high = F.least("sstart", "send"), F.greatest("sstart", "send")
    rows = hits.select(F.concat_ws("\t", "qseqid", "sseqid").alias("seq_id"), low.alias("start"), high.alias("end"))
    per = ranges.merged(rows).groupBy("seq_id").agg(F.count(F.lit(1)).alias("tiles"), F.sum(F.col("end") - F.col("start") + 1).alias("covered"))
    key = F.split("seq_id", "\t")
    return per.select(F.get(key, F.lit(0)).alias("qseqid"), F.get(key, F.lit(1)).alias("sseqid"), "tiles", "covered")


def matched_percent(hits: DataFrame, query_length) -> DataFrame:
    return hits.withColumn("matched", F.col("length") / query_length * 100)


def labels(hits: DataFrame) -> DataFrame:
    """Composite label of a hit."""
    return hits.select("*", F.concat_ws("|", "qseqid", "sseqid", F.col("length").cast("string"), F.col("mismatch").cast("string")).alias("label"))


def fractions(hits: DataFrame, query_length, missing: float = 0.3) -> DataFrame:
    """Matches, their share and percent of each hit, and whether it lacks at most a share of the query."""
    matches = (F.col("length") - F.col("mismatch")).cast("long")
    long_enough = F.col("length") >= query_length - query_length * missing
    return hits.withColumns({"matches": matches, "frac_identical": matches / F.col("length"), "percent_identity": 100 * matches / F.col("length"), "long_enough": long_enough})


def totals(hits: DataFrame) -> DataFrame:
    """Per query and subject: its hits, their length and matches in all, and the best bit score."""
    matches = F.col("length") - F.col("mismatch")
    return hits.groupBy("qseqid", "sseqid").agg(
        F.count(F.lit(1)).alias("hsps"), F.sum("length").cast("long").alias("logical_length"), F.sum(matches).cast("long").alias("matches"), F.max("bitscore").alias("best"),
    )
