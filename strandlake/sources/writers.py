"""Text of biological formats as single-column DataFrames, to be written with ``write.text``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fasta(rows: DataFrame, wrap: int | None = None) -> DataFrame:
    body = F.col("seq") if wrap is None else F.rtrim(F.regexp_replace("seq", f"(.{{{wrap}}})(?!$)", "$1\n"))
    return rows.select(F.concat(F.lit(">"), F.col("id"), F.lit("\n"), body).alias("value"))


def nexus_matrix(rows: DataFrame, by: str) -> DataFrame:
    """Per group one NEXUS data block; | and - in ids become _."""
    line = F.concat(F.translate("id", "|-", "__"), F.lit("\t"), F.col("seq"))
    parts = F.array_sort(F.collect_list(line))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("seq")).alias("size"), parts.alias("lines")).select(by, F.concat(F.lit("#NEXUS\nBEGIN DATA;\nDIMENSIONS NTAX="), F.col("n").cast("string"), F.lit(" NCHAR="), F.col("size").cast("string"), F.lit(";\nFORMAT DATATYPE=DNA MISSING=? GAP=-;\nMATRIX\n"), F.array_join("lines", "\n"), F.lit("\n;END;")).alias("value"))


def phylip(rows: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Per group a PHYLIP text with numbers for ids, and the table (group, number, id)."""
    at = rows.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy("id")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("number", "seq"))), lambda x: F.concat(F.rpad(x["number"].cast("string"), F.lit(10), F.lit(" ")), x["seq"]))
    text = at.groupBy(by).agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" "), F.max(F.length("seq")).cast("string"), F.lit("\n"), F.array_join(parts, "\n")).alias("value"))
    return text, at.select(by, "number", "id")


def arlequin(rows: DataFrame) -> DataFrame:
    """Per species (species, sample, haplotype, n) a project with a sample block for each sample."""
    line = F.concat(F.col("haplotype"), F.lit(" "), F.col("n").cast("string"))
    sample = rows.groupBy("species", "sample").agg(F.sum("n").alias("size"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    block = F.concat(F.lit('SampleName="'), F.col("sample"), F.lit('"\nSampleSize='), F.col("size").cast("string"), F.lit("\nSampleData={\n"), F.col("body"), F.lit("\n}"))
    return sample.groupBy("species").agg(F.concat(F.lit('[Profile]\nTitle="'), F.first("species"), F.lit('"\nDataType=DNA\n[Data]\n[[Samples]]\n'), F.array_join(F.array_sort(F.collect_list(block)), "\n")).alias("value"))


def key_values(rows: DataFrame, by: str) -> DataFrame:
    """One key=value line per cell."""
    cells = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in rows.columns if c != by]
    return rows.select(by, F.explode(F.array(*cells)).alias("c")).select(by, F.concat(F.col("c.key"), F.lit("="), F.coalesce("c.value", F.lit("NA"))).alias("value"))


def distance_matrix(pairs: DataFrame, least_bases: int, cap: float = 0.5) -> DataFrame:
    """Long matrix of both triangles and the diagonal: id1, id2, distance at most ``cap``; too few bases give the cap."""
    d = F.when(F.col("n") < least_bases, cap).otherwise(F.least("k2p", F.lit(cap)))
    half = pairs.select("id1", "id2", d.alias("distance"))
    ids = half.select("id1").union(half.select("id2")).distinct()
    return half.union(half.select("id2", "id1", "distance")).union(ids.select("id1", "id1", F.lit(0.0)))
