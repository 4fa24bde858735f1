"""Feature lines of tab-separated formats, to and from columns (seq_id, start, end: 1-based, closed; name; score; strand: 1, -1, 0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _sign(strand: Column) -> Column:
    return F.when(strand == 1, "+").when(strand == -1, "-").otherwise(".")


def _strand(sign: Column) -> Column:
    return F.when(sign == "+", 1).when(sign == "-", -1).otherwise(0)


def _fields(lines: DataFrame, comment: str) -> DataFrame:
    return lines.filter(~F.col("value").rlike(comment) & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"))


def _field(k: int) -> Column:
    return F.get("f", F.lit(k))


def parse_bed(lines: DataFrame) -> DataFrame:
    """BED starts count from 0 and are half open; fields after the third may be absent."""
    rows = _fields(lines, "^(#|track|browser)")
    return rows.select(_field(0).alias("seq_id"), (_field(1).cast("long") + 1).alias("start"), _field(2).cast("long").alias("end"), _field(3).alias("name"), _field(4).try_cast("double").alias("score"), _strand(_field(5)).alias("strand"))


def bed_lines(rows: DataFrame) -> DataFrame:
    cells = (F.col("seq_id"), (F.col("start") - 1).cast("string"), F.col("end").cast("string"), F.coalesce("name", F.lit(".")), F.coalesce(F.col("score").cast("string"), F.lit("0")), _sign(F.col("strand")))
    return rows.select(F.concat_ws("\t", *cells).alias("value"))


def parse_gtf(lines: DataFrame) -> DataFrame:
    """GTF: attributes as ``key "value";`` pairs, gene_id as the name."""
    rows = _fields(lines, "^#")
    pairs = F.regexp_extract_all(_field(8), F.lit('(\\w+) "([^"]*)"'), F.lit(0))
    attributes = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^(\w+)", 1).alias("k"), F.regexp_extract(p, '"([^"]*)"', 1).alias("v"))))
    columns = rows.select(_field(0).alias("seq_id"), _field(2).alias("type"), _field(3).cast("long").alias("start"), _field(4).cast("long").alias("end"), _field(5).try_cast("double").alias("score"), _strand(_field(6)).alias("strand"), attributes.alias("attributes"))
    return columns.withColumn("name", F.try_element_at("attributes", F.lit("gene_id")))


def gtf_lines(rows: DataFrame, source: str = "engine") -> DataFrame:
    cells = (F.col("seq_id"), F.lit(source), F.col("type"), F.col("start").cast("string"), F.col("end").cast("string"), F.coalesce(F.col("score").cast("string"), F.lit(".")), _sign(F.col("strand")), F.lit("."), F.concat(F.lit('gene_id "'), F.col("name"), F.lit('";')))
    return rows.select(F.concat_ws("\t", *cells).alias("value"))


def parse_psl(lines: DataFrame) -> DataFrame:
    """Alignments of a PSL file without its header: matches, mismatches, strand, and both intervals (1-based, closed)."""
    rows = _fields(lines, r"^(psLayout|match|\s|-)")
    return rows.select(
        _field(0).cast("long").alias("matches"), _field(1).cast("long").alias("mismatches"), _strand(_field(8)).alias("strand"), _field(9).alias("qseqid"), (_field(11).cast("long") + 1).alias("qstart"),
        _field(12).cast("long").alias("qend"), _field(13).alias("sseqid"), (_field(15).cast("long") + 1).alias("sstart"), _field(16).cast("long").alias("send"),
    )


def bed(spark: SparkSession, path) -> DataFrame:
    return parse_bed(spark.read.text(path))


def gtf(spark: SparkSession, path) -> DataFrame:
    return parse_gtf(spark.read.text(path))


def psl(spark: SparkSession, path) -> DataFrame:
    return parse_psl(spark.read.text(path))
