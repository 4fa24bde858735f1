"""Scans of biological text formats into DataFrames, by the text source and SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names of the tables these formats hold.
HIT_SCHEMA = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double"
ASSEMBLY_COLUMNS = "organism strain biosample bioproject group subgroup size_mb gc_pct assembly replicons wgs scaffolds genes proteins release_date modify_date level refseq_ftp genbank_ftp final c1 c2 c3 c4 assembly_name genomic protein feature_table".split()
ANNOTATION_COLUMNS = "taxon_query taxon_id accession seq_query seqs_found description gene product binom tax_hierarchy pub_title pub_authors pub_abstract_text jrn_name jrn_doi jrn_so jrn_volume jrn_issue jrn_pages jrn_pubdate nuc_seq fasta_nuc aln_seq aln_score prot_seq distance primers codon_start collection_date voucher_id collected_by identified_by organelle location lat_lon isolate bio_material".split()


def _records(spark: SparkSession, path, mark: str) -> DataFrame:
    rows = spark.read.option("lineSep", mark).text(path)
    return rows.select(F.replace("value", F.lit("\r"), F.lit("")).alias("value"), F.col("_metadata.file_name").alias("file"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id()).alias("ord"))


def fasta(spark: SparkSession, path) -> DataFrame:
    """ord, file, id, description, seq of each record; wrapped lines are joined, blanks in them dropped."""
    rows = _records(spark, path, "\n>").withColumn("value", F.regexp_replace("value", "^\\s*>", "")).filter(F.length(F.trim("value")) > 0)
    header = F.substring_index("value", "\n", 1)
    body = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    return rows.select("ord", "file", F.regexp_extract(header, r"^(\S*)", 1).alias("id"), F.regexp_extract(header, r"^\S*\s*(.*)$", 1).alias("description"), F.regexp_replace(body, r"\s", "").alias("seq"))


def fastq(spark: SparkSession, path) -> DataFrame:
    """ord, id, seq, qualities (offset 33) of four-line records."""
    rows = _records(spark, path, "\n@").withColumn("value", F.regexp_replace("value", "^@", "")).filter(F.length("value") > 0)
    line = lambda k: F.get(F.split("value", "\n"), F.lit(k))
    quality = F.transform(F.regexp_extract_all(line(3), F.lit("."), F.lit(0)), lambda c: F.ascii(c) - 33)
    return rows.select("ord", F.regexp_extract(line(0), r"^(\S*)", 1).alias("id"), line(1).alias("seq"), quality.alias("qualities"))


def genbank(spark: SparkSession, path) -> DataFrame:
    """accession, definition, organism, lineage, seq and a map of qualifiers of each record."""
    rows = _records(spark, path, "\n//").filter(F.col("value").contains("LOCUS"))
    one = lambda pattern: F.nullif(F.regexp_extract("value", pattern, 1), F.lit(""))
    flat = lambda c: F.regexp_replace(c, r"\s*\n\s+", " ")
    pairs = F.regexp_extract_all("value", F.lit(r'(?m)^\s{21}/(\w+)="?([^"\n]*(?:\n\s{21}[^/"\n][^"\n]*)*)"?'), F.lit(0))
    cells = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"/(\w+)=", 1).alias("key"), flat(F.regexp_replace(F.regexp_extract(p, r"(?s)=(.*)$", 1), '"', "")).alias("value")))
    origin = F.regexp_replace(F.regexp_extract("value", r"(?s)\nORIGIN[^\n]*\n(.*)$", 1), r"[\d\s/]", "")
    ranks = F.split(F.regexp_replace(F.regexp_replace(F.regexp_extract("value", r"\n  ORGANISM[^\n]*\n((?:\s{12}[^\n]*\n)+)", 1), r"\s+", " "), r"^ |\. ?$| $", ""), "; ?")
    return rows.select("ord", one(r"\nACCESSION\s+(\S+)").alias("accession"), flat(F.regexp_extract("value", r"\nDEFINITION\s+((?:[^\n]|\n\s{12})*)", 1)).alias("definition"), one(r"\n  ORGANISM\s+([^\n]*)").alias("organism"), ranks.alias("lineage"), F.upper(origin).alias("seq"), cells.alias("qualifiers"))


def qualifier(name: str):
    """The last value of a qualifier of a ``genbank`` record."""
    found = F.filter("qualifiers", lambda x: x["key"] == name)
    return F.try_element_at(found, F.lit(-1))["value"]


def hits(spark: SparkSession, path, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, sep=sep, schema=HIT_SCHEMA, comment="#")


def annotations(spark: SparkSession, path) -> DataFrame:
    """37 text columns; rows that lack the last ones get nulls, NA is missing."""
    schema = ", ".join(f"{c} string" for c in ANNOTATION_COLUMNS)
    return spark.read.csv(path, header=True, schema=schema, quote='"', nullValue="NA", enforceSchema=True)


def assemblies(spark: SparkSession, path) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"`{c}` string" for c in ASSEMBLY_COLUMNS), enforceSchema=True)


def lines(spark: SparkSession, path) -> DataFrame:
    """A list file: one value per line, blanks as _."""
    return spark.read.text(path).select(F.replace(F.trim("value"), F.lit(" "), F.lit("_")).alias("value")).filter("value <> ''")


def settings(spark: SparkSession, path) -> DataFrame:
    """key, value of KEY=VALUE lines, split at the first =."""
    rows = spark.read.text(path).filter(F.contains("value", F.lit("=")))
    parts = F.split("value", "=", 2)
    return rows.select(F.trim(F.get(parts, F.lit(0))).alias("key"), F.get(parts, F.lit(1)).alias("value"))


def delimited(spark: SparkSession, path, mark: str = "$") -> DataFrame:
    """id, seq of lines with a mark between them."""
    parts = F.split("value", f"[{mark}]")
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("seq")).filter("seq IS NOT NULL")


def gff(spark: SparkSession, path) -> DataFrame:
    """Features with their attributes as a map; version 3."""
    schema = "seq_id string, source string, type string, start int, end int, score string, strand string, phase string, attributes string"
    rows = spark.read.csv(path, sep="\t", schema=schema, comment="#", nullValue=".")
    return rows.withColumn("attributes", F.expr("str_to_map(attributes, ';', '=')"))


def newick(spark: SparkSession, path) -> DataFrame:
    """tree, node, parent, label, length of files with a tree per statement."""
    from strandlake.operators.trees import parse_newick

    def run(batches):
        for pdf in batches:
            rows = [(t, *r) for t, text in zip(pdf["tree"], pdf["value"], strict=True) for r in parse_newick(text)]
            import pandas as pd

            yield pd.DataFrame(rows, columns=["tree", "node", "parent", "label", "length"]).astype({"parent": "Int64", "length": "Float64"})

    rows = _records(spark, path, ";").filter(F.length(F.trim("value")) > 0).select(F.col("ord").alias("tree"), "value")
    return rows.mapInPandas(run, "tree long, node long, parent long, label string, length double")
