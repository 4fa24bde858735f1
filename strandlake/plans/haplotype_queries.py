"""Queries on haplotypes of gapped sequences, with their SQL twins where there can be any."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import haplotypes
from strandlake.plans import derived as d

QUERIES, ORACLES = {}, {}
GAPPED = d.gapped_sql()


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _rows(spark, sf):
    return d.gapped(spark, sf, parts=int(spark.conf.get("spark.sql.shuffle.partitions"))).select(F.col("grp").alias("sample"), "ord", "seq")


_TEXTS = f"""WITH g AS MATERIALIZED (SELECT grp AS sample, ord, seq FROM {GAPPED}), t AS MATERIALIZED (SELECT DISTINCT sample, seq FROM g),
p AS MATERIALIZED (SELECT a.sample, a.seq, b.seq AS other FROM t a JOIN t b ON a.sample = b.sample
  WHERE len(list_filter(range(1, 65), lambda i: contains('ACGT', substr(a.seq, CAST(i AS INT), 1)) AND contains('ACGT', substr(b.seq, CAST(i AS INT), 1)) AND substr(a.seq, CAST(i AS INT), 1) <> substr(b.seq, CAST(i AS INT), 1))) = 0
    AND len(list_filter(range(1, 65), lambda i: contains('ACGT', substr(a.seq, CAST(i AS INT), 1)) AND contains('ACGT', substr(b.seq, CAST(i AS INT), 1)))) > 0),
h AS (SELECT sample, seq, min(other) AS haplotype FROM p GROUP BY sample, seq) """


@query("collapsed_haplotypes", _TEXTS + "SELECT g.ord, haplotype FROM g JOIN h USING (sample, seq)")
def collapsed_haplotypes(spark, sf):
    return haplotypes.collapsed(_rows(spark, sf)).select("ord", "haplotype")


@query("haplotype_locations", _TEXTS + "SELECT haplotype, c_mktsegment AS location, count(*) AS members FROM g JOIN h USING (sample, seq) JOIN customer ON c_custkey = ord GROUP BY ALL")
def haplotype_locations(spark, sf):
    where = d.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("ord"), F.col("c_mktsegment").alias("location"))
    return haplotypes.haplotype_counts(haplotypes.collapsed(_rows(spark, sf)), where)


@query("compatible_sequences", _TEXTS + ", f AS (SELECT sample, seq, min(ord) AS ord FROM g GROUP BY sample, seq) SELECT a.ord AS ord1, b.ord AS ord2 FROM p JOIN f a ON a.sample = p.sample AND a.seq = p.seq JOIN f b ON b.sample = p.sample AND b.seq = p.other WHERE a.ord < b.ord")
def compatible_sequences(spark, sf):
    texts = _rows(spark, sf).groupBy("sample", "seq").agg(F.min("ord").alias("ord"))
    return haplotypes.compatible_pairs(texts).select("ord1", "ord2")


@query("sequence_starts", f"SELECT ord, CAST(length(regexp_extract(seq, '^[-.]*')) + 1 AS BIGINT) AS start, CAST(length(replace(seq, '-', '')) AS BIGINT) AS residues FROM {GAPPED}")
def sequence_starts(spark, sf):
    return haplotypes.by_start(d.gapped(spark, sf)).select("ord", "start", "residues")


@query("first_compatible_haplotypes")
def first_compatible_haplotypes(spark, sf):
    """As a loop over each nation's sequences assigns them; tests compare it with that loop."""
    return haplotypes.first_compatible(_rows(spark, sf)).select("ord", "haplotype")


@query("purged_alignment")
def purged_alignment(spark, sf):
    """Suppliers' sequences without those that are more than nine tenths like an earlier one kept."""
    return haplotypes.purged(d.sequences(spark, sf, "supplier").select("ord", "seq"), 0.9, d.LENGTH).select("ord")
