"""Queries on alignments, populations, ranges and trees, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import alignment, popgen, ranges, trees
from strandlake.plans import derived as d

QUERIES, ORACLES = {}, {}
SUP, SUP_GAPPED = d.sequences_sql("supplier"), d.gapped_sql("supplier")
COLS, GCOLS = d.columns_sql(d.sequences_sql()), d.columns_sql(SUP_GAPPED)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _gcols(spark, sf):
    return d.columns(d.gapped(spark, sf, "supplier"))


@query("consensus", f"""WITH c AS {GCOLS}, n AS (SELECT pos, base, count(*) AS n FROM c WHERE base <> '-' GROUP BY pos, base), b AS (SELECT pos, base, n FROM n QUALIFY row_number() OVER (PARTITION BY pos ORDER BY n DESC, base) = 1), t AS (SELECT pos, count(*) AS rows FROM c GROUP BY pos)
SELECT pos, CASE WHEN coalesce(n, 0) * 100 >= 30 * rows THEN coalesce(base, '?') ELSE '?' END AS base FROM t LEFT JOIN b USING (pos)""")
def consensus(spark, sf):
    return alignment.consensus(_gcols(spark, sf), 30)


_IUPAC = "CASE b " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {"A": "A", "C": "C", "G": "G", "T": "T", "AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K", "ACG": "V", "ACT": "H", "AGT": "D", "CGT": "B", "ACGT": "N"}.items()) + " ELSE 'N' END"


@query("consensus_iupac", f"SELECT pos, {_IUPAC} AS code FROM (SELECT pos, coalesce(string_agg(DISTINCT base, '' ORDER BY base) FILTER (base IN ('A','C','G','T')), '') AS b FROM {GCOLS} WHERE grp = 3 GROUP BY pos)")
def consensus_iupac(spark, sf):
    return alignment.consensus_iupac(_gcols(spark, sf).filter("grp = 3"))


@query("consensus_iupac_all", f"SELECT grp, pos, {_IUPAC} AS code FROM (SELECT grp, pos, coalesce(string_agg(DISTINCT base, '' ORDER BY base) FILTER (base IN ('A','C','G','T')), '') AS b FROM {GCOLS} GROUP BY grp, pos)")
def consensus_iupac_all(spark, sf):
    return alignment.consensus_iupac(_gcols(spark, sf), ("grp",))


@query("match_and_gap_lines", f"SELECT pos, CASE WHEN count(DISTINCT base) = 1 AND max(base) <> '-' THEN '*' ELSE ' ' END AS mark, bool_or(base = '-') AS any_gap, bool_and(base = '-') AS all_gap FROM {GCOLS} WHERE grp = 5 GROUP BY pos")
def match_and_gap_lines(spark, sf):
    c = _gcols(spark, sf).filter("grp = 5")
    return alignment.match_line(c).join(alignment.gap_lines(c), "pos")


@query("match_and_gap_lines_all", f"SELECT grp, pos, CASE WHEN count(DISTINCT base) = 1 AND max(base) <> '-' THEN '*' ELSE ' ' END AS mark, bool_or(base = '-') AS any_gap, bool_and(base = '-') AS all_gap FROM {GCOLS} GROUP BY grp, pos")
def match_and_gap_lines_all(spark, sf):
    c = _gcols(spark, sf)
    return alignment.match_line(c, ("grp",)).join(alignment.gap_lines(c, ("grp",)), ["grp", "pos"])


@query("covered_columns", f"WITH c AS {GCOLS}, k AS (SELECT pos FROM c GROUP BY pos HAVING count(*) FILTER (base <> '-') >= floor((SELECT count(DISTINCT id) FROM c) * 0.9)) SELECT id, string_agg(base, '' ORDER BY pos) AS seq FROM c WHERE pos IN (SELECT pos FROM k) GROUP BY id")
def covered_columns(spark, sf):
    return alignment.wide_form(alignment.covered_columns(_gcols(spark, sf).select("id", "pos", "base"), 0.9))


@query("percent_identity", f"""WITH n AS (SELECT pos, base, count(*) AS n FROM {GCOLS} WHERE base <> '-' GROUP BY pos, base), p AS (SELECT pos, sum(n * (n - 1)) AS e, sum(n) AS a FROM n GROUP BY pos)
SELECT round(100.0 * sum(e) / sum(a * (a - 1)), 6) AS average, (SELECT round(100.0 * count(*) FILTER (k = 1 AND m <> '-') / count(*), 6) FROM (SELECT pos, count(DISTINCT base) AS k, max(base) AS m FROM {GCOLS} GROUP BY pos)) AS overall FROM p""")
def percent_identity(spark, sf):
    c = _gcols(spark, sf)
    a, o = alignment.average_identity(c).withColumnRenamed("identity", "average"), alignment.overall_identity(c).withColumnRenamed("identity", "overall")
    return a.crossJoin(o).select(F.round("average", 6).alias("average"), F.round("overall", 6).alias("overall"))


@query("bracket_string", f"SELECT pos, CASE WHEN count(DISTINCT base) = 1 THEN min(base) ELSE '[' || string_agg(DISTINCT base, '/' ORDER BY base) || ']' END AS text FROM {GCOLS} WHERE grp = 7 GROUP BY pos")
def bracket_string(spark, sf):
    return alignment.bracket_string(_gcols(spark, sf).filter("grp = 7"))


@query("bracket_string_all", f"SELECT grp, pos, CASE WHEN count(DISTINCT base) = 1 THEN min(base) ELSE '[' || string_agg(DISTINCT base, '/' ORDER BY base) || ']' END AS text FROM {GCOLS} GROUP BY grp, pos")
def bracket_string_all(spark, sf):
    return alignment.bracket_string(_gcols(spark, sf), ("grp",))


@query("residue_columns", f"SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) AS INT) AS residue, pos FROM {GCOLS} WHERE base <> '-'")
def residue_columns(spark, sf):
    return alignment.residue_columns(_gcols(spark, sf))


@query("cigar_lines", f"""WITH r AS (SELECT id, pos, CASE WHEN base = '-' THEN 'D' ELSE 'M' END AS op FROM {GCOLS}), g AS (SELECT id, op, min(pos) AS pos, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY id, op ORDER BY pos) AS run FROM r) GROUP BY id, op, run)
SELECT id, string_agg(n || op, '' ORDER BY pos) AS cigar FROM g GROUP BY id""")
def cigar_lines(spark, sf):
    return alignment.cigar(_gcols(spark, sf))


@query("dotted_alignment", f"WITH s AS {SUP}, r AS (SELECT seq AS ref FROM s WHERE ord = 1) SELECT id, CASE WHEN ord = 1 THEN seq ELSE list_reduce(list_transform(range(1, 65), lambda i: CASE WHEN substr(seq, CAST(i AS INT), 1) = substr(ref, CAST(i AS INT), 1) THEN '.' ELSE substr(seq, CAST(i AS INT), 1) END), lambda x, y: x || y) END AS seq FROM s, r")
def dotted_alignment(spark, sf):
    return alignment.against_reference(d.sequences(spark, sf, "supplier"), "0000000001")


def _genes(spark, sf):
    s = d.sequences(spark, sf, "supplier")
    cut = [s.filter(f"ord % {k + 2} <> 0").select(F.lit(f"gene{k}").alias("gene"), "id", F.substring("seq", 1 + 10 * k, 10 + k).alias("seq")) for k in range(3)]
    return cut[0].union(cut[1]).union(cut[2])


_GENES = "(" + " UNION ALL ".join(f"SELECT 'gene{k}' AS gene, id, substr(seq, {1 + 10 * k}, {10 + k}) AS seq FROM {SUP} WHERE ord % {k + 2} <> 0" for k in range(3)) + ")"


@query("supermatrix", f"WITH g AS {_GENES}, z AS (SELECT gene, max(length(seq)) AS n FROM g GROUP BY gene) SELECT i.id, string_agg(coalesce(g.seq, repeat('-', CAST(z.n AS INT))), '' ORDER BY z.gene) AS seq FROM (SELECT DISTINCT id FROM g) i CROSS JOIN z LEFT JOIN g ON g.id = i.id AND g.gene = z.gene GROUP BY i.id")
def supermatrix(spark, sf):
    return alignment.supermatrix(_genes(spark, sf))


@query("gene_partitions", f"SELECT gene, CAST(sum(n) OVER (ORDER BY gene) - n + 1 AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY gene) AS BIGINT) AS \"end\" FROM (SELECT gene, max(length(seq)) AS n FROM {_GENES} GROUP BY gene)")
def gene_partitions(spark, sf):
    return alignment.gene_partitions(_genes(spark, sf))


#: Start and length of three genes that cover all 64 bases; a row lacks a gene whose piece begins with A.
_WHOLE_GENES = ((1, 21), (22, 21), (43, 22))


def _genes_all(spark, sf):
    s = d.sequences(spark, sf, "supplier")
    cuts = F.array(*(F.struct(F.lit(f"gene{k}").alias("gene"), F.substring("seq", at, size).alias("seq")) for k, (at, size) in enumerate(_WHOLE_GENES)))
    return s.select("id", F.explode(cuts).alias("cut")).select("cut.gene", "id", "cut.seq").filter("NOT startswith(seq, 'A')")


_GENES_ALL = "(" + " UNION ALL ".join(f"SELECT 'gene{k}' AS gene, id, substr(seq, {at}, {size}) AS seq FROM {SUP} WHERE substr(seq, {at}, 1) <> 'A'" for k, (at, size) in enumerate(_WHOLE_GENES)) + ")"


@query("supermatrix_all", f"WITH g AS {_GENES_ALL}, z AS (SELECT gene, max(length(seq)) AS n FROM g GROUP BY gene) SELECT i.id, string_agg(coalesce(g.seq, repeat('-', CAST(z.n AS INT))), '' ORDER BY z.gene) AS seq FROM (SELECT DISTINCT id FROM g) i CROSS JOIN z LEFT JOIN g ON g.id = i.id AND g.gene = z.gene GROUP BY i.id")
def supermatrix_all(spark, sf):
    return alignment.supermatrix(_genes_all(spark, sf))


@query("gene_partitions_all", f"SELECT gene, CAST(sum(n) OVER (ORDER BY gene) - n + 1 AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY gene) AS BIGINT) AS \"end\" FROM (SELECT gene, max(length(seq)) AS n FROM {_GENES_ALL} GROUP BY gene)")
def gene_partitions_all(spark, sf):
    return alignment.gene_partitions(_genes_all(spark, sf))


@query("contig_append", f"SELECT grp AS file, min(id) AS id, string_agg(seq, chr(10) ORDER BY ord) AS seq FROM {SUP} GROUP BY grp")
def contig_append(spark, sf):
    return alignment.appended(d.sequences(spark, sf, "supplier").withColumnRenamed("grp", "file"))


_SITES = f"""n AS (SELECT grp, pos, base, count(*) AS c FROM {COLS} WHERE base IN ('A','C','G','T') GROUP BY grp, pos, base),
s AS (SELECT grp, pos, sum(c) AS n, count(*) AS k, count(*) FILTER (c = 1) AS singles, CASE WHEN sum(c) > 1 THEN 1 - CAST(sum(c * (c - 1)) AS DOUBLE) / (sum(c) * (sum(c) - 1)) ELSE 0 END AS pi FROM n GROUP BY grp, pos),
g AS (SELECT grp, CAST(max(n) AS BIGINT) AS n, sum(pi) AS pi, count(*) FILTER (k > 1) AS s, CAST(sum(CASE WHEN k > 1 THEN singles ELSE 0 END) AS BIGINT) AS singles FROM s GROUP BY grp),
h AS (SELECT *, list_sum(list_transform(range(1, n), lambda i: 1.0::DOUBLE / i)) AS a1, list_sum(list_transform(range(1, n), lambda i: 1.0::DOUBLE / (i * i))) AS a2 FROM g),
e AS (SELECT *, ((n + 1) / (3.0::DOUBLE * (n - 1)) - 1 / a1) / a1 AS e1, (2.0::DOUBLE * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) AS e2 FROM h)"""


@query("nucleotide_diversity", f"WITH {_SITES} SELECT grp, n, round(pi, 6) AS pi, s AS segregating, singles AS singletons, round(s / a1, 6) AS theta, round(CASE WHEN n > 1 AND s > 0 AND e1 * s + e2 * s * (s - 1) > 0 THEN (pi - s / a1) / sqrt(e1 * s + e2 * s * (s - 1)) END, 6) AS tajima_d FROM e")
def nucleotide_diversity(spark, sf):
    per = popgen.diversity(d.columns(d.sequences(spark, sf)), ("grp",))
    return per.select("grp", "n", F.round("pi", 6).alias("pi"), "segregating", "singletons", F.round("theta", 6).alias("theta"), F.round("tajima_d", 6).alias("tajima_d"))


@query("site_statistics", f"SELECT pos, CAST(sum(c) AS BIGINT) AS n, count(*) AS k, count(*) FILTER (c = 1) AS singletons, round(1 - CAST(sum(c * (c - 1)) AS DOUBLE) / (sum(c) * (sum(c) - 1)), 6) AS pi FROM (SELECT pos, base, count(*) AS c FROM {GCOLS} WHERE base IN ('A','C','G','T') GROUP BY pos, base) GROUP BY pos")
def site_statistics(spark, sf):
    return popgen.site_counts(_gcols(spark, sf)).withColumn("pi", F.round("pi", 6))


_FST = f"""WITH a AS (SELECT pos AS marker, grp % 3 AS population, base AS allele FROM {COLS}), n AS (SELECT marker, population, count(*) AS n FROM a GROUP BY ALL), x AS (SELECT marker, population, allele, count(*) AS c FROM a GROUP BY ALL), k AS (SELECT DISTINCT marker, allele FROM a),
g AS (SELECT n.marker, k.allele, n.n, CAST(coalesce(c, 0) AS DOUBLE) / n.n AS p FROM n JOIN k ON n.marker = k.marker LEFT JOIN x ON x.marker = n.marker AND x.population = n.population AND x.allele = k.allele),
q AS (SELECT marker, allele, count(*) AS r, CAST(sum(n) AS DOUBLE) AS t, CAST(sum(n * n) AS DOUBLE) AS z, sum(n * p) / sum(n) AS m, sum(n * p * p) AS np2, sum(n * p * (1 - p)) AS w FROM g GROUP BY marker, allele),
v AS (SELECT (np2 - t * m * m) / (r - 1) AS msp, w / (t - r) AS msg, (t - z / t) / (r - 1) AS nc FROM q WHERE r > 1 AND t > r) SELECT round(sum(msp - msg) / sum(msp + (nc - 1) * msg), 6) AS fst FROM v"""


@query("fst", _FST)
def fst(spark, sf):
    a = d.columns(d.sequences(spark, sf)).select(F.col("pos").alias("marker"), (F.col("grp") % 3).alias("population"), F.col("base").alias("allele"))
    return popgen.fst(a).select(F.round("fst", 6).alias("fst"))


R = d.RANGES_SQL


@query("range_overlaps", f'SELECT a.id AS a_id, b.id AS b_id, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end" FROM {R} a JOIN {R} b ON a.seq_id = b.seq_id AND a.start <= b."end" AND a."end" >= b.start AND a.strand = b.strand AND a.id < b.id')
def range_overlaps(spark, sf):
    r = d.ranges(spark, sf)
    return ranges.overlap(r, r, strand="strong").filter("a_id < b_id").select("a_id", "b_id", "start", "end")


@query("range_containment", f'SELECT a.id AS a_id, b.id AS b_id, a."end" - a.start - b."end" + b.start AS a_only, b."end" - b.start + 1 AS "both" FROM {R} a JOIN {R} b ON a.seq_id = b.seq_id AND b.start >= a.start AND b."end" <= a."end" AND a.id <> b.id')
def range_containment(spark, sf):
    r = d.ranges(spark, sf)
    return ranges.overlap_extent(ranges.contains(ranges.overlap(r, r)).filter("a_id <> b_id")).select("a_id", "b_id", "a_only", "both")


_MERGED = f"""(SELECT seq_id, min(start) AS start, max("end") AS "end", count(*) AS parts FROM (SELECT *, sum(new) OVER (PARTITION BY seq_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM
  (SELECT *, CASE WHEN start > coalesce(max("end") OVER (PARTITION BY seq_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -2) + 1 THEN 1 ELSE 0 END AS new FROM {R})) GROUP BY seq_id, island)"""


@query("range_merge", f"SELECT * FROM {_MERGED}")
def range_merge(spark, sf):
    return ranges.merged(d.ranges(spark, sf))


@query("range_gaps", f'SELECT seq_id, "end" + 1 AS start, nxt - 1 AS "end" FROM (SELECT *, lead(start) OVER (PARTITION BY seq_id ORDER BY start) AS nxt FROM {_MERGED}) WHERE nxt IS NOT NULL')
def range_gaps(spark, sf):
    return ranges.gaps(d.ranges(spark, sf))


@query("range_coverage", f"""WITH s AS (SELECT seq_id, at_, CAST(sum(x) AS BIGINT) AS x FROM (SELECT seq_id, start AS at_, 1 AS x FROM {R} UNION ALL SELECT seq_id, "end" + 1, -1 FROM {R}) GROUP BY seq_id, at_ HAVING sum(x) <> 0),
c AS (SELECT seq_id, at_ AS start, lead(at_) OVER (PARTITION BY seq_id ORDER BY at_) - 1 AS "end", CAST(sum(x) OVER (PARTITION BY seq_id ORDER BY at_) AS BIGINT) AS depth FROM s) SELECT * FROM c WHERE depth > 0""")
def range_coverage(spark, sf):
    return ranges.coverage(d.ranges(spark, sf))


@query("range_subtract", f"""WITH b AS (SELECT * FROM {R} WHERE strand = -1), a AS (SELECT * FROM {R} WHERE strand = 1), p AS (SELECT id, seq_id, unnest(range(start, "end" + 1)) AS x FROM a),
q AS (SELECT DISTINCT p.id, p.seq_id, p.x FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.seq_id = p.seq_id AND p.x BETWEEN b.start AND b."end"))
SELECT id, seq_id, CAST(min(x) AS INT) AS start, CAST(max(x) AS INT) AS "end" FROM (SELECT *, x - row_number() OVER (PARTITION BY id ORDER BY x) AS g FROM q) GROUP BY id, seq_id, g""")
def range_subtract(spark, sf):
    r = d.ranges(spark, sf)
    return ranges.subtract(r.filter("strand = 1"), r.filter("strand = -1"))


_BINS = "CASE " + " ".join(f"WHEN floor(start / {t}) = floor(\"end\" / {t}) THEN '{t}.' || CAST(floor(start / {t}) AS BIGINT)" for t in (1000, 10000, 100000, 1000000, 10000000, 100000000)) + " ELSE '100000000.0' END"


@query("range_bins", f"SELECT bin, count(*) AS n FROM (SELECT {_BINS} AS bin FROM {R}) GROUP BY bin")
def range_bins(spark, sf):
    return d.ranges(spark, sf).groupBy(ranges.bin_of(F.col("start"), F.col("end")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("clear_ranges", 'SELECT id, min(pos) AS start, max(pos) AS "end" FROM (SELECT *, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS g FROM (SELECT CAST(l_orderkey AS BIGINT) AS id, CAST(l_linenumber AS INT) AS pos, l_quantity AS q FROM lineitem) WHERE q >= 20) GROUP BY id, g')
def clear_ranges(spark, sf):
    q = d.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("long").alias("id"), F.col("l_linenumber").cast("int").alias("pos"), F.col("l_quantity").alias("quality"))
    return ranges.clear_ranges(q, 20)


_UP = f"WITH RECURSIVE t AS MATERIALIZED {d.TREE_SQL}, up(node, anc, levels, distance) AS (SELECT node, node, 0, CAST(0 AS DOUBLE) FROM t UNION ALL SELECT up.node, t.parent, levels + 1, distance + t.length FROM up JOIN t ON up.anc = t.node WHERE t.parent IS NOT NULL)"


@query("tree_depths", _UP + " SELECT node, CAST(max(levels) AS INT) AS levels, round(max(distance), 6) AS depth FROM up GROUP BY node")
def tree_depths(spark, sf):
    return trees.depths(d.tree(spark, sf)).withColumn("depth", F.round("depth", 6))


@query("tree_clades", _UP + " SELECT anc AS node, count(*) FILTER (up.node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)) AS leaves, count(*) - 1 AS descendants, round(sum(CASE WHEN levels > 0 THEN length ELSE 0 END), 6) AS subtree_length, round(max(distance), 6) AS height FROM up JOIN t ON t.node = up.node GROUP BY anc")
def tree_clades(spark, sf):
    c = trees.clade_sizes(d.tree(spark, sf))
    return c.select("node", "leaves", "descendants", F.round("subtree_length", 6).alias("subtree_length"), F.round("height", 6).alias("height"))


@query("tree_common_ancestors", _UP + ", p AS (SELECT a.node AS a, b.node AS b FROM t a JOIN t b ON a.node >= 1000 AND b.node >= 1000 AND b.node = a.node + 7) SELECT a, b, x.anc AS lca, round(x.distance + y.distance, 6) AS distance FROM p JOIN up x ON x.node = a JOIN up y ON y.node = b AND y.anc = x.anc QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY x.levels) = 1")
def tree_common_ancestors(spark, sf):
    t = d.tree(spark, sf)
    n = t.filter("node >= 1000").select("node")
    pairs = n.select(F.col("node").alias("a"), (F.col("node") + 7).alias("b")).join(n.select(F.col("node").alias("b")), "b")
    return trees.lowest_common(t, pairs).withColumn("distance", F.round("distance", 6))


@query("tree_monophyly", _UP + """, g AS (SELECT node, label[1:1] || CAST(node % 2 AS VARCHAR) AS trait, parent FROM t WHERE node >= 1000), z AS (SELECT node, CAST(parent AS VARCHAR) AS trait FROM g UNION ALL SELECT node, trait FROM g), k AS (SELECT trait, count(*) AS total FROM z GROUP BY trait),
lf AS (SELECT anc, count(*) AS size FROM up WHERE node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL) GROUP BY anc), h AS (SELECT trait, anc, count(*) AS held FROM z JOIN up USING (node) GROUP BY trait, anc)
SELECT trait, bool_or(held = total AND size = total) AS monophyletic FROM h JOIN k USING (trait) JOIN lf USING (anc) GROUP BY trait""")
def tree_monophyly(spark, sf):
    t = d.tree(spark, sf)
    g = t.filter("node >= 1000")
    one = g.select("node", F.col("parent").cast("string").alias("trait"))
    two = g.select("node", F.concat(F.substring("label", 1, 1), (F.col("node") % 2).cast("string")).alias("trait"))
    return trees.monophyletic(t, one.union(two))


@query("tree_shape", f"WITH t AS {d.TREE_SQL}, c AS (SELECT parent AS node, count(*) AS children, count(*) FILTER (node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)) AS tips FROM t WHERE parent IS NOT NULL GROUP BY parent) SELECT (SELECT max(children) <= 2 FROM c) AS binary, (SELECT count(*) FROM c WHERE children = 2 AND tips = 2) AS cherries")
def tree_shape(spark, sf):
    t = d.tree(spark, sf)
    return trees.is_binary(t).crossJoin(trees.cherries(t).agg(F.count(F.lit(1)).alias("cherries")))
