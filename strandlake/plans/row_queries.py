"""Queries on alignment rows, profiles, hierarchies, labels and filters, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import ids, seqfn
from strandlake.operators import alignment, hierarchy, hits, matrix, otu, profile, restriction, rows
from strandlake.plans import derived as d
from strandlake.sources import features

QUERIES, ORACLES = {}, {}
SUP, GAPPED = d.sequences_sql("supplier"), d.gapped_sql("supplier")
GCOLS = d.columns_sql(GAPPED)
PLACED = f"(SELECT *, row_number() OVER (ORDER BY ord) AS place FROM {GAPPED})"
#: The row that the others are set against.
REFERENCE = "0000000007"
RESIDUES = "regexp_replace(seq, '[-\\s]', '', 'g')"


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


def _rows(spark, sf):
    return d.gapped(spark, sf, "supplier").select("ord", "id", "seq")


def _columns(spark, sf):
    return d.columns(d.gapped(spark, sf, "supplier"))


# Rows of an alignment.
@query("rows_alphabetical", f"SELECT id, row_number() OVER (ORDER BY id) AS place FROM {GAPPED}")
def rows_alphabetical(spark, sf):
    return rows.placed(_rows(spark, sf), "id").select("id", "place")


@query("rows_by_list", f"SELECT id, place FROM {GAPPED} JOIN (SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS id, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS place FROM supplier WHERE s_acctbal > 0) USING (id)")
def rows_by_list(spark, sf):
    s = d.table(spark, sf, "supplier").filter("s_acctbal > 0")
    listed = rows.placed(s.select(F.struct("s_acctbal", "s_suppkey").alias("ord"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("id")))
    return rows.by_list(_rows(spark, sf), listed).select("id", "place")


@query("rows_reference_first", f"SELECT id, row_number() OVER (ORDER BY id <> '{REFERENCE}', ord) AS place FROM {GAPPED}")
def rows_reference_first(spark, sf):
    return rows.reference_first(_rows(spark, sf), REFERENCE).select("id", "place")


@query("rows_selected", f"SELECT id, place, 'range' AS how FROM {PLACED} WHERE place BETWEEN 3 AND 9 UNION ALL SELECT id, place, 'list' FROM {PLACED} WHERE place IN (2, 5, 8)")
def rows_selected(spark, sf):
    both = rows.at_places(_rows(spark, sf), 3, 9).withColumn("how", F.lit("range")).unionByName(rows.at_listed_places(_rows(spark, sf), [2, 5, 8]).withColumn("how", F.lit("list")))
    return both.select("id", "place", "how")


@query("rows_with_id", f"SELECT id, seq FROM {GAPPED} WHERE id = '{REFERENCE}'")
def rows_with_id(spark, sf):
    return rows.with_id(_rows(spark, sf), REFERENCE).select("id", "seq")


@query("rows_removed", f"SELECT id FROM {GAPPED} WHERE id NOT IN (SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') FROM supplier WHERE s_acctbal < 0)")
def rows_removed(spark, sf):
    gone = d.table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("id"))
    return rows.without_ids(_rows(spark, sf), gone).select("id")


@query("alignment_slice", f"SELECT id, substr(seq, 1, 3) AS seq FROM {GAPPED} WHERE regexp_matches(substr(seq, 1, 3), '[^-]')")
def alignment_slice(spark, sf):
    return rows.sliced(_rows(spark, sf), 1, 3).select("id", "seq")


@query("masked_columns", f"SELECT id, concat(substr(seq, 1, 9), regexp_replace(substr(seq, 10, 11), '[^-]', '?', 'g'), substr(seq, 21)) AS seq FROM {GAPPED}")
def masked_columns(spark, sf):
    return rows.masked(_rows(spark, sf), 10, 20).select("id", "seq")


@query("mapped_characters", f"SELECT id, regexp_replace(seq, '[-N]', '.', 'g') AS seq, upper(lower(seq)) AS upper_seq, replace(seq, '-', '*') AS starred FROM {GAPPED}")
def mapped_characters(spark, sf):
    found = _rows(spark, sf).withColumns({"upper_seq": F.upper(F.lower("seq")), "starred": seqfn.gap_to_star(F.col("seq"))})
    return rows.mapped(found, "[-N]", ".").select("id", "seq", "upper_seq", "starred")


@query("undotted_alignment", f"SELECT id, seq FROM {GAPPED}")
def undotted_alignment(spark, sf):
    """Dots for what equals the reference row, and back: the rows as they were."""
    return rows.undotted(alignment.against_reference(_rows(spark, sf), REFERENCE), REFERENCE).select("id", "seq")


@query("alignment_facts", f"SELECT count(*) AS n_sequences, CAST(max(length(seq)) AS BIGINT) AS length, min(length(seq)) = max(length(seq)) AS is_flush, CAST(sum(length({RESIDUES})) AS BIGINT) AS n_residues, CAST(max(length(id)) AS BIGINT) AS longest_id FROM {GAPPED}")
def alignment_facts(spark, sf):
    return rows.facts(_rows(spark, sf))


_KINDS = f"(SELECT pos, count(DISTINCT base) AS k, bool_or(base = '-') AS gap FROM {GCOLS} GROUP BY pos)"


@query("columns_by_kind", f"SELECT 'match' AS kind, pos FROM {_KINDS} WHERE NOT (k = 1 AND NOT gap) UNION ALL SELECT 'mismatch', pos FROM {_KINDS} WHERE NOT (k > 1 AND NOT gap) UNION ALL SELECT 'gaps', pos FROM {_KINDS} WHERE NOT gap UNION ALL SELECT 'all_gaps', pos FROM {_KINDS} WHERE NOT (k = 1 AND gap)")
def columns_by_kind(spark, sf):
    """The columns that are left when those of a kind are removed."""
    c, out = _columns(spark, sf), None
    for kind in ("match", "mismatch", "gaps", "all_gaps"):
        left = rows.without_columns(c, kind).select(F.lit(kind).alias("kind"), "pos").distinct()
        out = left if out is None else out.unionByName(left)
    return out


@query("columns_of_reference", f"SELECT id, pos, base FROM {GCOLS} WHERE pos IN (SELECT pos FROM {GCOLS} WHERE id = '{REFERENCE}' AND base <> '-')")
def columns_of_reference(spark, sf):
    return rows.without_gaps_of(_columns(spark, sf), REFERENCE).select("id", "pos", "base")


@query("gap_matrix", f"SELECT id, pos, base = '-' AS gap FROM {GCOLS}")
def gap_matrix(spark, sf):
    return rows.gap_matrix(_columns(spark, sf))


@query("codon_index", f"SELECT id, pos, CAST(floor((k - 1) / 3) + 1 AS BIGINT) AS codon FROM (SELECT id, pos, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM {GCOLS} WHERE base <> '-')")
def codon_index(spark, sf):
    return rows.codon_index(_columns(spark, sf))


# Position-specific matrices.
_MATRIX = f"(SELECT pos, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t FROM {GCOLS} GROUP BY pos)"
_LOG = "log2(({0} + 0.25) / (a + c + g + t + 1.0) / 0.25)"


@query("profile_weights", f"SELECT pos, {', '.join(f'round({_LOG.format(b)}, 6) AS {b}' for b in 'acgt')} FROM {_MATRIX}")
def profile_weights(spark, sf):
    found = profile.weights(profile.counts(_columns(spark, sf)))
    return found.select("pos", *(F.round(b, 6).alias(b) for b in "acgt"))


_PART = "CASE WHEN {0} > 0 THEN {0} / (a + c + g + t) * log2({0} / (a + c + g + t)) ELSE 0 END"


@query("profile_information", f"SELECT pos, CASE WHEN a + c + g + t > 0 THEN round(2 + {' + '.join(_PART.format(b) for b in 'acgt')}, 6) END AS bits FROM {_MATRIX}")
def profile_information(spark, sf):
    return profile.information(profile.counts(_columns(spark, sf))).select("pos", F.round("bits", 6).alias("bits"))


_SEEN = "concat(CASE WHEN a > 0 THEN 'A' ELSE '' END, CASE WHEN c > 0 THEN 'C' ELSE '' END, CASE WHEN g > 0 THEN 'G' ELSE '' END, CASE WHEN t > 0 THEN 'T' ELSE '' END)"
_CODE = "CASE b " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in seqfn.IUPAC.items()) + " ELSE 'N' END"


@query("profile_pattern", f"SELECT pos, {_CODE} AS code, CASE length(b) WHEN 0 THEN '.' WHEN 1 THEN b ELSE '[' || b || ']' END AS regexp FROM (SELECT pos, {_SEEN} AS b FROM {_MATRIX})")
def profile_pattern(spark, sf):
    return profile.pattern(profile.counts(_columns(spark, sf)))


@query("profile_scores", f"SELECT x.id, round(sum(CASE base WHEN 'A' THEN {_LOG.format('a')} WHEN 'C' THEN {_LOG.format('c')} WHEN 'G' THEN {_LOG.format('g')} WHEN 'T' THEN {_LOG.format('t')} ELSE 0 END), 5) AS score FROM {GCOLS} x JOIN {_MATRIX} USING (pos) GROUP BY x.id")
def profile_scores(spark, sf):
    c = _columns(spark, sf)
    return profile.scores(c, profile.weights(profile.counts(c))).select("id", F.round("score", 5).alias("score"))


# Terms and taxa.
_UP = f"WITH RECURSIVE t AS MATERIALIZED {d.TREE_SQL}, up(node, anc, levels) AS (SELECT node, node, 0 FROM t UNION ALL SELECT up.node, t.parent, levels + 1 FROM up JOIN t ON up.anc = t.node WHERE t.parent IS NOT NULL)"


@query("child_terms", f"SELECT parent AS term, node AS child FROM {d.TREE_SQL} WHERE parent IS NOT NULL")
def child_terms(spark, sf):
    return hierarchy.child_terms(d.tree(spark, sf))


@query("ancestor_terms", f"{_UP} SELECT node AS term, anc AS ancestor, levels FROM up WHERE levels > 0")
def ancestor_terms(spark, sf):
    return hierarchy.ancestor_terms(d.tree(spark, sf))


@query("descendant_terms", f"{_UP} SELECT anc AS term, node AS descendant, levels FROM up WHERE levels > 0")
def descendant_terms(spark, sf):
    return hierarchy.descendant_terms(d.tree(spark, sf))


@query("root_and_leaf_terms", f"WITH t AS {d.TREE_SQL} SELECT 'root' AS kind, node AS term FROM t WHERE parent IS NULL UNION ALL SELECT 'leaf', node FROM t WHERE node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)")
def root_and_leaf_terms(spark, sf):
    t = d.tree(spark, sf)
    return hierarchy.root_terms(t).select(F.lit("root").alias("kind"), "term").unionByName(hierarchy.leaf_terms(t).select(F.lit("leaf").alias("kind"), "term"))


@query("found_terms", f"SELECT node AS term, label FROM {d.TREE_SQL} WHERE contains(lower(label), 'an')")
def found_terms(spark, sf):
    return hierarchy.find_terms(d.tree(spark, sf), "AN")


@query("taxon_lineages", f"{_UP} SELECT up.node AS term, string_agg(t.label, ';' ORDER BY levels DESC) AS lineage FROM up JOIN t ON up.anc = t.node GROUP BY up.node")
def taxon_lineages(spark, sf):
    return hierarchy.lineages(d.tree(spark, sf))


# Functions of sequences and identifiers.
_ALPHABETS = ("structural", "functional", "dayhoff", "sneath", "stanfel")
_PROTEIN = f"(SELECT id, translate({RESIDUES}, 'ACGTN', 'KWDSM') AS p FROM {GAPPED})"


@query("reduced_alphabets", f"SELECT id, {', '.join(f'''translate(p, '{a}', '{b}') AS {n}''' for n in _ALPHABETS for a, b in [seqfn.REDUCED[n]])} FROM {_PROTEIN}")
def reduced_alphabets(spark, sf):
    found = _rows(spark, sf).select("id", F.translate(seqfn.degapped(F.col("seq")), "ACGTN", "KWDSM").alias("p"))
    return found.select("id", *(seqfn.reduced_alphabet(F.col("p"), n).alias(n) for n in _ALPHABETS))


_AMBIGUOUS = f"(SELECT id, translate(substr(seq, 20, 6), 'AC', 'RY') AS s FROM {SUP})"
_CHOICES = "CASE substr(s, {0}, 1) WHEN 'R' THEN ['A', 'G'] WHEN 'Y' THEN ['C', 'T'] ELSE [substr(s, {0}, 1)] END"


@query("ambiguity_counts", f"SELECT id, CAST(1 << (length(s) - length(regexp_replace(s, '[RY]', '', 'g'))) AS BIGINT) AS n FROM {_AMBIGUOUS}")
def ambiguity_counts(spark, sf):
    s = d.sequences(spark, sf, "supplier").select("id", F.translate(F.substring("seq", 20, 6), "AC", "RY").alias("s"))
    return s.select("id", seqfn.expansion_count(F.col("s")).alias("n"))


@query("ambiguity_expansions", "WITH e0 AS (SELECT id, s, '' AS made FROM " + _AMBIGUOUS + ")" + "".join(f", e{k} AS (SELECT id, s, made || unnest({_CHOICES.format(k)}) AS made FROM e{k - 1})" for k in range(1, 7)) + " SELECT id, made AS seq FROM e6")
def ambiguity_expansions(spark, sf):
    s = d.sequences(spark, sf, "supplier").select("id", F.translate(F.substring("seq", 20, 6), "AC", "RY").alias("s"))
    return s.select("id", F.explode(seqfn.expansions(F.col("s"))).alias("seq"))


_TRIPLETS = f"(SELECT DISTINCT substr(seq, CAST(i AS INT), 3) AS codon FROM (SELECT seq, unnest(range(1, 62)) AS i FROM {SUP}))"


@query("codon_roles", f"SELECT codon, codon IN ('TTG', 'CTG', 'ATG') AS may_start, codon IN ('TAA', 'TAG', 'TGA') AS stops FROM {_TRIPLETS}")
def codon_roles(spark, sf):
    codons = d.sequences(spark, sf, "supplier").select(F.explode(seqfn.windows(F.col("seq"), 3, 1)).alias("w")).select(F.col("w.text").alias("codon")).distinct()
    return codons.select("codon", F.col("codon").isin(*seqfn.STARTS).alias("may_start"), F.col("codon").isin(*seqfn.STOPS).alias("stops"))


@query("three_letters_back", f"SELECT id, p AS letters FROM {_PROTEIN}")
def three_letters_back(spark, sf):
    """Residues to their three-letter names, and back."""
    p = _rows(spark, sf).select("id", F.translate(seqfn.degapped(F.col("seq")), "ACGTN", "KWDSM").alias("p"))
    return p.select("id", seqfn.one_letters(seqfn.three_letters(F.col("p"))).alias("letters"))


@query("reordered_fields", f"SELECT ord, array_to_string(list_filter([string_split(id, '|')[3], string_split(id, '|')[1], string_split(id, '|')[2]], lambda x: x IS NOT NULL), '_') AS label, id || '|' || CAST(ord % 10 AS VARCHAR) AS tagged FROM {d.IDENTIFIERS_SQL}")
def reordered_fields(spark, sf):
    i = d.identifiers(spark, sf)
    return i.select("ord", ids.field_order(F.col("id"), (3, 1, 2)).alias("label"), ids.with_cluster(F.col("id"), F.col("ord") % 10).alias("tagged"))


@query("fasta_cells", f"SELECT ord, '>' || name || '_' || id || '$' || seq AS cell FROM {SUP}")
def fasta_cells(spark, sf):
    return d.sequences(spark, sf, "supplier").select("ord", ids.fasta_cell(F.col("name"), F.col("id"), F.col("seq")).alias("cell"))


@query("text_of_pages", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS text FROM pages")
def text_of_pages(spark, sf):
    return d.table(spark, sf, "pages").select("page_id", ids.without_tags(F.col("html")).alias("text"))


# Filters, hits and clusters.
@query("length_filters", f"SELECT id, length({RESIDUES}) >= 60 AS long_enough, length(regexp_replace(seq, '[nN]', '', 'g')) BETWEEN 50 AND 63 AS in_window, length(seq) >= 64 AS whole, length({RESIDUES}) > 10 AS readable FROM {GAPPED}")
def length_filters(spark, sf):
    size, plain = seqfn.degapped_length(F.col("seq")), seqfn.cleaned_length(F.col("seq"))
    return _rows(spark, sf).select("id", (size >= 60).alias("long_enough"), plain.between(50, 63).alias("in_window"), (F.length("seq") >= 64).alias("whole"), (size > 10).alias("readable"))


@query("hit_fractions", f"SELECT qseqid, sseqid, sstart, round((length - mismatch) / length, 6) AS frac_identical, CAST(length - mismatch AS BIGINT) AS matches, round(100.0 * (length - mismatch) / length, 6) AS percent_identity, length >= 60 - 60 * 0.3 AS long_enough FROM {d.HITS_SQL}")
def hit_fractions(spark, sf):
    found = hits.fractions(d.hits(spark, sf), 60)
    return found.select("qseqid", "sseqid", "sstart", F.round("frac_identical", 6).alias("frac_identical"), "matches", F.round("percent_identity", 6).alias("percent_identity"), "long_enough")


@query("hit_totals", f"SELECT qseqid, sseqid, count(*) AS hsps, CAST(sum(length) AS BIGINT) AS logical_length, CAST(sum(length - mismatch) AS BIGINT) AS matches, max(bitscore) AS best FROM {d.HITS_SQL} GROUP BY qseqid, sseqid")
def hit_totals(spark, sf):
    return hits.totals(d.hits(spark, sf))


@query("names_used_once", f"SELECT count(*) FILTER (k = 1) / count(*) AS used_once FROM (SELECT name, count(DISTINCT ord % 7) AS k FROM {SUP} GROUP BY name)")
def names_used_once(spark, sf):
    return otu.used_once(d.sequences(spark, sf, "supplier").withColumn("otu", F.col("ord") % 7))


_STEPS = "(SELECT CAST(n_regionkey AS BIGINT) AS otu, CAST(n_nationkey % 4 AS BIGINT) AS round, count(*) AS added FROM nation GROUP BY 1, 2)"


@query("link_strengths", f"WITH s AS {_STEPS}, a AS (SELECT otu, sum(added) AS n FROM s GROUP BY otu), k AS (SELECT *, row_number() OVER (PARTITION BY otu ORDER BY round DESC) AS e FROM s) SELECT otu, string_agg(CAST(CAST(round(100.0 * added / n) AS INT) AS VARCHAR), '_' ORDER BY k.round) AS strength FROM k JOIN a USING (otu) WHERE e > 1 GROUP BY otu")
def link_strengths(spark, sf):
    n = d.table(spark, sf, "nation")
    steps = n.groupBy(F.col("n_regionkey").cast("long").alias("otu"), (F.col("n_nationkey") % 4).cast("long").alias("round")).agg(F.count(F.lit(1)).alias("added"))
    return otu.link_strength(steps, steps.groupBy("otu").agg(F.sum("added").alias("abundance")))


@query("within_and_between_names", f"SELECT a.name = b.name AS within, count(*) AS pairs FROM {SUP} a JOIN {SUP} b ON a.grp = b.grp AND a.id < b.id WHERE a.seq <> b.seq GROUP BY 1")
def within_and_between_names(spark, sf):
    """Pairs of different sequences in a group, by whether their names agree."""
    s = d.sequences(spark, sf, "supplier")
    left, right = s.select("grp", F.col("id").alias("id1"), F.col("name").alias("n1"), F.col("seq").alias("s1")), s.select("grp", F.col("id").alias("id2"), F.col("name").alias("n2"), F.col("seq").alias("s2"))
    pairs = left.join(right, "grp").filter("id1 < id2 AND s1 <> s2")
    return pairs.groupBy((F.col("n1") == F.col("n2")).alias("within")).agg(F.count(F.lit(1)).alias("pairs"))


@query("last_file_of_accession", "SELECT o_custkey AS accession, arg_max(o_orderpriority, o_orderkey) AS file FROM orders GROUP BY o_custkey")
def last_file_of_accession(spark, sf):
    return d.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("accession")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("file"))


@query("references_in_front", f"SELECT id, seq, true AS reference FROM {SUP} WHERE ord <= 3 UNION ALL SELECT id, seq, false FROM {GAPPED}")
def references_in_front(spark, sf):
    ref = d.sequences(spark, sf, "supplier").filter("ord <= 3").select("id", "seq", F.lit(True).alias("reference"))
    return ref.unionByName(_rows(spark, sf).select("id", "seq", F.lit(False).alias("reference")))


# Matrices, digests and feature lines.
_CELLS = "(SELECT CAST(o_orderkey % 5 AS BIGINT) AS row, CAST(o_custkey % 5 AS BIGINT) AS col, count(*) AS value FROM orders GROUP BY 1, 2)"


def _cells(spark, sf):
    o = d.table(spark, sf, "orders")
    return o.groupBy((F.col("o_orderkey") % 5).cast("long").alias("row"), (F.col("o_custkey") % 5).cast("long").alias("col")).agg(F.count(F.lit(1)).alias("value"))


@query("matrix_parts", f"WITH m AS {_CELLS} SELECT 'row' AS part, col AS at, value FROM m WHERE row = 2 UNION ALL SELECT 'column', row, value FROM m WHERE col = 3 UNION ALL SELECT 'diagonal', row, value FROM m WHERE row = col UNION ALL SELECT 'entry', row, value FROM m WHERE row = 1 AND col = 4")
def matrix_parts(spark, sf):
    m = _cells(spark, sf)
    parts = {"row": matrix.row(m, 2).select(F.col("col").alias("at"), "value"), "column": matrix.column(m, 3).select(F.col("row").alias("at"), "value"), "diagonal": matrix.diagonal(m), "entry": matrix.entry(m, 1, 4).select(F.col("row").alias("at"), "value")}
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("part"), "at", "value")
        out = part if out is None else out.unionByName(part)
    return out


@query("matrix_edited", f"WITH m AS {_CELLS} SELECT * FROM m WHERE row <> 0 AND col <> 1 UNION ALL SELECT 9, col, CAST(sum(value) AS BIGINT) FROM m WHERE row <> 0 AND col <> 1 GROUP BY col")
def matrix_edited(spark, sf):
    """Without a row and a column, and with a row of sums."""
    m = matrix.without_column(matrix.without_row(_cells(spark, sf), 0), 1)
    total = m.groupBy("col").agg(F.sum("value").alias("value")).select(F.lit(9).cast("long").alias("row"), "col", "value")
    return matrix.with_cells(m, total)


_ENZYMES = [("four", "GATC", 0), ("six", "GAATTC", 1), ("three", "CAG", 2), ("never", "AAAAAAAAAA", 5)]
_ENZYMES_SQL = "(VALUES " + ", ".join(f"('{n}', '{s}', {c})" for n, s, c in _ENZYMES) + ") e(enzyme, site, cut)"
_CUTS = f"(SELECT id, enzyme, CAST(i + cut - 1 AS BIGINT) AS position FROM (SELECT id, seq, unnest(range(1, 65)) AS i FROM {SUP}), {_ENZYMES_SQL} WHERE substr(seq, CAST(i AS INT), length(site)) = site)"


@query("restriction_cuts", f"SELECT id, enzyme, position FROM {_CUTS}")
def restriction_cuts(spark, sf):
    return restriction.cut_positions(d.sequences(spark, sf, "supplier"), _ENZYMES, both_strands=False)


_COUNTS = f"(SELECT s.id, e.enzyme, count(c.position) AS cuts FROM {SUP} s CROSS JOIN {_ENZYMES_SQL} LEFT JOIN {_CUTS} c ON c.id = s.id AND c.enzyme = e.enzyme GROUP BY s.id, e.enzyme)"
_LIST = "coalesce(string_agg(enzyme, ',' ORDER BY enzyme) FILTER (cuts {0}), '') AS {1}"


@query("restriction_cutters", f"SELECT id, {_LIST.format('> 0', 'cutters')}, {_LIST.format('= 1', 'unique_cutters')}, {_LIST.format('= 0', 'zero_cutters')}, max(cuts) AS max_cuts FROM {_COUNTS} GROUP BY id")
def restriction_cutters(spark, sf):
    found = restriction.cutters(restriction.cuts_by_enzyme(d.sequences(spark, sf, "supplier"), _ENZYMES, both_strands=False))
    return found.select("id", *(F.array_join(c, ",").alias(c) for c in ("cutters", "unique_cutters", "zero_cutters")), "max_cuts")


@query("restriction_digest", f'WITH p AS (SELECT DISTINCT id, position FROM {_CUTS} UNION SELECT id, length(seq) FROM {SUP}), f AS (SELECT id, lag(position, 1, 0) OVER (PARTITION BY id ORDER BY position) + 1 AS start, position AS "end" FROM p) SELECT id, start, "end", "end" - start + 1 AS size FROM f WHERE start <= "end"')
def restriction_digest(spark, sf):
    return restriction.fragments(d.sequences(spark, sf, "supplier"), _ENZYMES, both_strands=False)


_FEATURES = f'(SELECT seq_id, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", CAST(id AS VARCHAR) AS name, CAST(id % 100 AS DOUBLE) AS score, strand FROM {d.RANGES_SQL})'


def _features(spark, sf):
    r = d.ranges(spark, sf)
    return r.select("seq_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("id").cast("string").alias("name"), (F.col("id") % 100).cast("double").alias("score"), "strand")


@query("bed_round_trip", f'SELECT seq_id, start, "end", name, score, strand FROM {_FEATURES}')
def bed_round_trip(spark, sf):
    """Features as BED lines, and read back."""
    return features.parse_bed(features.bed_lines(_features(spark, sf)))


@query("gtf_round_trip", f"""SELECT seq_id, 'exon' AS type, start, "end", name, score, strand FROM {_FEATURES}""")
def gtf_round_trip(spark, sf):
    return features.parse_gtf(features.gtf_lines(_features(spark, sf).withColumn("type", F.lit("exon")))).drop("attributes")


@query("psl_alignments", "SELECT CAST(l_quantity AS BIGINT) AS matches, CAST(l_linenumber AS BIGINT) AS mismatches, CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS strand, CAST(l_orderkey AS VARCHAR) AS qseqid, CAST(l_linenumber AS BIGINT) + 1 AS qstart, CAST(l_quantity AS BIGINT) + 10 AS qend, 's' || l_suppkey AS sseqid, CAST(l_partkey AS BIGINT) + 1 AS sstart, CAST(l_partkey AS BIGINT) + 60 AS send FROM lineitem")
def psl_alignments(spark, sf):
    """Line items as PSL lines, read."""
    n, text = d.table(spark, sf, "lineitem"), lambda c: c.cast("long").cast("string")
    zero, size = F.lit("0"), F.lit("100")
    sign = F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise("+")
    query_cells = (F.col("l_orderkey").cast("string"), size, text(F.col("l_linenumber")), text(F.col("l_quantity") + 10))
    subject_cells = (F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), size, text(F.col("l_partkey")), text(F.col("l_partkey") + 60))
    lines = n.select(F.concat_ws("\t", text(F.col("l_quantity")), text(F.col("l_linenumber")), *[zero] * 6, sign, *query_cells, *subject_cells, F.lit("1")).alias("value"))
    return features.parse_psl(lines)


# The genetic code by residue, joined sequences, members of clusters.
@query("codons_of_residues", "SELECT residue, string_agg(codon, ',' ORDER BY codon) AS codons, count(*) AS n FROM (VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in seqfn.genetic_code().items() if c != "---") + ") t(codon, residue) GROUP BY residue")
def codons_of_residues(spark, sf):
    table = spark.createDataFrame([(c, a) for c, a in seqfn.genetic_code().items() if c != "---"], "codon string, residue string")
    return table.groupBy("residue").agg(F.array_join(F.array_sort(F.collect_list("codon")), ",").alias("codons"), F.count(F.lit(1)).alias("n"))


@query("joined_sequences", f"SELECT grp, string_agg(seq, '' ORDER BY ord) AS seq, CAST(sum(length(seq)) AS BIGINT) AS length FROM {SUP} GROUP BY grp")
def joined_sequences(spark, sf):
    parts = F.array_sort(F.collect_list(F.struct("ord", "seq")))
    found = d.sequences(spark, sf, "supplier").groupBy("grp").agg(F.array_join(F.transform(parts, lambda x: x["seq"]), "").alias("seq"))
    return found.withColumn("length", F.length("seq").cast("long"))


@query("cluster_members", f"SELECT grp AS family, string_agg(id, ',' ORDER BY id) AS members, count(*) AS size FROM {SUP} GROUP BY grp")
def cluster_members(spark, sf):
    members = F.array_join(F.array_sort(F.collect_list("id")), ",")
    return d.sequences(spark, sf, "supplier").groupBy(F.col("grp").alias("family")).agg(members.alias("members"), F.count(F.lit(1)).alias("size"))
