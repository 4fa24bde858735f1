"""Queries on single sequences and identifiers, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import ids, seqfn
from strandlake.operators import ranges
from strandlake.plans import derived as d

QUERIES, ORACLES = {}, {}
SEQ, GAPPED = d.sequences_sql(), d.gapped_sql()


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _codon_case(column: str) -> str:
    pairs = [(c, a) for c, a in seqfn.genetic_code().items()]
    return f"CASE {column} " + " ".join(f"WHEN '{c}' THEN '{a}'" for c, a in pairs) + " ELSE '?' END"


def _translate_sql(seq: str, frame: int) -> str:
    return f"coalesce(list_reduce(list_transform(range({frame}, length({seq}) + 1, 3), lambda i: {_codon_case(f'substr({seq}, CAST(i AS INT), 3)')}), lambda x, y: x || y), '')"


REV = "translate(reverse(regexp_replace(seq, '[^ACGT-]', '', 'g')), 'ACGT', 'TGCA')"


@query("degapped_length", f"SELECT id, CAST(length(regexp_replace(seq, '[-\\s]', '', 'g')) AS BIGINT) AS n FROM {GAPPED}")
def degapped_length(spark, sf):
    return d.gapped(spark, sf).select("id", seqfn.degapped_length(F.col("seq")).alias("n"))


@query("ambiguity_mask", f"SELECT id, translate(seq, 'NRYKMSWBDH', '----------') AS masked, regexp_replace(seq, '-+$', '') AS trimmed FROM {GAPPED}")
def ambiguity_mask(spark, sf):
    return d.gapped(spark, sf).select("id", seqfn.mask_ambiguous(F.col("seq")).alias("masked"), seqfn.trim_trailing_gaps(F.col("seq")).alias("trimmed"))


@query("reverse_complement", f"SELECT id, {REV} AS rc, translate(reverse(seq), 'ACGTRYKMBDHVSWN', 'TGCAYRMKVHDBSWN') AS rc_full FROM {GAPPED}")
def reverse_complement(spark, sf):
    return d.gapped(spark, sf).select("id", seqfn.reverse_complement(F.col("seq")).alias("rc"), seqfn.reverse_complement(F.col("seq"), True).alias("rc_full"))


@query("translate_frames", f"SELECT id, {', '.join(f'{_translate_sql("seq", k)} AS frame{k}' for k in (1, 2, 3))} FROM {SEQ}")
def translate_frames(spark, sf):
    return d.sequences(spark, sf).select("id", *(seqfn.translate(F.col("seq"), k).alias(f"frame{k}") for k in (1, 2, 3)))


_SIX = " UNION ALL ".join(f"SELECT id, {k} AS at_, {f} AS frame, {_translate_sql(s, abs(f))} AS protein FROM r" for k, (f, s) in enumerate([(1, "seq"), (2, "seq"), (3, "seq"), (-1, "rc"), (-2, "rc"), (-3, "rc")]))


@query("best_frame", f"WITH r AS (SELECT id, seq, {REV} AS rc FROM {SEQ}), six AS ({_SIX}), s AS (SELECT *, length(protein) - length(replace(protein, '*', '')) AS stops FROM six) SELECT id, CAST(frame AS INT) AS frame, CAST(stops AS INT) AS stops, protein FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY stops, at_) = 1")
def best_frame(spark, sf):
    return d.sequences(spark, sf).select("id", seqfn.best_frame(F.col("seq")).alias("b")).select("id", "b.frame", "b.stops", "b.protein")


@query("open_reading_frames", f"WITH p AS (SELECT id, {_translate_sql('seq', 1)} AS protein FROM {SEQ}) SELECT id, orf, CAST(length(orf) AS INT) AS n FROM (SELECT id, unnest(regexp_extract_all(protein, 'M[^*]*[*]')) AS orf FROM p) WHERE length(orf) >= 3")
def open_reading_frames(spark, sf):
    rows = d.sequences(spark, sf).select("id", F.explode(seqfn.open_reading_frames(seqfn.translate(F.col("seq")), 3)).alias("orf"))
    return rows.select("id", "orf", F.length("orf").alias("n"))


def _clean_sql(k: int) -> str:
    return f"len(list_filter(range(1, length('{'-' * k}' || seq) + 1, 3), lambda i: substr('{'-' * k}' || seq, CAST(i AS INT), 3) IN ('TAA', 'TAG'))) = 0"


@query("reading_frame_repair", f"SELECT id, CAST(CASE WHEN {_clean_sql(0)} THEN 0 WHEN {_clean_sql(1)} THEN 1 WHEN {_clean_sql(2)} THEN 2 ELSE 3 END AS INT) AS shift FROM {SEQ}")
def reading_frame_repair(spark, sf):
    return d.sequences(spark, sf).select("id", seqfn.frame_shift(F.col("seq")).alias("shift"))


@query("back_translation", f"SELECT id, substr(seq, 1, 6) || '---' || substr(seq, 7, 9) AS dna FROM {SEQ}")
def back_translation(spark, sf):
    return d.sequences(spark, sf).select("id", seqfn.back_translate(F.lit("MK-LVA"), F.col("seq")).alias("dna"))


@query("base_counts", f"SELECT base, count(*) AS n, count(DISTINCT id) AS ids FROM {d.columns_sql(GAPPED)} GROUP BY base")
def base_counts(spark, sf):
    return d.columns(d.gapped(spark, sf)).groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query("gc_content", f"SELECT id, round((length(p) - length(replace(replace(p, 'G', ''), 'C', ''))) / length(p), 6) AS gc FROM (SELECT id, regexp_replace(seq, '[-\\s]', '', 'g') AS p FROM {GAPPED})")
def gc_content(spark, sf):
    return d.gapped(spark, sf).select("id", F.round(seqfn.gc_content(F.col("seq")), 6).alias("gc"))


@query("kmers_overlapping", f"SELECT kmer, count(*) AS n FROM (SELECT substr(seq, CAST(unnest(range(1, length(seq) - 2)) AS INT), 4) AS kmer FROM {SEQ}) GROUP BY kmer")
def kmers_overlapping(spark, sf):
    rows = d.sequences(spark, sf).select(F.explode(seqfn.windows(F.col("seq"), 4, 1)).alias("w"))
    return rows.groupBy(F.col("w.text").alias("kmer")).agg(F.count(F.lit(1)).alias("n"))


@query("kmers_apart", f"SELECT kmer, count(*) AS n FROM (SELECT substr(seq, CAST(unnest(range(1, length(seq) - 2, 4)) AS INT), 4) AS kmer FROM {SEQ}) GROUP BY kmer")
def kmers_apart(spark, sf):
    rows = d.sequences(spark, sf).select(F.explode(seqfn.windows(F.col("seq"), 4, 4)).alias("w"))
    return rows.groupBy(F.col("w.text").alias("kmer")).agg(F.count(F.lit(1)).alias("n"))


@query("sliding_windows", f"SELECT id, CAST(i AS INT) AS start, substr(seq, CAST(i AS INT), 16) AS text FROM (SELECT id, seq, unnest(range(1, length(seq) - 14, 12)) AS i FROM {SEQ})")
def sliding_windows(spark, sf):
    return d.sequences(spark, sf).select("id", F.explode(seqfn.windows(F.col("seq"), 16, 12)).alias("w")).select("id", "w.start", "w.text")


@query("codon_usage", f"SELECT codon, aa, n, round(n / sum(n) OVER (PARTITION BY aa), 6) AS relative, round(100 * n / sum(n) OVER (), 6) AS percent FROM (SELECT codon, {_codon_case('codon')} AS aa, count(*) AS n FROM (SELECT substr(seq, CAST(unnest(range(1, 62, 3)) AS INT), 3) AS codon FROM {SEQ}) GROUP BY codon)")
def codon_usage(spark, sf):
    from pyspark.sql import Window

    n = d.sequences(spark, sf).select(F.explode(seqfn.codons(F.col("seq"))).alias("codon")).filter("length(codon) = 3").groupBy("codon").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("aa", seqfn.lookup(seqfn.genetic_code(), F.col("codon"), "?"))
    return n.select("codon", "aa", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("aa")), 6).alias("relative"), F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("percent"))


@query("splice", f"SELECT id, substr(seq, 5, 20) AS part FROM {SEQ}")
def splice(spark, sf):
    return d.sequences(spark, sf).select("id", seqfn.splice(F.col("seq"), 5, 24).alias("part"))


_PROTEIN = f"(SELECT id, {_translate_sql('seq', 1)} AS p FROM {SEQ})"
_HYDRO = "CASE x " + " ".join(f"WHEN '{a}' THEN {v}" for a, v in seqfn.HYDROPATHY.items()) + " ELSE NULL END"
_THREE = "CASE x " + " ".join(f"WHEN '{a}' THEN '{v}'" for a, v in seqfn.THREE_LETTERS.items()) + " ELSE 'Xaa' END"


@query("protein_properties", f"SELECT id, round(list_avg(list_filter(list_transform(string_split(p, ''), lambda x: {_HYDRO}), lambda v: v IS NOT NULL)), 6) AS hydropathy, {', '.join(f"translate(p, '{a}', '{b}') AS {n}" for n, (a, b) in seqfn.REDUCED.items())}, list_reduce(list_transform(string_split(p, ''), lambda x: {_THREE}), lambda a, b: a || b) AS three FROM {_PROTEIN}")
def protein_properties(spark, sf):
    p = d.sequences(spark, sf).select("id", seqfn.translate(F.col("seq")).alias("p"))
    return p.select("id", F.round(seqfn.hydropathy(F.col("p")), 6).alias("hydropathy"), *(seqfn.reduced_alphabet(F.col("p"), n).alias(n) for n in seqfn.REDUCED), seqfn.three_letters(F.col("p")).alias("three"))


_FRAG = f"""WITH h AS (SELECT id, seq, list_filter(range(1, length(seq) + 1), lambda i: substr(seq, CAST(i AS INT), 2) = 'AC' AND i + 1 > 1 AND i + 1 <= length(seq)) AS c FROM {SEQ}),
s AS (SELECT id, seq, list_concat([1], list_transform(c, lambda i: i + 1)) AS st, list_concat(c, [length(seq)]) AS en FROM h)
SELECT id, CAST(k - 1 AS INT) AS part, CAST(st[k] AS INT) AS start, CAST(en[k] AS INT) AS "end", substr(seq, CAST(st[k] AS INT), CAST(en[k] - st[k] + 1 AS INT)) AS text FROM (SELECT *, unnest(range(1, len(st) + 1)) AS k FROM s)"""


@query("restriction_fragments", _FRAG)
def restriction_fragments(spark, sf):
    return ranges.fragments(d.sequences(spark, sf).select("id", "seq"), "AC", 1)


IDS = d.IDENTIFIERS_SQL
_F = "(SELECT ord, id, string_split(id, '|') AS f FROM " + IDS + ")"


@query("short_identifier", f"""SELECT ord, id, regexp_replace(CASE len(f) WHEN 2 THEN f[1] || '|' || f[2] WHEN 5 THEN f[3] || '|' || f[4] WHEN 3 THEN f[2] || '|' || f[3]
  WHEN 4 THEN CASE WHEN f[4] = 'COI_5P' THEN f[2] || '|' || f[3] WHEN f[3] <> 'COI_5P' THEN f[3] || '|' || f[4] ELSE id END ELSE id END, '^([^ ]*) ', '\\1_') AS short FROM {_F}""")
def short_identifier(spark, sf):
    return d.identifiers(spark, sf).select("ord", "id", ids.short_id(F.col("id")).alias("short"))


@query("identifier_names", f"SELECT ord, CASE WHEN len(f) = 2 THEN f[2] ELSE id END AS name, string_split(id, '_')[1] AS genus, contains(id, 'REFSEQ') AS reference, replace(replace(id, ' ', '_'), 'BOLD:', 'BOLD_') AS repaired FROM {_F}")
def identifier_names(spark, sf):
    c = F.col("id")
    return d.identifiers(spark, sf).select("ord", ids.id_name(c).alias("name"), ids.genus(c).alias("genus"), ids.is_reference(c).alias("reference"), ids.repaired_header(c).alias("repaired"))


@query("binomial_names", f"SELECT ord, CASE WHEN len(g) >= 2 AND length(g[-2]) >= 4 AND length(g[-1]) >= 4 THEN g[-2] || '_' || g[-1] END AS binomial FROM (SELECT ord, string_split(f[-1], '_') AS g FROM {_F})")
def binomial_names(spark, sf):
    return d.identifiers(spark, sf).select("ord", ids.binomial(F.col("id")).alias("binomial"))


@query("sanitized_fields", """SELECT CAST(p_partkey AS BIGINT) AS ord, coalesce(regexp_replace(regexp_replace(p_name, '"|^\\s+|\\s+$', '', 'g'), '[ ,]', '_', 'g'), 'NA') AS name, CASE WHEN length(p_type) > 20 THEN '---' ELSE p_type END AS capped, string_split(p_brand || '.fas.gz', '.')[1] AS stem FROM part""")
def sanitized_fields(spark, sf):
    p = d.table(spark, sf, "part")
    return p.select(F.col("p_partkey").cast("long").alias("ord"), ids.sanitized(F.col("p_name")).alias("name"), ids.capped(F.col("p_type"), 20).alias("capped"), ids.stem(F.concat("p_brand", F.lit(".fas.gz"))).alias("stem"))


def _lineages(rows):
    ranks = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("root"), "r_name", F.lit("COMMENT"), "n_name")).otherwise(F.array(F.lit("root"), "r_name", "n_name"))
    return rows.select(F.col("n_nationkey").cast("int").alias("n"), ids.lineage(ranks).alias("lineage"), ids.membership_digest(F.array("n_name", "r_name")).alias("digest"), F.round(ids.percent_error(F.col("n_nationkey") + 1, F.col("r_regionkey")), 6).alias("error"))


@query("lineage_strings", """SELECT CAST(n_nationkey AS INT) AS n, CASE WHEN n_nationkey % 3 = 0 THEN r_name ELSE r_name || ';' || n_name END AS lineage, sha1(r_name || ',' || n_name) AS digest, round(abs(n_nationkey + 1 - r_regionkey) / (n_nationkey + 1) * 100, 6) AS error FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name < n_name""")
def lineage_strings(spark, sf):
    return _lineages(d.table(spark, sf, "nation").join(d.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("r_name < n_name"))


@query("lineage_strings_all", """SELECT CAST(n_nationkey AS INT) AS n, CASE WHEN n_nationkey % 3 = 0 THEN r_name ELSE r_name || ';' || n_name END AS lineage, sha1(least(r_name, n_name) || ',' || greatest(r_name, n_name)) AS digest, round(abs(n_nationkey + 1 - r_regionkey) / (n_nationkey + 1) * 100, 6) AS error FROM nation JOIN region ON n_regionkey = r_regionkey""")
def lineage_strings_all(spark, sf):
    return _lineages(d.table(spark, sf, "nation").join(d.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")))


@query("document_trigrams", "SELECT kmer, count(*) AS n FROM (SELECT substr(text, CAST(unnest(range(1, length(text) - 1)) AS INT), 3) AS kmer FROM documents) GROUP BY kmer")
def document_trigrams(spark, sf):
    rows = d.table(spark, sf, "documents").select(F.explode(seqfn.windows(F.col("text"), 3, 1)).alias("w"))
    return rows.groupBy(F.col("w.text").alias("kmer")).agg(F.count(F.lit(1)).alias("n"))
