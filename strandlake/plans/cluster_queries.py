"""Queries on distances, clusters and haplotypes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import distance, ids, seqfn
from strandlake.operators import otu, popgen, resample
from strandlake.plans import derived as d

QUERIES, ORACLES = {}, {}
SEQ, GAPPED = d.sequences_sql(), d.gapped_sql()
SUP, SUP_GAPPED = d.sequences_sql("supplier"), d.gapped_sql("supplier")
CUTOFF = 0.05


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


K2P = "CASE WHEN n <= 0 THEN 2.0 WHEN 1 - 2 * ts / n - tv / n <= 0 OR 1 - 2 * tv / n <= 0 THEN 2.0 ELSE -ln(1 - 2 * ts / n - tv / n) / 2 - ln(1 - 2 * tv / n) / 4 END"


def pairs_sql(rows: str, keys: str = "id", join: str = "a.id < b.id") -> str:
    """(id1, id2, n, ts, tv, k2p) of pairs of ``rows`` (id, seq, ...)."""
    return f"""(SELECT *, CAST({K2P} AS DOUBLE) AS k2p FROM (
  SELECT id1, id2, CAST(count(*) FILTER (x IN ('A','C','G','T') AND y IN ('A','C','G','T')) AS BIGINT) AS n, CAST(count(*) FILTER (x || y IN ('AG','GA','CT','TC')) AS BIGINT) AS ts,
    CAST(count(*) FILTER (x <> y AND x IN ('A','C','G','T') AND y IN ('A','C','G','T') AND x || y NOT IN ('AG','GA','CT','TC')) AS BIGINT) AS tv
  FROM (SELECT id1, id2, substr(s1, CAST(i AS INT), 1) AS x, substr(s2, CAST(i AS INT), 1) AS y FROM (SELECT a.{keys} AS id1, b.{keys} AS id2, a.seq AS s1, b.seq AS s2, unnest(range(1, 65)) AS i FROM {rows} a JOIN {rows} b ON {join}))
  GROUP BY id1, id2))"""


@query("k2p_pairs", f"SELECT id1, id2, n, ts, tv, round(k2p, 6) AS k2p FROM {pairs_sql(SUP_GAPPED)} WHERE n >= 25")
def k2p_pairs(spark, sf):
    rows = d.gapped(spark, sf, "supplier")
    return otu.all_pairs(rows, digits=6)


@query("distance_models", f"""WITH p AS (SELECT *, 1.0 * (ts + tv) / n AS q, 1 - 2.0 * ts / n - 1.0 * tv / n AS w1, 1 - 2.0 * tv / n AS w2 FROM {pairs_sql(SUP)} WHERE k2p <= 0.05)
SELECT id1, id2, round(q, 6) AS p_distance, round(-0.75 * ln(1 - q / 0.75), 6) AS jukes_cantor,
 round((1 / (w1 * w1) * ts / n + ((1 / w1 + 1 / w2) / 2) * ((1 / w1 + 1 / w2) / 2) * tv / n - (1 / w1 * ts / n + (1 / w1 + 1 / w2) / 2 * tv / n) * (1 / w1 * ts / n + (1 / w1 + 1 / w2) / 2 * tv / n)) / n, 6) AS variance,
 round(-0.5 * ln(1 - 1.0 * ts / n / 0.5 - 1.0 * tv / n) - 0.25 * ln(1 - 2.0 * tv / n), 6) AS tamura_half FROM p""")
def distance_models(spark, sf):
    n, ts, tv = F.col("n"), F.col("ts"), F.col("tv")
    models = {"p_distance": distance.p_distance(n, ts + tv), "jukes_cantor": distance.jukes_cantor(n, ts + tv), "variance": distance.k2p_variance(n, ts, tv), "tamura_half": distance.tamura(n, ts, tv, F.lit(0.5), F.lit(0.5))}
    return otu.near_pairs_of_rows(d.sequences(spark, sf, "supplier"), CUTOFF, 0, d.LENGTH, {k: F.round(v, 6) for k, v in models.items()})


@query("pair_counts", f"""SELECT id1, id2, CAST(count(*) FILTER (x IN ('A','C','G','T') AND y IN ('A','C','G','T')) AS BIGINT) AS comparable, CAST(count(*) FILTER (x <> y AND x IN ('A','C','G','T') AND y IN ('A','C','G','T')) AS BIGINT) AS differences, CAST(count(*) FILTER (x = '-' OR y = '-') AS BIGINT) AS gaps
FROM (SELECT a.id AS id1, b.id AS id2, unnest(string_split(a.seq, '')) AS x, unnest(string_split(b.seq, '')) AS y FROM {SUP_GAPPED} a JOIN {SUP_GAPPED} b ON a.grp = b.grp AND a.id < b.id) GROUP BY id1, id2""")
def pair_counts(spark, sf):
    return otu.pair_counts(d.gapped(spark, sf, "supplier"), "grp").select("id1", "id2", "comparable", "differences", "gaps")


_DISTINCT = f"(SELECT seq, arg_max(id, ord) AS id FROM {SEQ} GROUP BY seq)"
_NEAR = f"""WITH RECURSIVE u AS MATERIALIZED {_DISTINCT}, e AS MATERIALIZED (SELECT id1, id2 FROM {pairs_sql('u')} WHERE k2p <= {CUTOFF} AND n >= 25),
s AS MATERIALIZED (SELECT id FROM u WHERE id NOT IN (SELECT id1 FROM e)),
l AS MATERIALIZED (SELECT id1 AS q, id2 AS r FROM e WHERE id2 IN (SELECT id FROM s) UNION SELECT id2, id1 FROM e WHERE id1 IN (SELECT id FROM s)),
both_ways AS MATERIALIZED (SELECT q AS a, r AS b FROM l UNION SELECT r, q FROM l),
reach(a, b) AS (SELECT id, id FROM u UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
c AS MATERIALIZED (SELECT a AS id, min(b) AS otu FROM reach GROUP BY a),
m AS MATERIALIZED (SELECT x.id, x.name, x.grp, x.seq, c.otu FROM {SEQ} x JOIN u USING (seq) JOIN c ON c.id = u.id) """


def _members(spark, sf):
    rows = d.sequences(spark, sf)
    return otu.assign(rows, otu.delimit(rows, CUTOFF))


@query("otu_edges", f"SELECT id1, id2, n, ts, tv, round(k2p, 6) AS k2p FROM (WITH u AS MATERIALIZED {_DISTINCT} SELECT * FROM {pairs_sql('u')} WHERE k2p <= {CUTOFF} AND n >= 25)")
def otu_edges(spark, sf):
    return otu.near_pairs(otu.alleles(d.sequences(spark, sf)), CUTOFF, 25, d.LENGTH).withColumn("k2p", F.round("k2p", 6))


@query("otu_survivors", _NEAR + "SELECT id FROM s")
def otu_survivors(spark, sf):
    u = otu.alleles(d.sequences(spark, sf))
    return otu.survivors(u, otu.near_pairs(u, CUTOFF, 25, d.LENGTH)).select("id")


@query("otu_components", _NEAR + "SELECT id, otu FROM m")
def otu_components(spark, sf):
    return _members(spark, sf).select("id", "otu")


@query("otu_summary", _NEAR + """SELECT otu, count(DISTINCT id) AS abundance, count(DISTINCT seq) AS unique_alleles, count(DISTINCT name) AS n_names, CAST(avg(length(seq)) AS DOUBLE) AS mean_length, CAST(min(length(seq)) AS BIGINT) AS min_length,
  CAST(max(length(seq)) AS BIGINT) AS max_length, coalesce(round(stddev_samp(length(seq)) / sqrt(count(*)), 6), 0.0) AS se_length FROM m GROUP BY otu""")
def otu_summary(spark, sf):
    return otu.summarize(_members(spark, sf)).withColumn("se_length", F.round("se_length", 6))


@query("otu_names", _NEAR + """, p AS (SELECT DISTINCT otu, name FROM m), z AS (SELECT otu, count(*) AS names FROM p GROUP BY otu) SELECT name, count(*) AS otus, count(*) + count(*) FILTER (names > 1) = 1 AS one_to_one FROM p JOIN z USING (otu) GROUP BY name""")
def otu_names(spark, sf):
    return otu.name_scores(_members(spark, sf))


@query("otu_lumping", _NEAR + ", p AS (SELECT otu, count(DISTINCT name) AS n_names FROM m GROUP BY otu) SELECT n_names, count(*) AS otus, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM p GROUP BY n_names")
def otu_lumping(spark, sf):
    return otu.lumping(_members(spark, sf)).withColumn("share", F.round("share", 6))


_BY_GROUP = f"(SELECT DISTINCT grp, seq, seq AS id FROM {SUP})"
_INTRA = f"(SELECT a.grp AS otu, p.* FROM {pairs_sql(_BY_GROUP, join='a.grp = b.grp AND a.seq < b.seq')} p JOIN {_BY_GROUP} a ON a.seq = p.id1 WHERE n >= 25)"


@query("intra_cluster_distances", f"SELECT otu, count(*) AS pairs, round(avg(k2p * 100), 6) AS mean_dist, round(min(k2p * 100), 6) AS min_dist, round(max(k2p * 100), 6) AS max_dist, round(coalesce(stddev_samp(k2p * 100) / sqrt(count(*)), 0.0), 6) AS se_dist, CAST(avg(n) AS DOUBLE) AS mean_bases, min(n) AS min_bases, max(n) AS max_bases FROM {_INTRA} GROUP BY otu")
def intra_cluster_distances(spark, sf):
    found = otu.intra_statistics(otu.intra_pairs(d.sequences(spark, sf, "supplier").withColumnRenamed("grp", "otu")))
    return found.select("otu", "pairs", *(F.round(c, 6).alias(c) for c in ("mean_dist", "min_dist", "max_dist", "se_dist")), "mean_bases", "min_bases", "max_bases")


_EX = f"(SELECT grp AS otu, id, seq FROM {SUP_GAPPED} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY length(regexp_replace(seq, '[-\\s]', '', 'g')) DESC, md5(id || '1')) = 1)"


@query("exemplars", f"SELECT otu, id FROM {_EX}")
def exemplars(spark, sf):
    return otu.exemplars(d.gapped(spark, sf, "supplier").withColumnRenamed("grp", "otu")).select("otu", "id")


@query("nearest_clusters", f"""WITH ex AS MATERIALIZED {_EX}, p AS (SELECT id1, id2, round(k2p, 9) AS k2p FROM {pairs_sql('ex', 'otu', 'a.otu <> b.otu')} WHERE n >= 25)
SELECT id1 AS otu, id2 AS other, round(k2p, 6) AS k2p, CAST(row_number() OVER (PARTITION BY id1 ORDER BY k2p, id2) AS INT) AS rank FROM p QUALIFY rank <= 3""")
def nearest_clusters(spark, sf):
    ex = otu.exemplars(d.gapped(spark, sf, "supplier").withColumnRenamed("grp", "otu"))
    return otu.nearest(ex, 3).select("otu", "other", F.round("k2p", 6).alias("k2p"), "rank")


@query("distinct_last_id", f"SELECT seq, arg_max(id, ord) AS id, count(*) AS copies FROM {SEQ} GROUP BY seq")
def distinct_last_id(spark, sf):
    return otu.alleles(d.sequences(spark, sf))


@query("haplotype_counts", f"SELECT seq, grp, count(*) AS n FROM {SEQ} GROUP BY seq, grp")
def haplotype_counts(spark, sf):
    return popgen.haplotype_counts(d.sequences(spark, sf), "grp")


_PAIR_NAMES = f"(SELECT a.id AS id1, b.id AS id2, a.name = b.name AS same FROM {SUP} a JOIN {SUP} b ON a.id < b.id)"


@query("distance_classes", f"SELECT q.same AS same_name, count(*) AS pairs, round(min(k2p), 6) AS least, round(max(least(k2p, 0.5)), 6) AS greatest FROM {pairs_sql(SUP)} p JOIN {_PAIR_NAMES} q USING (id1, id2) WHERE n >= 25 GROUP BY q.same")
def distance_classes(spark, sf):
    rows = d.sequences(spark, sf, "supplier")
    p = otu.distances_by_name(rows)
    return p.groupBy("same_name").agg(F.sum("pairs").alias("pairs"), F.round(F.min("k2p"), 6).alias("least"), F.round(F.max(F.least("k2p", F.lit(0.5))), 6).alias("greatest"))


@query("quality_class", f"""WITH ref AS (SELECT seq FROM {SUP} WHERE ord = 1), p AS (SELECT id1 AS id, n, k2p FROM {pairs_sql('v', join="b.id = 'r' AND a.id <> 'r'")})
SELECT id, CASE WHEN k2p < 0.3 AND n / 64 > 0.9 THEN 'pristine' WHEN k2p < 0.55 THEN 'potential' ELSE 'failed' END AS class FROM p""".replace("WITH ref", f"WITH v AS (SELECT id, seq FROM {SUP_GAPPED} UNION ALL SELECT 'r', seq FROM {SUP} WHERE ord = 1), ref"))
def quality_class(spark, sf):
    p = otu.from_reference(d.gapped(spark, sf, "supplier"), d.sequences(spark, sf, "supplier").filter("ord = 1"))
    return p.select("id", F.when((F.col("k2p") < 0.3) & (F.col("n") / 64 > 0.9), "pristine").when(F.col("k2p") < 0.55, "potential").otherwise("failed").alias("class"))


def _draw_sql(n: str, *keys: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', '1', {', '.join(keys)})), 1, 8)) AS BIGINT) % {n})"


@query("bootstrap_rows", f"WITH r AS (SELECT row_number() OVER (ORDER BY id) - 1 AS at_, id FROM {SUP}) SELECT rep, k, r.id FROM (SELECT i // 50 AS rep, i % 50 AS k, {_draw_sql('(SELECT count(*) FROM r)', 'CAST(i // 50 AS VARCHAR)', 'CAST(i % 50 AS VARCHAR)')} AS at_ FROM range(200) t(i)) x JOIN r USING (at_)")
def bootstrap_rows(spark, sf):
    rows = resample.numbered(d.sequences(spark, sf, "supplier").select("id"), "id")
    return resample.bootstrap_rows(spark, rows, 4, 50).select("rep", "k", "id")


@query("bootstrap_weights", f"WITH g AS (SELECT rep, c, count(*) AS w FROM (SELECT rep, {_draw_sql('64', 'CAST(rep AS VARCHAR)', 'CAST(k AS VARCHAR)')} AS c FROM range(5) a(rep), range(64) b(k)) GROUP BY rep, c) SELECT rep, CAST(c AS INT) AS pos, CAST(w AS INT) AS weight FROM g")
def bootstrap_weights(spark, sf):
    w = resample.column_weights(d.LENGTH, 5, spark)
    return w.select("rep", F.posexplode("weights").alias("pos", "weight")).filter("weight > 0")


@query("bootstrap_columns", f"SELECT rep, id, k + 1 AS pos, substr(seq, CAST(f AS INT) + 1, 1) AS base FROM (SELECT i // 64 AS rep, i % 64 AS k, {_draw_sql('64', 'CAST(i // 64 AS VARCHAR)', 'CAST(i % 64 AS VARCHAR)')} AS f FROM range(128) t(i)), {SUP}")
def bootstrap_columns(spark, sf):
    return resample.bootstrap_columns(d.columns(d.sequences(spark, sf, "supplier")), d.LENGTH, 2)


@query("repeat_suffixes", "SELECT CAST(o_orderkey AS BIGINT) AS k, CASE WHEN r = 1 THEN c ELSE c || '_' || r END AS label FROM (SELECT o_orderkey, 'v' || o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)")
def repeat_suffixes(spark, sf):
    o = d.table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.concat(F.lit("v"), F.col("o_custkey").cast("string")).alias("c"))
    return resample.repeat_suffix(o, "c", "k").select("k", "label")


@query("random_splices", f"SELECT id, s + 1 AS start, z AS size, substr(seq, CAST(s AS INT) + 1, CAST(z AS INT)) AS seq FROM (SELECT *, {_draw_sql('(length(seq) - z + 1)', 'id', chr(39) + 'start' + chr(39))} AS s FROM (SELECT id, seq, least(length(seq), 20 + {_draw_sql('20', 'id', chr(39) + 'size' + chr(39))}) AS z FROM {SUP}))")
def random_splices(spark, sf):
    return resample.random_splice(d.sequences(spark, sf, "supplier"), 20, 40)


@query("cluster_support", f"""WITH m AS (SELECT grp AS otu, id FROM {SUP}), o AS (SELECT otu, sha1(string_agg(DISTINCT id, ',' ORDER BY id)) AS digest FROM m GROUP BY otu),
r AS (SELECT rep, otu, sha1(string_agg(DISTINCT id, ',' ORDER BY id)) AS digest FROM m, range(4) t(rep) WHERE rep < 2 OR CAST(id AS BIGINT) % 7 <> rep GROUP BY rep, otu),
t AS (SELECT digest, count(*) AS times FROM r GROUP BY digest) SELECT otu, o.digest, coalesce(times, 0) / 4 AS support FROM o LEFT JOIN t ON o.digest = t.digest""")
def cluster_support(spark, sf):
    m = d.sequences(spark, sf, "supplier").select(F.col("grp").alias("otu"), "id")
    reps = m.crossJoin(spark.range(4).withColumnRenamed("id", "rep")).filter("rep < 2 OR cast(id AS long) % 7 <> rep")
    return otu.support(m, reps, 4)
