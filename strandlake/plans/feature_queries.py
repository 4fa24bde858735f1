"""Queries on stored features and on the compatibility of trees, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import compatibility, features
from strandlake.plans import derived as d

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


# Orders as features of three kinds, a third of them long; grouped by customer.
def _features(spark, sf):
    r = d.ranges(spark, sf)
    kind = F.when(F.col("id") % 3 == 0, "gene").when(F.col("id") % 3 == 1, "Exon").otherwise("cds")
    end = F.col("end") + F.when(F.col("id") % 3 == 0, (F.col("id") * 7919) % 300_000).otherwise(0)
    o = d.table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("name"), F.col("o_orderstatus").alias("status"))
    return r.join(o, "id").select("id", "seq_id", F.col("start").cast("long").alias("start"), end.cast("long").alias("end"), "strand", kind.alias("type"), "name", F.create_map(F.lit("status"), F.col("status")).alias("attributes"))


_FEATURES = f"""WITH f AS MATERIALIZED (SELECT r.id, seq_id, CAST(start AS BIGINT) AS start, CAST("end" + CASE WHEN r.id % 3 = 0 THEN (r.id * 7919) % 300000 ELSE 0 END AS BIGINT) AS stop, strand, CASE r.id % 3 WHEN 0 THEN 'gene' WHEN 1 THEN 'Exon' ELSE 'cds' END AS type,
'g' || CAST(o_custkey AS VARCHAR) AS name, o_orderstatus AS status FROM {d.RANGES_SQL} r JOIN orders ON o_orderkey = r.id) """
_TIER = "CASE " + " ".join(f"WHEN start // {1000 * 10**t} = stop // {1000 * 10**t} THEN {t}" for t in range(8)) + " ELSE 8 END"


@query("feature_bins", _FEATURES + f"SELECT id, tier, CASE WHEN tier = 8 THEN 0 ELSE start // CAST(1000 * pow(10, tier) AS BIGINT) END AS bin, '10000.' || start // 10000 AS bin_bot, '10000.' || stop // 10000 AS bin_top FROM (SELECT *, {_TIER} AS tier FROM f)")
def feature_bins(spark, sf):
    low, high = features.bin_bounds(1, F.col("start"), F.col("end"))
    return features.stored(_features(spark, sf)).select("id", "tier", "bin", low.alias("bin_bot"), high.alias("bin_top"))


@query("overlapping_features", _FEATURES + "SELECT a.id, count(*) AS n, CAST(sum(b.id) AS BIGINT) AS ids FROM f a JOIN f b ON a.seq_id = b.seq_id AND a.start <= b.stop AND b.start <= a.stop WHERE a.type = 'cds' AND b.type <> 'cds' GROUP BY a.id")
def overlapping_features(spark, sf):
    f = features.stored(_features(spark, sf).select("id", "seq_id", "start", "end", "type"))
    pairs = features.overlapping(f.filter("type = 'cds'"), f.filter("type <> 'cds'"))
    return pairs.groupBy(F.col("a_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("b_id").alias("ids"))


@query("features_by_location", _FEATURES + "SELECT id, start, stop AS \"end\" FROM f WHERE seq_id = 'chr1' AND start <= 4000 AND stop >= 900")
def features_by_location(spark, sf):
    return features.by_location(features.stored(_features(spark, sf)), "chr1", 900, 4000).select("id", "start", "end")


@query("features_by_kind", _FEATURES + "SELECT id, 'type' AS how FROM f WHERE lower(type) = 'exon' UNION ALL SELECT id, 'name' FROM f WHERE name LIKE 'g1%' UNION ALL SELECT id, 'attribute' FROM f WHERE status = 'O'")
def features_by_kind(spark, sf):
    f = _features(spark, sf)
    parts = {"type": features.by_type(f, ["EXON"]), "name": features.by_name(f, "G1*"), "attribute": features.by_attribute(f, {"status": "O"})}
    out = None
    for how, rows in parts.items():
        rows = rows.select("id", F.lit(how).alias("how"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("feature_types", _FEATURES + "SELECT type, count(*) AS n FROM f GROUP BY type")
def feature_types(spark, sf):
    return features.types(_features(spark, sf))


@query("composite_features", _FEATURES + """, g AS (SELECT seq_id, name, min(start) AS start, max(stop) AS stop, min(strand) AS low, max(strand) AS high, count(*) FILTER (type <> 'gene') AS parts FROM f GROUP BY seq_id, name),
m AS (SELECT seq_id, name, strand FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, name ORDER BY start, stop, strand) AS k FROM f WHERE type = 'gene') WHERE k = 1)
SELECT g.seq_id, g.name, g.start, g.stop AS "end", coalesce(m.strand, CASE WHEN low = high THEN low ELSE 0 END) AS strand, 'gene' AS type, parts FROM g LEFT JOIN m ON m.seq_id = g.seq_id AND m.name = g.name""")
def composite_features(spark, sf):
    f = _features(spark, sf)
    wanted = features.disaggregated(["gene"], "gene", ["exon", "cds"])
    return features.aggregated(features.by_type(f, wanted), "gene", ["exon", "cds"])


# A second tree over the same suppliers: every seventh nation lies in another region, and every fifth supplier in another nation.
def _other(spark, sf):
    t = d.tree(spark, sf)
    at = F.col("node")
    moved = F.when((at >= 1000) & (at % 5 == 0), (F.col("parent") - 100 + 3) % 25 + 100).when((at >= 100) & (at < 1000) & (at % 7 == 0), F.col("parent") % 5 + 1).otherwise(F.col("parent"))
    return t.withColumn("parent", moved.cast("long"))


_OTHER = f"(SELECT node, CAST(CASE WHEN node >= 1000 AND node % 5 = 0 THEN (parent - 100 + 3) % 25 + 100 WHEN node >= 100 AND node < 1000 AND node % 7 = 0 THEN parent % 5 + 1 ELSE parent END AS BIGINT) AS parent, label FROM {d.TREE_SQL})"
_CLUSTERS = f"""WITH RECURSIVE a AS MATERIALIZED (SELECT node, parent, label FROM {d.TREE_SQL}), b AS MATERIALIZED {_OTHER},
ua(label, node) AS (SELECT label, node FROM a WHERE node NOT IN (SELECT parent FROM a WHERE parent IS NOT NULL) UNION ALL SELECT ua.label, a.parent FROM ua JOIN a USING (node) WHERE a.parent IS NOT NULL),
ub(label, node) AS (SELECT label, node FROM b WHERE node NOT IN (SELECT parent FROM b WHERE parent IS NOT NULL) UNION ALL SELECT ub.label, b.parent FROM ub JOIN b USING (node) WHERE b.parent IS NOT NULL),
both_ AS (SELECT DISTINCT label FROM ua WHERE label IN (SELECT label FROM ub)), ca AS (SELECT * FROM ua WHERE label IN (SELECT label FROM both_)), cb AS (SELECT * FROM ub WHERE label IN (SELECT label FROM both_)) """


@query("tree_conflicts", _CLUSTERS + """SELECT * FROM (SELECT x.node AS node1, y.node AS node2, (SELECT count(*) FROM ca JOIN cb USING (label) WHERE ca.node = x.node AND cb.node = y.node) AS shared,
(SELECT count(*) FROM ca WHERE ca.node = x.node AND ca.label NOT IN (SELECT label FROM cb WHERE cb.node = y.node)) AS only1, (SELECT count(*) FROM cb WHERE cb.node = y.node AND cb.label NOT IN (SELECT label FROM ca WHERE ca.node = x.node)) AS only2
FROM (SELECT DISTINCT node FROM ca WHERE node < 1000) x, (SELECT DISTINCT node FROM cb WHERE node < 1000) y) WHERE shared > 0 AND only1 > 0 AND only2 > 0""")
def tree_conflicts(spark, sf):
    return compatibility.conflicts(d.tree(spark, sf), _other(spark, sf))


@query("common_tree_labels", _CLUSTERS + "SELECT label FROM both_")
def common_tree_labels(spark, sf):
    return compatibility.common_labels(d.tree(spark, sf), _other(spark, sf))


@query("restricted_tree", f"""WITH RECURSIVE t AS MATERIALIZED {d.TREE_SQL}, up(leaf, node) AS (SELECT node, node FROM t WHERE label LIKE 's%' AND node % 3 = 0 UNION ALL SELECT leaf, t.parent FROM up JOIN t USING (node) WHERE t.parent IS NOT NULL), k AS (SELECT DISTINCT node FROM up),
c AS (SELECT t.parent AS node, count(*) AS n FROM t JOIN k ON k.node = t.node GROUP BY t.parent), f AS MATERIALIZED (SELECT t.node, t.parent, t.length, coalesce(n, 0) <> 1 AS stays FROM t JOIN k USING (node) LEFT JOIN c USING (node)),
w(node, parent, length) AS (SELECT node, parent, length FROM f WHERE stays UNION ALL SELECT w.node, f.parent, w.length + f.length FROM w JOIN f ON f.node = w.parent WHERE NOT f.stays)
SELECT w.node, f.node AS parent, CASE WHEN f.node IS NOT NULL THEN round(w.length, 6) END AS length FROM w LEFT JOIN f ON f.node = w.parent AND f.stays WHERE f.node IS NOT NULL OR w.parent IS NULL""")
def restricted_tree(spark, sf):
    t = d.tree(spark, sf)
    labels = t.filter("label LIKE 's%' AND node % 3 = 0").select("label")
    made = compatibility.topological_restriction(t, labels)
    return made.select("node", "parent", F.when(F.col("parent").isNotNull(), F.round("length", 6)).alias("length"))
