"""Queries on tilings of hits and on roots of trees, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import rooting, tiling
from strandlake.operators.trees import leaves
from strandlake.plans import derived as d

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


# Hits on a subject, strand by strand; those of all queries tile it together.
BY = ["sseqid", "strand"]
REPORTED = 1100


def _hits(spark, sf):
    h = d.hits(spark, sf)
    same = F.greatest(F.col("length") - F.col("mismatch"), F.lit(0))
    return h.select("sseqid", F.when(F.col("sstart") > F.col("send"), -1).otherwise(1).alias("strand"), (F.col("qseqid").cast("long") * 10 + F.col("mismatch")).alias("id"), F.least("sstart", "send").cast("long").alias("start"), F.greatest("sstart", "send").cast("long").alias("end"), same.alias("identities"), (same + F.floor(F.col("mismatch") / 2)).alias("conserved"))


_HITS = f"""WITH h AS MATERIALIZED (SELECT sseqid, CASE WHEN sstart > send THEN -1 ELSE 1 END AS strand, CAST(qseqid AS BIGINT) * 10 + mismatch AS id, CAST(least(sstart, send) AS BIGINT) AS b, CAST(greatest(sstart, send) AS BIGINT) AS e,
  greatest(length - mismatch, 0) AS same, greatest(length - mismatch, 0) + mismatch // 2 AS kept FROM {d.HITS_SQL}),
p AS (SELECT sseqid, strand, b AS edge FROM h UNION SELECT sseqid, strand, e + 1 FROM h), c AS (SELECT sseqid, strand, edge AS b, lead(edge) OVER (PARTITION BY sseqid, strand ORDER BY edge) - 1 AS e FROM p),
m AS (SELECT c.sseqid, c.strand, c.b, c.e, h.id, h.same / (h.e - h.b + 1) AS same, h.kept / (h.e - h.b + 1) AS kept FROM c JOIN h ON h.sseqid = c.sseqid AND h.strand = c.strand AND h.b <= c.b AND h.e >= c.e),
k AS (SELECT sseqid, strand, b, e, count(*) AS covering, avg(same) AS same, avg(kept) AS kept, min(id) AS id FROM m GROUP BY sseqid, strand, b, e),
s AS (SELECT sseqid, strand, CAST(sum(e - b + 1) AS BIGINT) AS length, sum((e - b + 1) * same) AS identities, sum((e - b + 1) * kept) AS conserved, count(*) AS components FROM k GROUP BY sseqid, strand) """


@query("tiling_components", _HITS + 'SELECT sseqid, strand, b AS start, e AS "end", covering FROM k')
def tiling_components(spark, sf):
    return tiling.components(_hits(spark, sf), BY).select(*BY, "start", "end", "covering")


@query("tiling_statistics", _HITS + f"SELECT sseqid, strand, length, round(identities, 4) AS identities, round(conserved, 4) AS conserved, components, round(identities / {REPORTED}, 6) AS frac_identical, round(identities / length, 6) AS frac_identical_aligned, round(conserved / {REPORTED}, 6) AS frac_conserved, round(length / {REPORTED}, 6) AS frac_aligned FROM s")
def tiling_statistics(spark, sf):
    found = tiling.fractions(tiling.statistics(_hits(spark, sf), BY), F.lit(REPORTED))
    return found.select(*BY, "length", *(F.round(c, 4).alias(c) for c in ("identities", "conserved")), "components", *(F.round(c, 6).alias(c) for c in ("frac_identical", "frac_identical_aligned", "frac_conserved", "frac_aligned")))


@query("tiling_fast_statistics", _HITS + "SELECT sseqid, strand, round(sum((e - b + 1) * (e - b + 1)) / sum(e - b + 1), 4) AS length, round(sum((e - b + 1) * same) / sum(e - b + 1), 4) AS identities, round(sum((e - b + 1) * kept) / sum(e - b + 1), 4) AS conserved FROM h GROUP BY sseqid, strand")
def tiling_fast_statistics(spark, sf):
    found = tiling.fast_statistics(_hits(spark, sf), BY)
    return found.select(*BY, *(F.round(c, 4).alias(c) for c in ("length", "identities", "conserved")))


@query("first_tilings", _HITS + "SELECT DISTINCT sseqid, strand, id FROM k")
def first_tilings(spark, sf):
    return tiling.first_tiling(_hits(spark, sf), BY)


# Roots.
_DOWN = f"WITH RECURSIVE t AS MATERIALIZED {d.TREE_SQL}, down(node, levels, depth) AS (SELECT node, CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM t WHERE parent IS NULL UNION ALL SELECT t.node, levels + 1, depth + t.length FROM down JOIN t ON t.parent = down.node)"


@query("root_distances", f"{_DOWN} SELECT node, levels, round(depth, 6) AS depth FROM down")
def root_distances(spark, sf):
    return rooting.root_distances(d.tree(spark, sf)).withColumn("depth", F.round("depth", 6))


NEW_ROOT = 103


@query("rerooted_tree", f"""WITH RECURSIVE t AS MATERIALIZED {d.TREE_SQL}, way(node, k) AS (SELECT CAST({NEW_ROOT} AS BIGINT), 0 UNION ALL SELECT t.parent, k + 1 FROM way JOIN t USING (node) WHERE t.parent IS NOT NULL),
turned AS (SELECT a.node, b.node AS parent, t.length FROM way a LEFT JOIN way b ON b.k = a.k - 1 LEFT JOIN t ON t.node = b.node)
SELECT node, parent, length FROM turned UNION ALL SELECT node, parent, length FROM t WHERE node NOT IN (SELECT node FROM way)""")
def rerooted_tree(spark, sf):
    return rooting.reroot(d.tree(spark, sf), NEW_ROOT).select("node", "parent", "length")


_STEP = "SELECT e.y, w.v, w.far + e.length FROM {0} w JOIN e ON e.x = w.v WHERE e.y <> w.came"


@query("midpoint_depths", f"""{_DOWN}, tips AS (SELECT node FROM t WHERE node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)), e AS MATERIALIZED (SELECT node AS x, parent AS y, length FROM t WHERE parent IS NOT NULL UNION ALL SELECT parent, node, length FROM t WHERE parent IS NOT NULL),
a AS MATERIALIZED (SELECT node FROM down JOIN tips USING (node) ORDER BY depth DESC, node LIMIT 1), wa(v, came, far) AS (SELECT node, CAST(-1 AS BIGINT), CAST(0 AS DOUBLE) FROM a UNION ALL {_STEP.format('wa')}),
b AS MATERIALIZED (SELECT v, far FROM wa JOIN tips ON tips.node = v ORDER BY round(far, 9) DESC, v LIMIT 1), wb(v, came, far) AS (SELECT v, CAST(-1 AS BIGINT), CAST(0 AS DOUBLE) FROM b UNION ALL {_STEP.format('wb')})
SELECT node, round(greatest(wa.far, wb.far) - b.far / 2, 6) AS depth FROM tips JOIN wa ON wa.v = node JOIN wb ON wb.v = node, b""")
def midpoint_depths(spark, sf):
    """How deep each leaf lies in the tree rooted at its midpoint."""
    tree = d.tree(spark, sf)
    made = rooting.root_distances(rooting.midpoint_rooted(tree, -1))
    return made.join(leaves(tree).select("node").distinct(), "node").select("node", F.round("depth", 6).alias("depth"))
