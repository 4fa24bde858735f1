"""Queries on graphs, networks, traits on trees, codon changes and sites, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import ids, seqfn
from strandlake.operators import codons, hierarchy, networks, pairwise_batch, parsimony, restriction, tables
from strandlake.operators import rows as rows_
from strandlake.plans import derived as d

QUERIES, ORACLES = {}, {}
SUP, GAPPED = d.sequences_sql("supplier"), d.gapped_sql("supplier")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


# Identifiers.
_TAGGED = """SELECT ord, CASE ord % 4 WHEN 0 THEN id || '|COI-5P' WHEN 1 THEN 'COI-5P|' || id ELSE id END AS id, CASE WHEN ord % 5 > 0 THEN 'T' || CAST(ord % 5 AS VARCHAR) END AS tag"""


@query("tag_rewrites", f"""WITH i AS ({_TAGGED} FROM {d.IDENTIFIERS_SQL}), k AS (SELECT *, list_filter(string_split(id, '|'), lambda x: x <> 'COI-5P') AS kept FROM i)
SELECT ord, array_to_string(kept, '|') || '_' || coalesce(tag, '') AS label, array_to_string(kept, '|') || CASE WHEN ord % 4 = 1 THEN '|' ELSE '_' END || coalesce(tag, '') AS as_described FROM k""")
def tag_rewrites(spark, sf):
    i = d.identifiers(spark, sf)
    marked = F.when(F.col("ord") % 4 == 0, F.concat("id", F.lit("|COI-5P"))).when(F.col("ord") % 4 == 1, F.concat(F.lit("COI-5P|"), "id")).otherwise(F.col("id"))
    tag = F.when(F.col("ord") % 5 > 0, F.concat(F.lit("T"), (F.col("ord") % 5).cast("string")))
    return i.select("ord", ids.tagged(marked, tag).alias("label"), ids.tagged(marked, tag, compat=True).alias("as_described"))


@query("renamed_from_parts", f"SELECT ord, coalesce(p[6], '') || '_' || coalesce(p[7], '') || '_' || coalesce(p[4], '') AS label FROM (SELECT ord, string_split(replace(replace(id, '|', '_'), ' ', '_'), '_') AS p FROM {d.IDENTIFIERS_SQL})")
def renamed_from_parts(spark, sf):
    i = d.identifiers(spark, sf)
    return i.select("ord", ids.renamed_from_parts(F.translate("id", " ", "_")).alias("label"))


# Lines of a read file: headers with and without a primer, bases, qualities.
_LINES = """SELECT p_partkey AS ord, CASE p_partkey % 4 WHEN 0 THEN '>r' || p_partkey || ' ' || p_brand || ' HCO.fna x' WHEN 1 THEN 'ACGT ' || p_name WHEN 2 THEN '40 ' || p_size || ' 7' ELSE '>r' || p_partkey || ' 12 ' || p_brand END AS line FROM part"""


@query("read_lines", f"WITH l AS (SELECT ord, replace(line, ' ', '_') AS line, string_split(replace(line, ' ', '_'), '_') AS p FROM ({_LINES})) SELECT ord, CASE ord % 4 WHEN 0 THEN line || '|' || p[2] ELSE line END AS line FROM l WHERE ord % 4 <> 2")
def read_lines(spark, sf):
    p = d.table(spark, sf, "part")
    key, text = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    line = F.when(key % 4 == 0, F.concat(F.lit(">r"), text("p_partkey"), F.lit(" "), "p_brand", F.lit(" HCO.fna x"))).when(key % 4 == 1, F.concat(F.lit("ACGT "), "p_name")).when(key % 4 == 2, F.concat(F.lit("40 "), text("p_size"), F.lit(" 7"))).otherwise(F.concat(F.lit(">r"), text("p_partkey"), F.lit(" 12 "), "p_brand"))
    return p.select(key.cast("long").alias("ord"), ids.read_line(line, 1).alias("line")).filter("line IS NOT NULL")


@query("names_by_place", f"SELECT place, replace(name, ' ', '_') AS label, seq FROM (SELECT row_number() OVER (ORDER BY ord) AS place, seq FROM {SUP}) JOIN (SELECT row_number() OVER (ORDER BY p_partkey) AS place, p_name AS name FROM part) USING (place)")
def names_by_place(spark, sf):
    names = rows_.placed(d.table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("ord"), F.col("p_name").alias("name")))
    found = tables.renamed_by_place(rows_.placed(d.sequences(spark, sf, "supplier")).select("place", "seq"), names)
    return found.select("place", "label", "seq")


@query("discrepant_sequences", f"WITH m AS (SELECT x.id, x.seq, p_brand AS name, x.grp AS otu FROM {d.sequences_sql()} x JOIN part ON p_partkey = x.ord), t AS (SELECT name, count(DISTINCT otu) AS times FROM m GROUP BY name HAVING count(DISTINCT otu) <> 1) SELECT id, seq, times FROM m JOIN t USING (name)")
def discrepant_sequences(spark, sf):
    """Customers' sequences named by brands; a brand in several nations is discrepant."""
    names = d.table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("name"))
    m = d.sequences(spark, sf).drop("name").join(names, "ord").withColumnRenamed("grp", "otu")
    return tables.discrepant(m, m)


@query("site_shards", f"SELECT site, ord, value FROM (SELECT 'site' || grp AS site, ord, '>r' || ord || '|' || id || '|99|' || name || chr(10) || seq AS value, row_number() OVER (PARTITION BY grp ORDER BY ord) AS k FROM {SUP}) WHERE k > 1 UNION ALL SELECT DISTINCT 'site' || grp, CAST(NULL AS BIGINT), '>exemplar' || chr(10) || 'ACGT' FROM {SUP}")
def site_shards(spark, sf):
    r = d.sequences(spark, sf, "supplier")
    ident = F.concat_ws("|", F.concat(F.lit("r"), F.col("ord").cast("string")), "id", "name", F.lit("99"), F.concat(F.lit("site"), F.col("grp").cast("string")))
    return tables.site_shards(r.select("ord", ident.alias("id"), "seq"), compat=True, exemplar=">exemplar\nACGT")


# Sites: palindromes, one strand's sites, codes that stand for several bases.
ENZYMES = [("four", "GATC", 0), ("three", "CAG", 2), ("wild", "GANTC", 1), ("apart", "CCWGG", 2), ("off", "ACTGG", 5, 4)]
_COMPLEMENT = "reverse(translate({0}, 'ACGTWN', 'TGCAWN'))"
_SITES = "(SELECT enzyme, site, cut FROM e UNION SELECT enzyme, {0}, length(site) - other FROM e WHERE {0} <> site)".format(_COMPLEMENT.format("site"))
_E = "e(enzyme, site, cut, other) AS (VALUES " + ", ".join(f"('{n}', '{s}', {c}, {o[0] if o else len(s) - c})" for n, s, c, *o in ENZYMES) + ")"
_CUTS = f"""{_E}, p AS (SELECT enzyme, length(site) AS size, cut, '^' || replace(replace(site, 'N', '[ACGT]'), 'W', '[AT]') || '$' AS form FROM {_SITES}),
w AS (SELECT DISTINCT id, enzyme, CAST(i + cut - 1 AS BIGINT) AS position FROM (SELECT id, seq, unnest(range(1, 65)) AS i FROM {SUP}), p WHERE regexp_matches(substr(seq, CAST(i AS INT), CAST(size AS INT)), form))"""


@query("restriction_cuts_both_strands", f"WITH {_CUTS} SELECT id, enzyme, position FROM w")
def restriction_cuts_both_strands(spark, sf):
    return restriction.cut_positions(d.sequences(spark, sf, "supplier"), ENZYMES)


@query("restriction_cutters_both_strands", f"WITH {_CUTS} SELECT s.id, e.enzyme, count(w.position) AS cuts FROM {SUP} s CROSS JOIN e LEFT JOIN w ON w.id = s.id AND w.enzyme = e.enzyme GROUP BY s.id, e.enzyme")
def restriction_cutters_both_strands(spark, sf):
    return restriction.cuts_by_enzyme(d.sequences(spark, sf, "supplier"), ENZYMES)


@query("restriction_digest_both_strands", f'WITH {_CUTS}, p2 AS (SELECT DISTINCT id, position FROM w UNION SELECT id, length(seq) FROM {SUP}), f AS (SELECT id, lag(position, 1, 0) OVER (PARTITION BY id ORDER BY position) + 1 AS start, position AS "end" FROM p2) SELECT id, start, "end", "end" - start + 1 AS size FROM f WHERE start <= "end"')
def restriction_digest_both_strands(spark, sf):
    return restriction.fragments(d.sequences(spark, sf, "supplier"), ENZYMES)


# Two networks over the same suppliers: the tree, with a second parent for some of its nodes.
NETS = {"a": (5, 7, 4, 1), "b": (7, 3, 3, 2)}


def _nets(spark, sf) -> DataFrame:
    tree, supplier, nation = d.tree(spark, sf), d.table(spark, sf, "supplier"), d.table(spark, sf, "nation")
    out = None
    for name, (every, shift, every_nation, shift_region) in NETS.items():
        more = supplier.filter(F.col("s_suppkey") % every == 0).select((F.col("s_suppkey") + 1000).alias("node"), ((F.col("s_nationkey") + shift) % 25 + 100).alias("parent"))
        over = nation.filter(F.col("n_nationkey") % every_nation == 0).select((F.col("n_nationkey") + 100).alias("node"), ((F.col("n_regionkey") + shift_region) % 5 + 1).alias("parent"))
        one = tree.select("node", "parent").union(more).union(over).selectExpr(f"'{name}' AS net", "cast(node AS long) AS node", "cast(parent AS long) AS parent")
        out = one if out is None else out.unionByName(one)
    return out


NETS_SQL = "(SELECT DISTINCT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{name}' AS net, node, parent FROM {d.TREE_SQL} UNION ALL SELECT '{name}', CAST(s_suppkey + 1000 AS BIGINT), CAST((s_nationkey + {shift}) % 25 + 100 AS BIGINT) FROM supplier WHERE s_suppkey % {every} = 0
    UNION ALL SELECT '{name}', CAST(n_nationkey + 100 AS BIGINT), CAST((n_regionkey + {shift_region}) % 5 + 1 AS BIGINT) FROM nation WHERE n_nationkey % {every_nation} = 0"""
    for name, (every, shift, every_nation, shift_region) in NETS.items()
) + "))"
# Every path from a leaf up, one row per path and node on it; and every whole path, as a list.
_PATHS = f"""WITH RECURSIVE n AS MATERIALIZED {NETS_SQL}, leaf AS (SELECT DISTINCT net, node FROM n WHERE (net, node) NOT IN (SELECT (net, parent) FROM n WHERE parent IS NOT NULL)),
up(net, leaf, node, steps, path) AS (SELECT net, node, node, 0, [node] FROM leaf UNION ALL SELECT up.net, leaf, n.parent, steps + 1, list_append(path, n.parent) FROM up JOIN n ON n.net = up.net AND n.node = up.node WHERE n.parent IS NOT NULL),
mu AS (SELECT net, node, leaf, count(*) AS paths FROM up GROUP BY net, node, leaf),
whole AS (SELECT net, leaf, path FROM up WHERE node = 0), many AS (SELECT net, leaf, count(*) AS total FROM whole GROUP BY net, leaf),
thr AS (SELECT net, leaf, node, count(*) AS through FROM (SELECT net, leaf, unnest(path) AS node FROM whole) GROUP BY net, leaf, node),
tri AS (SELECT g.net, g.node, g.leaf, CASE WHEN through IS NULL THEN 'C' WHEN through = total THEN 'A' ELSE 'B' END AS part
  FROM (SELECT v.net, v.node, l.node AS leaf FROM (SELECT DISTINCT net, node FROM n) v JOIN leaf l ON l.net = v.net) g LEFT JOIN thr ON thr.net = g.net AND thr.leaf = g.leaf AND thr.node = g.node LEFT JOIN many ON many.net = g.net AND many.leaf = g.leaf) """


@query("graph_ancestors", _PATHS + "SELECT node AS term, anc AS ancestor, CAST(min(levels) AS INT) AS levels FROM (SELECT net, path[i] AS node, path[j] AS anc, j - i AS levels FROM (SELECT net, path, unnest(range(1, len(path))) AS i FROM whole), (SELECT unnest(range(2, 9)) AS j) WHERE j > i AND j <= len(path)) WHERE net = 'a' GROUP BY node, anc")
def graph_ancestors(spark, sf):
    return hierarchy.ancestor_terms(_nets(spark, sf).filter("net = 'a'"))


@query("graph_parents", f"SELECT node AS term, parent FROM {NETS_SQL} WHERE net = 'b' AND parent IS NOT NULL")
def graph_parents(spark, sf):
    return hierarchy.parent_terms(_nets(spark, sf).filter("net = 'b'")).distinct()


@query("network_heights", _PATHS + "SELECT net, node, CAST(max(steps) AS BIGINT) AS height FROM up GROUP BY net, node")
def network_heights(spark, sf):
    return networks.heights(_nets(spark, sf))


@query("network_mu", _PATHS + "SELECT net, node, leaf, paths FROM mu")
def network_mu(spark, sf):
    return networks.mu_data(_nets(spark, sf)).withColumn("paths", F.col("paths").cast("long"))


_COMPARED = "SELECT 'a' AS net1, 'b' AS net2 UNION ALL SELECT 'a', 'a'"


def _compared(spark):
    return spark.createDataFrame([("a", "b"), ("a", "a")], "net1 string, net2 string")


@query("network_mu_distance", _PATHS + f""", v AS (SELECT net, node, string_agg(leaf || ':' || paths, ',' ORDER BY leaf) AS vec FROM mu GROUP BY net, node), c AS (SELECT net, vec, count(*) AS times FROM v GROUP BY net, vec),
s AS (SELECT net1, net2, vec, abs(sum(CASE WHEN side = 1 THEN times ELSE -times END)) AS apart FROM (SELECT *, net1 AS net, 1 AS side FROM ({_COMPARED}) UNION ALL SELECT *, net2, 2 FROM ({_COMPARED})) p JOIN c USING (net) GROUP BY net1, net2, vec)
SELECT net1, net2, CAST(sum(apart) AS BIGINT) AS distance FROM s GROUP BY net1, net2""")
def network_mu_distance(spark, sf):
    return networks.mu_distance(_nets(spark, sf), _compared(spark))


@query("network_tripartitions", _PATHS + "SELECT net, node, count(*) FILTER (part = 'A') AS strict, count(*) FILTER (part = 'B') AS some, count(*) FILTER (part = 'C') AS others FROM tri GROUP BY net, node")
def network_tripartitions(spark, sf):
    return networks.tripartition_counts(_nets(spark, sf))


@query("network_tripartition_error", _PATHS + f""", k AS (SELECT net, node, string_agg(leaf || part, ',' ORDER BY leaf) AS key FROM tri GROUP BY net, node), e AS (SELECT n.net, key FROM n JOIN k USING (net, node) WHERE parent IS NOT NULL),
m AS (SELECT net1, net2, (SELECT avg(CASE WHEN key IN (SELECT key FROM e y WHERE y.net = net2) THEN 0.0 ELSE 1.0 END) FROM e x WHERE x.net = net1) AS fn, (SELECT avg(CASE WHEN key IN (SELECT key FROM e y WHERE y.net = net1) THEN 0.0 ELSE 1.0 END) FROM e x WHERE x.net = net2) AS fp FROM ({_COMPARED}))
SELECT net1, net2, round((fn + fp) / 2, 6) AS error FROM m""")
def network_tripartition_error(spark, sf):
    return networks.tripartition_error(_nets(spark, sf), _compared(spark)).withColumn("error", F.round("error", 6))


@query("network_tree_child", _PATHS + """, p AS (SELECT net, node, count(*) AS parents FROM n WHERE parent IS NOT NULL GROUP BY net, node), t AS (SELECT n.net, n.parent AS node, bool_or(parents = 1) AS ok FROM n JOIN p ON p.net = n.net AND p.node = n.node WHERE n.parent IS NOT NULL GROUP BY ALL)
SELECT net, bool_and(ok) AS tree_child FROM t GROUP BY net""")
def network_tree_child(spark, sf):
    return networks.is_tree_child(_nets(spark, sf))


# A trait of customers on the tree of regions, nations and customers that there are.
def _traits(spark, sf) -> tuple[DataFrame, DataFrame]:
    c = d.table(spark, sf, "customer").join(d.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    tips = c.select((F.col("c_custkey") + 1000).cast("long").alias("node"), (F.col("n_nationkey") + 100).cast("long").alias("parent"), F.col("c_mktsegment").alias("state"))
    nations = c.select((F.col("n_nationkey") + 100).cast("long").alias("node"), (F.col("n_regionkey") + 1).cast("long").alias("parent")).distinct()
    regions = c.select((F.col("n_regionkey") + 1).cast("long").alias("node"), F.lit(0).cast("long").alias("parent")).distinct()
    root = spark.range(1).select(F.col("id").alias("node"), F.lit(None).cast("long").alias("parent"))
    # Few customers of a kind, so that children disagree: a state of its own for most.
    odd = F.when(F.col("node") % 97 < 92, F.concat(F.lit("own"), F.col("node").cast("string"))).otherwise(F.col("state"))
    return tips.select("node", "parent").union(nations).union(regions).union(root), tips.select("node", odd.alias("state"))


def _fitch_level(name: str, below: str) -> str:
    """Sets and scores of the parents of ``below`` (node, parent, state, score): CTEs ``name``."""
    return f"""{name}_m AS (SELECT parent, state, count(*) AS n FROM {below} GROUP BY parent, state), {name}_k AS (SELECT parent, max(n) > 1 AS agreed FROM {name}_m GROUP BY parent),
{name}_s AS (SELECT parent, count(*) AS children, sum(score) AS below FROM (SELECT DISTINCT parent, node, score FROM {below}) GROUP BY parent),
{name} AS (SELECT DISTINCT m.parent AS node, u.parent, m.state, CAST(below + CASE WHEN NOT agreed AND children > 1 THEN 1 ELSE 0 END AS BIGINT) AS score FROM {name}_m m JOIN {name}_k k USING (parent) JOIN {name}_s s USING (parent) LEFT JOIN t u ON u.node = m.parent WHERE m.n > 1 OR NOT agreed)"""


def _fitch_lower(name: str, own: str, above: str) -> str:
    """Sets of ``own`` after their parents' (``above``): what is shared, or all where nothing is."""
    return f"""{name}_b AS (SELECT o.node, o.parent, o.state, a.state IS NOT NULL AS met FROM {own} o LEFT JOIN {above} a ON a.node = o.parent AND a.state = o.state), {name} AS (SELECT node, parent, state FROM (SELECT *, bool_or(met) OVER (PARTITION BY node) AS shared FROM {name}_b) WHERE met OR NOT shared)"""


_FITCH = f"""WITH c AS (SELECT CAST(c_custkey + 1000 AS BIGINT) AS node, CAST(n_nationkey + 100 AS BIGINT) AS nation, CAST(n_regionkey + 1 AS BIGINT) AS region, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT node, nation AS parent FROM c UNION ALL SELECT DISTINCT nation, region FROM c UNION ALL SELECT DISTINCT region, CAST(0 AS BIGINT) FROM c),
x AS (SELECT node, nation AS parent, CASE WHEN node % 97 < 92 THEN 'own' || CAST(node AS VARCHAR) ELSE seg END AS state, 0 AS score FROM c),
{_fitch_level('na', 'x')}, {_fitch_level('re', 'na')}, {_fitch_level('ro', 're')}, {_fitch_lower('lre', 're', 'ro')}, {_fitch_lower('lna', 'na', 'lre')},
every AS (SELECT node, state, score FROM x UNION ALL SELECT node, state, score FROM na UNION ALL SELECT node, state, score FROM re UNION ALL SELECT node, state, score FROM ro),
down AS (SELECT node, state FROM x UNION ALL SELECT node, state FROM lna UNION ALL SELECT node, state FROM lre UNION ALL SELECT node, state FROM ro),
first AS (SELECT node, min(state) AS state FROM down GROUP BY node),
p0 AS (SELECT node, parent, 1 AS p FROM x), """
_STAY = "(SELECT b.parent AS node, u.parent, 1 + min(CASE WHEN f.state = g.state THEN p ELSE 0 END) AS p FROM {0} b JOIN first f ON f.node = b.node JOIN first g ON g.node = b.parent LEFT JOIN t u ON u.node = b.parent GROUP BY b.parent, u.parent)"
_FITCH += f"p1 AS {_STAY.format('p0')}, p2 AS {_STAY.format('p1')}, p3 AS {_STAY.format('p2')} "


@query("parsimony_sets", _FITCH + "SELECT node, state, 'up' AS pass FROM every UNION ALL SELECT node, state, 'down' FROM down")
def parsimony_sets(spark, sf):
    tree, states = _traits(spark, sf)
    sets, _ = parsimony.fitch_up(tree, states)
    down = parsimony.fitch_down(tree, sets)
    return sets.withColumn("pass", F.lit("up")).unionByName(down.withColumn("pass", F.lit("down")))


@query("parsimony_scores", _FITCH + "SELECT DISTINCT node, score FROM every")
def parsimony_scores(spark, sf):
    return parsimony.fitch_up(*_traits(spark, sf))[1]


@query("trait_persistence", _FITCH + "SELECT node, f.state, CAST(p AS BIGINT) AS persistence FROM (SELECT node, p FROM p0 UNION ALL SELECT node, p FROM p1 UNION ALL SELECT node, p FROM p2 UNION ALL SELECT node, p FROM p3) q JOIN first f USING (node)")
def trait_persistence(spark, sf):
    tree, states = _traits(spark, sf)
    return parsimony.persistence(tree, parsimony.fitch_down(tree, parsimony.fitch_up(tree, states)[0]))


# Codon changes: all orders of the changes, enumerated. Groups hold several parents, so that many codons differ in two or three places.
_CODONS = """k AS MATERIALIZED (SELECT substr('TCAG', CAST(i // 16 + 1 AS INT), 1) || substr('TCAG', CAST(i // 4 % 4 + 1 AS INT), 1) || substr('TCAG', CAST(i % 4 + 1 AS INT), 1) AS c, substr('{code}', CAST(i + 1 AS INT), 1) AS aa FROM (SELECT unnest(range(64)) AS i)),
ab AS MATERIALIZED (SELECT x.c AS a, y.c AS b, x.aa AS aa1, y.aa AS aa2, hamming(x.c, y.c) AS n FROM k x, k y),
one AS MATERIALIZED (SELECT a, b, aa2 = '*' AS stop, CASE WHEN aa1 = aa2 THEN 1 WHEN aa1 = '*' OR aa2 = '*' THEN -1 ELSE 0 END AS v FROM ab WHERE n = 1),
sites AS MATERIALIZED (SELECT a AS c, sum(s) AS s FROM (SELECT a, pos, count(*) FILTER (aa1 = aa2) * 1.0 / (3 - count(*) FILTER (aa2 = '*')) AS s FROM (SELECT *, CASE WHEN a[1] <> b[1] THEN 1 WHEN a[2] <> b[2] THEN 2 ELSE 3 END AS pos FROM ab WHERE n = 1) GROUP BY a, pos) GROUP BY a),
two AS (SELECT ab.a, ab.b, sum(p.v) FILTER (NOT p.stop) + coalesce(sum(q.v) FILTER (NOT p.stop AND NOT q.stop), 0) AS kept, count(*) FILTER (NOT p.stop AND NOT q.stop) AS whole FROM ab JOIN one p ON p.a = ab.a JOIN one q ON q.a = p.b AND q.b = ab.b WHERE n = 2 GROUP BY ab.a, ab.b),
three AS (SELECT ab.a, ab.b, coalesce(sum(p.v) FILTER (NOT p.stop), 0) + coalesce(sum(q.v) FILTER (NOT p.stop AND NOT q.stop), 0) + coalesce(sum(r.v) FILTER (NOT p.stop AND NOT q.stop AND NOT r.stop), 0) AS kept, count(*) FILTER (NOT p.stop AND NOT q.stop AND NOT r.stop) AS whole
  FROM ab JOIN one p ON p.a = ab.a JOIN one q ON q.a = p.b JOIN one r ON r.a = q.b AND r.b = ab.b WHERE n = 3 AND hamming(q.b, ab.b) = 1 AND hamming(p.b, ab.b) = 2 GROUP BY ab.a, ab.b),
ch AS MATERIALIZED (SELECT a, b, 1.0 * v AS s, 1.0 - v AS n FROM one UNION ALL SELECT a, b, CASE WHEN whole > 0 THEN kept / whole ELSE 0 END, CASE WHEN whole > 0 THEN 2 - kept / whole ELSE 0 END FROM two UNION ALL SELECT a, b, CASE WHEN whole > 0 THEN kept / whole ELSE 0 END, CASE WHEN whole > 0 THEN 3 - kept / whole ELSE 0 END FROM three)""".format(code=seqfn.STANDARD_CODE)


def _ka_ks_sql(name: str, cut: str, keys: str) -> str:
    """CTEs for statistics ``name`` of pairs within ``keys`` of ``cut`` (keys, id, at, c): a row per codon."""
    on = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    own = ", ".join(f"x.{k}" for k in keys.split(", "))
    return f"""{name}_s AS (SELECT {keys}, id, sum(s) AS s FROM {cut} JOIN sites USING (c) GROUP BY {keys}, id),
{name}_p AS (SELECT {own}, x.id AS id1, y.id AS id2, 3 * count(*) AS n, sum(coalesce(ch.s, 0)) AS sd, sum(coalesce(ch.n, 0)) AS nd FROM {cut} x JOIN {cut} y ON {on} AND x.at = y.at AND x.id < y.id LEFT JOIN ch ON ch.a = x.c AND ch.b = y.c GROUP BY {own}, x.id, y.id),
{name}_t AS (SELECT p.*, (a.s + b.s) / 2 AS s, p.n - (a.s + b.s) / 2 AS ns FROM {name}_p p JOIN {name}_s a ON {" AND ".join(f"a.{k} = p.{k}" for k in keys.split(", "))} AND a.id = id1 JOIN {name}_s b ON {" AND ".join(f"b.{k} = p.{k}" for k in keys.split(", "))} AND b.id = id2),
{name} AS (SELECT *, -0.75 * ln(1 - 4 * ps / 3) AS ds, -0.75 * ln(1 - 4 * pn / 3) AS dn, 9 * ps * (1 - ps) / ((3 - 4 * ps) * (3 - 4 * ps) * n) AS vs, 9 * pn * (1 - pn) / ((3 - 4 * pn) * (3 - 4 * pn) * n) AS vn
  FROM (SELECT *, sd / s AS ps, nd / ns AS pn FROM {name}_t WHERE s > 0 AND ns > 0) WHERE ps < 0.75 AND pn < 0.75 AND ps >= 0 AND pn >= 0)"""


_MIXED = f"(SELECT *, grp % 5 AS mix FROM {SUP})"
_CUT = f"cut AS MATERIALIZED (SELECT mix, id, i AS at, substr(seq, CAST(3 * i - 2 AS INT), 3) AS c FROM (SELECT *, unnest(range(1, 22)) AS i FROM {_MIXED}))"
_NAMES = ["S", "N", "S_d", "N_d", "D_s", "D_n", "D_s_var", "D_n_var", "z_score"]


def _mixed(spark, sf):
    return d.sequences(spark, sf, "supplier").withColumn("mix", F.col("grp") % 5)


@query("ka_ks_pairs", f"""WITH {_CODONS}, {_CUT}, {_ka_ks_sql('f', 'cut', 'mix')} SELECT id1, id2, round(s, 6) AS S, round(ns, 6) AS N, round(sd, 6) AS S_d, round(nd, 6) AS N_d, round(ds, 6) AS D_s, round(dn, 6) AS D_n, round(vs, 6) AS D_s_var, round(vn, 6) AS D_n_var, round(CASE WHEN vs + vn > 0 THEN (dn - ds) / sqrt(vs + vn) ELSE 0 END, 6) AS z_score FROM f""")
def ka_ks_pairs(spark, sf):
    return codons.all_ka_ks(_mixed(spark, sf), "mix", digits=6).select("id1", "id2", *_NAMES)


_DRAW = "(CAST(('0x' || substr(md5(concat_ws('|', '1', CAST(grp AS VARCHAR), CAST(rep AS VARCHAR), CAST(i - 1 AS VARCHAR))), 1, 8)) AS BIGINT) % 21 + 1)"


@query("ka_ks_averages", f"""WITH {_CODONS}, cut AS MATERIALIZED (SELECT grp, id, i AS at, substr(seq, CAST(3 * i - 2 AS INT), 3) AS c FROM (SELECT *, unnest(range(1, 22)) AS i FROM {SUP})),
again AS MATERIALIZED (SELECT g.grp, rep, id, i AS at, c FROM (SELECT grp, rep, i, {_DRAW} AS drawn FROM (SELECT DISTINCT grp FROM cut), (SELECT unnest(range(4)) AS rep), (SELECT unnest(range(1, 22)) AS i)) g JOIN cut ON cut.grp = g.grp AND cut.at = drawn),
{_ka_ks_sql('f', 'cut', 'grp')}, {_ka_ks_sql('g', 'again', 'grp, rep')}, o AS (SELECT grp, avg(ds) AS ds, avg(dn) AS dn FROM f GROUP BY grp),
v AS (SELECT grp, var_samp(ds) AS vs, var_samp(dn) AS vn FROM (SELECT grp, rep, avg(ds) AS ds, avg(dn) AS dn FROM g GROUP BY grp, rep) GROUP BY grp)
SELECT grp, round(ds, 6) AS D_s, round(dn, 6) AS D_n, round(vs, 6) AS D_s_var, round(vn, 6) AS D_n_var, round(CASE WHEN vs + vn > 1e-12 THEN (dn - ds) / sqrt(vs + vn) END, 4) AS z_score FROM o LEFT JOIN v USING (grp)""")
def ka_ks_averages(spark, sf):
    found = codons.average_ka_ks(d.sequences(spark, sf, "supplier"), "grp", reps=4)
    z = F.when(F.col("D_s_var") + F.col("D_n_var") > 1e-12, F.col("z_score"))
    return found.select("grp", *(F.round(c, 6).alias(c) for c in ("D_s", "D_n", "D_s_var", "D_n_var")), F.round(z, 4).alias("z_score"))


@query("synonymous_sites", f"WITH {_CODONS}, {_CUT} SELECT id, round(sum(s), 6) AS sites FROM cut JOIN sites USING (c) GROUP BY id")
def synonymous_sites(spark, sf):
    made = codons.prepared(_mixed(spark, sf))
    return made.select("id", F.round(F.col("sites") / codons.SITE_PARTS, 6).alias("sites"))


# Alignment has no SQL: tests compare it with the cell-by-cell form and a plain loop.
def _shortened(spark, sf) -> DataFrame:
    """Sequences with a run of bases cut out, and some of them read from the other strand."""
    at = (F.col("ord") % 40 + 5).cast("int")
    seq = F.concat(F.substring("seq", F.lit(1), at), F.substring("seq", at + 1 + (F.col("ord") % 4).cast("int"), F.lit(d.LENGTH)))
    return d.sequences(spark, sf).select("id", "grp", F.when(F.col("ord") % 3 == 0, seqfn.reverse_complement(seq)).otherwise(seq).alias("seq"))


@query("aligned_to_references")
def aligned_to_references(spark, sf):
    """Customers' shortened sequences aligned with the sequences that the supplier of least key has in each nation."""
    s = d.sequences(spark, sf, "supplier")
    references = s.groupBy("grp").agg(F.min_by("seq", "ord").alias("refseq"))
    rows = _shortened(spark, sf).withColumnRenamed("seq", "seq1").join(references.withColumnRenamed("refseq", "seq2"), "grp")
    return pairwise_batch.aligned_pairs(rows.select("id", "grp", "seq1", "seq2"))


@query("quality_controlled")
def quality_controlled(spark, sf):
    """Customers' shortened sequences against two references; those of other nations fail."""
    s = d.sequences(spark, sf, "supplier").filter("grp IN (3, 7) OR ord = 1")
    references = s.groupBy(F.col("grp").cast("string").alias("ref")).agg(F.min_by("seq", "ord").alias("refseq"))
    return pairwise_batch.quality_controlled(_shortened(spark, sf), references, 0.2)
