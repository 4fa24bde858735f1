"""Queries on neutrality with an outgroup, two-locus statistics and a distance, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandlake.operators import otu, outgroups
from strandlake.plans import derived as d

QUERIES, ORACLES = {}, {}
SEQ, SUP = d.sequences_sql(), d.sequences_sql("supplier")


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


# Customers of a nation are the ingroup, its suppliers the outgroup.
_COUNTS = f"""WITH i AS MATERIALIZED {d.columns_sql(SEQ)}, o AS (SELECT grp, pos, count(DISTINCT base) AS n_out, min(base) AS state FROM {d.columns_sql(SUP)} GROUP BY grp, pos),
c AS (SELECT grp, pos, base, count(*) AS c FROM i GROUP BY ALL), k AS (SELECT grp, pos, sum(c) AS n, count(*) AS k, count(*) FILTER (c = 1) AS ones, CASE WHEN sum(c) > 1 THEN 1 - sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)) ELSE 0 END AS pi FROM c GROUP BY grp, pos),
m AS (SELECT grp, count(*) FILTER (c = 1) AS external, count(*) FILTER (c > 1) AS internal FROM c JOIN k USING (grp, pos) LEFT JOIN o USING (grp, pos) WHERE k > 1 AND coalesce(n_out, 0) <= 1 AND coalesce(base <> state, true) GROUP BY grp),
g AS (SELECT grp, max(n) AS n, sum(pi) AS pi, count(*) FILTER (k > 1) AS s, coalesce(sum(ones) FILTER (k > 1), 0) AS ones, coalesce(any_value(external), 0) AS ext, coalesce(any_value(internal), 0) AS internal FROM k LEFT JOIN m USING (grp) GROUP BY grp),
h AS (SELECT *, coalesce(list_sum(list_transform(range(1, CAST(n AS BIGINT)), lambda x: 1.0 / x)), 0) AS a, coalesce(list_sum(list_transform(range(1, CAST(n AS BIGINT)), lambda x: 1.0 / (x * x))), 0) AS b FROM (SELECT * REPLACE (CAST(n AS DOUBLE) AS n, CAST(s AS DOUBLE) AS s) FROM g)),
z AS (SELECT *, CASE WHEN n > 2 THEN 2 * (n * a - 2 * (n - 1)) / ((n - 1) * (n - 2)) END AS c FROM h WHERE n > 2 AND s > 0),
w AS (SELECT *, 1 + a * a / (b + a * a) * (c - (n + 1) / (n - 1)) AS vd, (c + 2 * (n * n + n + 3) / (9 * n * (n - 1)) - 2 / (n - 1)) / (a * a + b) AS vf,
  ((2 * n * n * n + 110 * n * n - 255 * n + 153) / (9 * n * n * (n - 1)) + 2 * (n - 1) * a / (n * n) - 8 * b / n) / (a * a + b) AS vs FROM z),
u AS (SELECT *, a - 1 - vd AS ud, (1 + (n + 1) / (3 * (n - 1)) - 4 * (n + 1) / ((n - 1) * (n - 1)) * (a + 1 / n - 2 * n / (n + 1))) / a - vf AS uf, (4 * n * n + 19 * n + 3 - 12 * (n + 1) * (a + 1 / n)) / (3 * n * (n - 1)) / a - vs AS us FROM w) """


@query("outgroup_mutations", _COUNTS + "SELECT grp, CAST(ext AS BIGINT) AS external, CAST(internal AS BIGINT) AS internal FROM g")
def outgroup_mutations(spark, sf):
    i, o = (d.columns(d.sequences(spark, sf, t)) for t in ("customer", "supplier"))
    return outgroups.derived_mutations(i, o, ("grp",))


@query("outgroup_neutrality", _COUNTS + """SELECT grp, CAST(n AS BIGINT) AS n, round(pi, 6) AS pi, CAST(s AS BIGINT) AS segregating, CASE WHEN ud * s + vd * s * s > 0 THEN round((s - a * ext) / sqrt(ud * s + vd * s * s), 5) END AS d,
CASE WHEN uf * s + vf * s * s > 0 THEN round((pi - ext) / sqrt(uf * s + vf * s * s), 5) END AS f, CASE WHEN us * s + vs * s * s > 0 THEN round((pi - ones * (n - 1) / n) / sqrt(us * s + vs * s * s), 5) END AS f_star FROM u""")
def outgroup_neutrality(spark, sf):
    i, o = (d.columns(d.sequences(spark, sf, t)) for t in ("customer", "supplier"))
    found = outgroups.neutrality(i, o, ("grp",)).filter("n > 2 AND segregating > 0")
    return found.select("grp", "n", F.round("pi", 6).alias("pi"), "segregating", *(F.round(c, 5).alias(c) for c in ("d", "f", "f_star")))


# A customer's two alleles at a column: its own, and that of the nation's next customer; some are missing.
def _genotypes(spark, sf):
    rows = d.sequences(spark, sf)
    rows = rows.withColumn("mate", F.lead("seq").over(Window.partitionBy("grp").orderBy("ord"))).filter("mate IS NOT NULL")
    long = rows.select("grp", F.col("ord").alias("individual"), "mate", F.posexplode(F.split("seq", "")).alias("i", "a"))
    missing = (F.col("individual") + F.col("i")) % 11 == 0
    return long.select("grp", (F.col("i") + 1).alias("marker"), "individual", F.when(~missing, F.col("a")).alias("a"), F.substring("mate", F.col("i") + 1, F.lit(1)).alias("b"))


@query("composite_disequilibrium", f"""WITH r AS (SELECT grp, ord, seq, lead(seq) OVER (PARTITION BY grp ORDER BY ord) AS mate FROM {SEQ}), g AS MATERIALIZED (SELECT grp, CAST(i AS INT) AS marker, ord, substr(seq, CAST(i AS INT), 1) AS a, substr(mate, CAST(i AS INT), 1) AS b FROM (SELECT *, unnest(range(1, 65)) AS i FROM r WHERE mate IS NOT NULL) WHERE (ord + i - 1) % 11 <> 0),
k AS (SELECT grp, marker, min(x) AS first FROM (SELECT grp, marker, a AS x FROM g UNION ALL SELECT grp, marker, b FROM g) GROUP BY grp, marker HAVING count(DISTINCT x) = 2),
e AS MATERIALIZED (SELECT grp, marker, ord, CAST(a = first AS INT) + CAST(b = first AS INT) AS dose FROM g JOIN k USING (grp, marker)),
c AS (SELECT x.grp, x.marker AS marker1, y.marker AS marker2, count(*) AS n, sum(CASE WHEN x.dose = 2 AND y.dose = 2 THEN 2.0 WHEN x.dose + y.dose = 3 THEN 1.0 WHEN x.dose = 1 AND y.dose = 1 THEN 0.5 ELSE 0 END) AS n_ab,
  sum(x.dose) / (2.0 * count(*)) AS pa, sum(y.dose) / (2.0 * count(*)) AS pb, count(*) FILTER (x.dose = 2) / count(*) AS paa, count(*) FILTER (y.dose = 2) / count(*) AS pbb FROM e x JOIN e y ON x.grp = y.grp AND x.ord = y.ord AND x.marker < y.marker GROUP BY ALL),
v AS (SELECT *, n_ab / n - 2 * pa * pb AS delta, (pa * (1 - pa) + paa - pa * pa) * (pb * (1 - pb) + pbb - pb * pb) AS v FROM c)
SELECT grp, marker1, marker2, n, round(delta, 6) AS delta, round(n * delta * delta / v, 5) AS chi_square FROM v WHERE v > 1e-12""")
def composite_disequilibrium(spark, sf):
    found = outgroups.composite_ld(_genotypes(spark, sf), ("grp",))
    return found.select("grp", "marker1", "marker2", "n", F.round("delta", 6).alias("delta"), F.round("chi_square", 5).alias("chi_square"))


_BASE_PAIRS = " ".join(f", count(*) FILTER (x = '{a}' AND y = '{b}') AS p{a}{b}" for a in "ACGT" for b in "ACGT")
_SHARES = ", ".join("(" + " + ".join(f"p{a}{b} + p{b}{a}" for b in "ACGT") + f") / (2.0 * n) AS g{a}" for a in "ACGT")
_H = " + ".join(f"CASE WHEN p{a}{b} + p{b}{a} > 0 THEN (p{a}{b} + p{b}{a}) * (p{a}{b} + p{b}{a}) / (1.0 * n * n) / 2 / (g{a} * g{b}) ELSE 0 END" for i, a in enumerate("ACGT") for b in "ACGT"[i + 1 :])


@query("tajima_nei_distances", f"""WITH p AS (SELECT a.id AS id1, b.id AS id2, unnest(string_split(a.seq, '')) AS x, unnest(string_split(b.seq, '')) AS y FROM {d.gapped_sql('supplier')} a JOIN {d.gapped_sql('supplier')} b ON a.grp % 5 = b.grp % 5 AND a.id < b.id),
c AS (SELECT id1, id2, count(*) AS n {_BASE_PAIRS} FROM p WHERE contains('ACGT', x) AND contains('ACGT', y) GROUP BY id1, id2), s AS (SELECT *, {_SHARES} FROM c), h AS (SELECT *, {_H} AS h, 1 - (pAA + pCC + pGG + pTT) / (1.0 * n) AS apart, gA * gA + gC * gC + gG * gG + gT * gT AS same FROM s),
b AS (SELECT *, CASE WHEN h > 0 THEN (1 - same + apart * apart / h) / 2 END AS b FROM h)
SELECT id1, id2, CASE WHEN apart = 0 THEN 0.0 WHEN 1 - apart / b > 0 THEN round(-b * ln(1 - apart / b), 6) END AS distance FROM b""")
def tajima_nei_distances(spark, sf):
    r = d.gapped(spark, sf, "supplier").select("id", (F.col("grp") % 5).alias("mix"), "seq")
    return otu.tajima_nei_pairs(r, "mix", 6).select("id1", "id2", "distance")
