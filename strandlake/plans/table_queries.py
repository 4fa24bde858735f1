"""Queries on hits, vouchers, annotation joins and set operations, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import hits, tables
from strandlake.plans import derived as d
from strandlake.streaming.events import windowed

QUERIES, ORACLES = {}, {}
H = d.HITS_SQL


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


@query("hit_filter", f"SELECT qseqid, sseqid, mismatch, round(length / 60, 6) AS aligned, CASE WHEN pident < 80 THEN 'identity' WHEN length / 60 < 0.6 THEN 'length' END AS reason, NOT (pident < 80 OR length / 60 < 0.6) AS passed FROM {H}")
def hit_filter(spark, sf):
    return hits.judged(d.hits(spark, sf), 60).select("qseqid", "sseqid", "mismatch", F.round("aligned", 6).alias("aligned"), "reason", "passed")


@query("hit_ranks", f"SELECT qseqid, sseqid, sstart, CAST(row_number() OVER (PARTITION BY qseqid ORDER BY bitscore DESC, sseqid, pident DESC, sstart) AS INT) AS rank FROM {H}")
def hit_ranks(spark, sf):
    return hits.ranked(d.hits(spark, sf)).select("qseqid", "sseqid", "sstart", "rank")


@query("best_hits", f"SELECT qseqid, max(bitscore) AS bitscore FROM {H} GROUP BY qseqid")
def best_hits(spark, sf):
    return hits.best(d.hits(spark, sf)).select("qseqid", "bitscore")


@query("unique_queries", f"SELECT qseqid FROM {H} GROUP BY qseqid HAVING count(*) = 1")
def unique_queries(spark, sf):
    return hits.unique_queries(d.hits(spark, sf))


@query("hit_counts", f"SELECT qseqid, count(*) AS n FROM {H} GROUP BY qseqid")
def hit_counts(spark, sf):
    return hits.hit_counts(d.hits(spark, sf))


@query("genome_intervals", f"""SELECT qseqid, mismatch, CAST(greatest(1, least(sstart, send) - CASE WHEN sstart > send THEN 120 - qend ELSE qstart - 1 END) AS BIGINT) AS start, CAST(least(950, greatest(sstart, send) + CASE WHEN sstart > send THEN qstart - 1 ELSE 120 - qend END) AS BIGINT) AS "end", CASE WHEN sstart > send THEN -1 ELSE 1 END AS strand FROM {H}""")
def genome_intervals(spark, sf):
    return hits.genome_interval(d.hits(spark, sf), F.lit(120), F.lit(950)).select("qseqid", "mismatch", "start", "end", "strand")


@query("hit_tiles", f"""WITH h AS (SELECT qseqid, sseqid, least(sstart, send) AS lo, greatest(sstart, send) AS hi FROM {H}), m AS (SELECT *, CASE WHEN lo > coalesce(max(hi) OVER (PARTITION BY qseqid, sseqid ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -2) + 1 THEN 1 ELSE 0 END AS new FROM h),
t AS (SELECT qseqid, sseqid, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY qseqid, sseqid ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m) GROUP BY qseqid, sseqid, g) SELECT qseqid, sseqid, count(*) AS tiles, CAST(sum(hi - lo + 1) AS BIGINT) AS covered FROM t GROUP BY qseqid, sseqid""")
def hit_tiles(spark, sf):
    return hits.tiled(d.hits(spark, sf))


@query("hit_labels", f"SELECT concat_ws('|', qseqid, sseqid, length, mismatch) AS label, round(length / 60 * 100, 6) AS matched FROM {H}")
def hit_labels(spark, sf):
    return hits.matched_percent(hits.labels(d.hits(spark, sf)), 60).select("label", F.round("matched", 6).alias("matched"))


_TAGS = "(SELECT user_id, event_id, event_type, CASE WHEN event_id % 10 = 0 THEN event_type END AS t FROM events)"


@query("carried_tags", f"SELECT CAST(event_id AS BIGINT) AS ord, tag FROM (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS tag FROM {_TAGS}) WHERE t IS NULL")
def carried_tags(spark, sf):
    e = d.table(spark, sf, "events").select(F.col("user_id").alias("part"), F.col("event_id").cast("long").alias("ord"), "event_type")
    return tables.carried_tag(e, F.col("ord") % 10 == 0, F.col("event_type")).select("ord", "tag")


@query("first_per_key", "SELECT CAST(o_custkey AS BIGINT) AS k, CAST(min(o_orderkey) AS BIGINT) AS o FROM orders GROUP BY o_custkey")
def first_per_key(spark, sf):
    o = d.table(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("k"), F.col("o_orderkey").cast("long").alias("o"))
    return tables.first_per_key(o, "k", "o")


@query("last_per_key", "SELECT CAST(o_custkey AS BIGINT) AS k, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey")
def last_per_key(spark, sf):
    return tables.last_per_key(d.table(spark, sf, "orders").withColumn("k", F.col("o_custkey").cast("long")), "k", "o_orderpriority", "o_orderkey")


@query("without_repeated_keys", "SELECT CAST(l_orderkey AS BIGINT) AS o, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1)")
def without_repeated_keys(spark, sf):
    return tables.without_repeated(d.table(spark, sf, "lineitem"), "l_orderkey").select(F.col("l_orderkey").cast("long").alias("o"), "l_quantity")


@query("repeated_keys", "SELECT CAST(o_custkey AS BIGINT) AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def repeated_keys(spark, sf):
    return tables.repeated_keys(d.table(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("k")), "k")


@query("master_order", "SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_custkey * 3 AS BIGINT) AS ord, coalesce(m, 'NA') AS o_orderpriority FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS m FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def master_order(spark, sf):
    master = d.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("k"), (F.col("c_custkey") * 3).cast("long").alias("ord"))
    return tables.in_master_order(master, d.table(spark, sf, "orders").withColumn("k", F.col("o_custkey").cast("long")), "k", "o_orderpriority")


@query("vouchers_with_all_genes", "SELECT CAST(l_orderkey AS BIGINT) AS voucher FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 3")
def vouchers_with_all_genes(spark, sf):
    return tables.having_all(d.table(spark, sf, "lineitem").withColumn("voucher", F.col("l_orderkey").cast("long")), "voucher", "l_returnflag", ["A", "N", "R"])


@query("memoised_search", "SELECT CAST(o_orderkey AS BIGINT) AS o, md5(o_orderpriority) AS found FROM orders")
def memoised_search(spark, sf):
    o = d.table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("o"), "o_orderpriority")
    return tables.memoised(o, "o_orderpriority", lambda k: k.withColumn("found", F.md5("o_orderpriority"))).select("o", "found")


@query("delimitation_evaluation", "SELECT t.taxon, coalesce(n_name, 'NA') AS label, CAST(n_nationkey AS BIGINT) AS value FROM (VALUES ('AN'), ('nation_1'), ('NATION'), ('zz'), ('A')) t(taxon) LEFT JOIN nation ON contains(n_name, t.taxon)")
def delimitation_evaluation(spark, sf):
    taxa = spark.createDataFrame([("AN",), ("nation_1",), ("NATION",), ("zz",), ("A",)], "taxon string")
    summary = d.table(spark, sf, "nation").select(F.col("n_name").alias("label"), F.col("n_nationkey").cast("long").alias("value"))
    return tables.evaluated(taxa, summary)


@query("side_by_side", "SELECT CAST(s_suppkey AS BIGINT) AS ord, s_name AS id, s_name || coalesce(c_name, '') AS seq FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey")
def side_by_side(spark, sf):
    a = d.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("ord"), F.col("s_name").alias("id"), F.col("s_name").alias("seq"))
    b = d.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("ord"), F.col("c_name").alias("id"), F.col("c_name").alias("seq"))
    return tables.side_by_side(a, b)


@query("quality_checked", "SELECT CAST(c_custkey AS BIGINT) AS accession, coalesce(o, 'failedqc') AS otu FROM customer LEFT JOIN (SELECT o_custkey, 'otu' || min(o_orderkey) AS o FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def quality_checked(spark, sf):
    rows = d.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("accession"))
    passed = d.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("long").alias("accession")).agg(F.concat(F.lit("otu"), F.min("o_orderkey").cast("string")).alias("otu"))
    return tables.quality_checked(rows, passed)


@query("sharded_buckets", "SELECT CAST(o_orderkey AS BIGINT) AS o, CAST(floor((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) / 100) AS BIGINT) AS bucket FROM orders")
def sharded_buckets(spark, sf):
    rows = d.table(spark, sf, "orders").withColumn("part", F.col("o_orderstatus"))
    return tables.buckets(rows, "o_orderkey", 100).select(F.col("o_orderkey").cast("long").alias("o"), F.col("bucket").cast("long").alias("bucket"))


@query("table_union", "SELECT s_name AS name, CAST(s_nationkey AS INT) AS nation, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_name, CAST(c_nationkey AS INT), c_acctbal, c_mktsegment FROM customer")
def table_union(spark, sf):
    s = d.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("int").alias("nation"), F.col("s_acctbal").alias("balance"))
    c = d.table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").cast("int").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("nations_of_both", "SELECT CAST(s_nationkey AS INT) AS nation FROM supplier INTERSECT SELECT CAST(c_nationkey AS INT) FROM customer")
def nations_of_both(spark, sf):
    return d.table(spark, sf, "supplier").select(F.col("s_nationkey").cast("int").alias("nation")).intersect(d.table(spark, sf, "customer").select(F.col("c_nationkey").cast("int")))


@query("not_found", "SELECT CAST(p_partkey AS BIGINT) AS id FROM part EXCEPT SELECT CAST(l_partkey AS BIGINT) FROM lineitem WHERE l_quantity > 45")
def not_found(spark, sf):
    return d.table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("id")).subtract(d.table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").cast("long")))


@query("nearest_names", "SELECT w, p AS nearest, CAST(dist AS INT) AS distance FROM (SELECT w, p_name AS p, levenshtein(w, p_name) AS dist, row_number() OVER (PARTITION BY w ORDER BY levenshtein(w, p_name), p_name) AS k FROM (SELECT DISTINCT p_name FROM part) x, (SELECT DISTINCT 'x' || p_name AS w FROM part WHERE p_partkey <= 20) y) WHERE k = 1")
def nearest_names(spark, sf):
    p = d.table(spark, sf, "part")
    words = p.filter("p_partkey <= 20").select(F.concat(F.lit("x"), "p_name").alias("w")).distinct()
    pairs = p.select("p_name").distinct().join(F.broadcast(words)).withColumn("d", F.levenshtein("w", "p_name"))
    return pairs.groupBy("w").agg(F.min(F.struct("d", "p_name")).alias("m")).select("w", F.col("m.p_name").alias("nearest"), F.col("m.d").alias("distance"))


@query("nearest_names_all", "WITH n AS (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL) SELECT w, p AS nearest, CAST(dist AS INT) AS distance FROM (SELECT 'x' || y.p_name AS w, x.p_name AS p, levenshtein('x' || y.p_name, x.p_name) AS dist FROM n x, n y) QUALIFY row_number() OVER (PARTITION BY w ORDER BY dist, p) = 1")
def nearest_names_all(spark, sf):
    names = d.table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    return tables.nearest(names.select(F.concat(F.lit("x"), "name").alias("w")), names)


@query("event_windows", "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    return windowed(d.table(spark, sf, "events")).withColumn("total", F.round("total", 4))
