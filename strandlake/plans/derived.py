"""Relations with the shapes of biological data, derived from the TPC-like tables.

Sequences come from MD5 digits, so that Spark and any SQL engine derive the same:
a parent of 64 bases per group, and in each member one base changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parent(group: Column) -> Column:
    text = group.cast("string")
    return F.translate(F.concat(F.md5(F.concat(F.lit("a"), text)), F.md5(F.concat(F.lit("b"), text))), "0123456789abcdef", "ACGTACGTACGTACGT")


def _member(group: Column, key: Column) -> Column:
    parent, at = _parent(group), (key % LENGTH + 1).cast("int")
    changed = F.translate(F.substring(parent, at, F.lit(1)), "ACGT", "CGTA")
    return F.concat(F.substring(parent, F.lit(1), at - 1), changed, F.substring(parent, at + 1, F.lit(LENGTH)))


def sequences(spark: SparkSession, sf_dir: str, name: str = "customer", parts: int | None = None) -> DataFrame:
    """ord, id (zero-padded), grp, name (of the group), seq; made in so many tasks, as a table of few columns may be one file's only one."""
    c = name[0]
    rows = table(spark, sf_dir, name).select(F.col(f"{c}_{'cust' if c == 'c' else 'supp'}key").cast("long").alias("ord"), F.col(f"{c}_nationkey").cast("int").alias("grp"))
    rows = rows if parts is None else rows.repartition(parts, "ord")
    return rows.select("ord", F.lpad(F.col("ord").cast("string"), 10, "0").alias("id"), "grp", F.concat(F.lit("Genus_nation"), F.col("grp").cast("string")).alias("name"), _member(F.col("grp"), F.col("ord")).alias("seq"))


def sequences_sql(name: str = "customer") -> str:
    c = name[0]
    key, grp = f"{c}_{'cust' if c == 'c' else 'supp'}key", f"{c}_nationkey"
    parent = f"translate(concat(md5(concat('a', CAST({grp} AS VARCHAR))), md5(concat('b', CAST({grp} AS VARCHAR)))), '0123456789abcdef', 'ACGTACGTACGTACGT')"
    at = f"CAST({key} % {LENGTH} AS INT)"
    return f"""(SELECT CAST({key} AS BIGINT) AS ord, lpad(CAST({key} AS VARCHAR), 10, '0') AS id, CAST({grp} AS INT) AS grp, concat('Genus_nation', CAST({grp} AS VARCHAR)) AS name,
    concat(substr(p, 1, {at}), translate(substr(p, {at} + 1, 1), 'ACGT', 'CGTA'), substr(p, {at} + 2)) AS seq FROM (SELECT *, {parent} AS p FROM {name}))"""


def gapped(spark: SparkSession, sf_dir: str, name: str = "customer", parts: int | None = None) -> DataFrame:
    """As ``sequences``, with gaps at both ends and an N, by the key."""
    rows = sequences(spark, sf_dir, name, parts)
    head, tail, at = (F.col("ord") % 4).cast("int"), (F.col("ord") % 5).cast("int"), (F.col("ord") % 31 + 10).cast("int")
    seq = F.concat(F.repeat(F.lit("-"), head), F.substring(F.col("seq"), head + 1, at - head - 1), F.when(F.col("ord") % 3 == 0, "N").otherwise(F.substring(F.col("seq"), at, F.lit(1))), F.substring(F.col("seq"), at + 1, LENGTH - tail - at), F.repeat(F.lit("-"), tail))
    return rows.withColumn("seq", seq)


def gapped_sql(name: str = "customer") -> str:
    head, tail, at = "CAST(ord % 4 AS INT)", "CAST(ord % 5 AS INT)", "CAST(ord % 31 + 10 AS INT)"
    return f"""(SELECT ord, id, grp, name, concat(repeat('-', {head}), substr(seq, {head} + 1, {at} - {head} - 1), CASE WHEN ord % 3 = 0 THEN 'N' ELSE substr(seq, {at}, 1) END,
    substr(seq, {at} + 1, {LENGTH} - {tail} - {at}), repeat('-', {tail})) AS seq FROM {sequences_sql(name)})"""


def columns(aligned: DataFrame) -> DataFrame:
    """An alignment in long form: id, grp, pos (from 1), base."""
    return aligned.select("id", "grp", F.posexplode(F.regexp_extract_all("seq", F.lit("."), F.lit(0))).alias("at", "base")).select("id", "grp", (F.col("at") + 1).alias("pos"), "base")


def columns_sql(source: str) -> str:
    return f"(SELECT id, grp, CAST(i AS INT) AS pos, substr(seq, CAST(i AS INT), 1) AS base FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM {source}))"


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, id: delimited identifiers of 1 to 5 fields, from parts."""
    p = table(spark, sf_dir, "part")
    f = [F.concat(F.lit("P"), F.col("p_partkey").cast("string")), F.concat(F.lit("Genus species"), F.col("p_size").cast("string")), F.when(F.col("p_partkey") % 2 == 0, "COI_5P").otherwise(F.col("p_brand")), F.when(F.col("p_partkey") % 3 == 0, "COI_5P").otherwise(F.lit("Abcde_fghij")), F.lit("x")]
    n = F.col("p_partkey") % 5
    made = F.when(n == 0, f[0])
    for k in range(2, 6):
        made = made.when(n == k - 1, F.concat_ws("|", *f[:k]))
    return p.select(F.col("p_partkey").cast("long").alias("ord"), made.alias("id"))


IDENTIFIERS_SQL = """(SELECT CAST(p_partkey AS BIGINT) AS ord, CASE p_partkey % 5 WHEN 0 THEN f0 WHEN 1 THEN concat_ws('|', f0, f1) WHEN 2 THEN concat_ws('|', f0, f1, f2)
  WHEN 3 THEN concat_ws('|', f0, f1, f2, f3) ELSE concat_ws('|', f0, f1, f2, f3, 'x') END AS id
  FROM (SELECT p_partkey, 'P' || p_partkey AS f0, 'Genus species' || p_size AS f1, CASE WHEN p_partkey % 2 = 0 THEN 'COI_5P' ELSE p_brand END AS f2, CASE WHEN p_partkey % 3 = 0 THEN 'COI_5P' ELSE 'Abcde_fghij' END AS f3 FROM part))"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity hits (12 columns) from line items; the query is the order."""
    n = table(spark, sf_dir, "lineitem")
    at = (F.col("l_partkey") % 900 + 1).cast("int")
    size = (F.col("l_quantity") * 2).cast("int")
    flip = F.col("l_linenumber") % 2 == 0
    return n.select(
        F.col("l_orderkey").cast("string").alias("qseqid"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("sseqid"), (100 - F.col("l_discount") * 300).alias("pident"), size.alias("length"), F.col("l_linenumber").cast("int").alias("mismatch"), F.lit(0).alias("gapopen"),
        F.lit(1).alias("qstart"), size.alias("qend"), F.when(flip, at + size).otherwise(at).alias("sstart"), F.when(flip, at).otherwise(at + size).alias("send"), F.lit(0.0).alias("evalue"), F.col("l_extendedprice").alias("bitscore"),
    )


HITS_SQL = """(SELECT CAST(l_orderkey AS VARCHAR) AS qseqid, 's' || l_suppkey AS sseqid, 100 - l_discount * 300 AS pident, CAST(trunc(l_quantity * 2) AS INT) AS length, CAST(l_linenumber AS INT) AS mismatch, 0 AS gapopen,
  1 AS qstart, CAST(trunc(l_quantity * 2) AS INT) AS qend, CASE WHEN l_linenumber % 2 = 0 THEN a + CAST(trunc(l_quantity * 2) AS INT) ELSE a END AS sstart, CASE WHEN l_linenumber % 2 = 0 THEN a ELSE a + CAST(trunc(l_quantity * 2) AS INT) END AS send,
  CAST(0 AS DOUBLE) AS evalue, l_extendedprice AS bitscore FROM (SELECT *, CAST(l_partkey % 900 + 1 AS INT) AS a FROM lineitem))"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, start, end (1-based, closed), strand, id: from orders, a sequence per 50 customers."""
    o = table(spark, sf_dir, "orders")
    start = (F.col("o_orderkey") * 37 % 5000 + 1).cast("int")
    return o.select(F.concat(F.lit("chr"), F.floor(F.col("o_custkey") / 50).cast("string")).alias("seq_id"), start.alias("start"), (start + (F.col("o_custkey") % 40).cast("int")).alias("end"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("strand"), F.col("o_orderkey").cast("long").alias("id"))


RANGES_SQL = """(SELECT 'chr' || CAST(floor(o_custkey / 50) AS BIGINT) AS seq_id, CAST(o_orderkey * 37 % 5000 + 1 AS INT) AS start, CAST(o_orderkey * 37 % 5000 + 1 + o_custkey % 40 AS INT) AS "end", CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS strand, CAST(o_orderkey AS BIGINT) AS id FROM orders)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, parent, label, length: world, regions, nations, suppliers."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    root = spark.createDataFrame([(0, None, "world", 0.0)], "node long, parent long, label string, length double")
    return (
        root.unionByName(region.select((F.col("r_regionkey") + 1).cast("long").alias("node"), F.lit(0).cast("long").alias("parent"), F.col("r_name").alias("label"), F.lit(1.0).alias("length")))
        .unionByName(nation.select((F.col("n_nationkey") + 100).cast("long").alias("node"), (F.col("n_regionkey") + 1).cast("long").alias("parent"), F.col("n_name").alias("label"), (1 + F.col("n_nationkey") / 10).alias("length")))
        .unionByName(supplier.select((F.col("s_suppkey") + 1000).cast("long").alias("node"), (F.col("s_nationkey") + 100).cast("long").alias("parent"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("label"), F.lit(0.5).alias("length")))
    )


TREE_SQL = """(SELECT CAST(0 AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent, 'world' AS label, CAST(0 AS DOUBLE) AS length UNION ALL SELECT CAST(r_regionkey + 1 AS BIGINT), 0, r_name, 1.0 FROM region
  UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), CAST(n_regionkey + 1 AS BIGINT), n_name, 1 + n_nationkey / 10 FROM nation UNION ALL SELECT CAST(s_suppkey + 1000 AS BIGINT), CAST(s_nationkey + 100 AS BIGINT), 's' || s_suppkey, 0.5 FROM supplier)"""
