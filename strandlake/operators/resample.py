"""Resampling with explicit seeds. A draw is a hash of (seed, replicate, number),
so that replicates are rows of one job and reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def draw(n: Column, *keys, seed: int = 1) -> Column:
    """A number from 0 to n - 1."""
    text = F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n).cast("long")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Rows with ``at`` from 0 in order, counted per partition and shifted by the counts before."""
    n = rows.rdd.getNumPartitions() if rows.sparkSession is None else int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()).checkpoint()
    own = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    before = F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    base = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("c")).select("__p", F.coalesce(before, F.lit(0)).alias("base"))
    return placed.withColumn("own", own).join(F.broadcast(base), "__p").withColumn("at", F.col("own") + F.col("base")).drop("__p", "own", "base")


def bootstrap_rows(spark: SparkSession, rows: DataFrame, reps: int, size: int, seed: int = 1) -> DataFrame:
    """``size`` draws with replacement per replicate from rows numbered ``at``: rep, k and the row."""
    n = rows.count()
    draws = spark.range(reps * size).select(F.floor(F.col("id") / size).alias("rep"), (F.col("id") % size).alias("k"))
    draws = draws.withColumn("at", draw(F.lit(max(n, 1)), F.col("rep"), F.col("k"), seed=seed))
    return draws.join(rows, "at")


def column_weights(length: int, reps: int, spark: SparkSession, seed: int = 1) -> DataFrame:
    """rep, weights: how often each of ``length`` columns is drawn; a replicate's weights sum to ``length``."""
    grid = spark.range(reps).select(F.col("id").alias("rep"))
    draws = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: draw(F.lit(length), F.col("rep"), k, seed=seed))
    tally = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda p: F.size(F.filter("d", lambda x: x == p)))
    return grid.withColumn("d", draws).select("rep", tally.alias("weights"))


def bootstrap_columns(columns: DataFrame, length: int, reps: int, seed: int = 1) -> DataFrame:
    """Alignments of drawn columns: rep, id, pos, base."""
    spark = columns.sparkSession
    draws = spark.range(reps * length).select(F.floor(F.col("id") / length).alias("rep"), (F.col("id") % length).alias("k"))
    draws = draws.withColumn("from", draw(F.lit(length), F.col("rep"), F.col("k"), seed=seed) + 1)
    return draws.join(columns, F.col("from") == F.col("pos")).select("rep", "id", (F.col("k") + 1).alias("pos"), "base")


def random_pairs(spark: SparkSession, rows: DataFrame, samples: int, seed: int = 1) -> DataFrame:
    """Drawn pairs of different rows numbered ``at``: k, at1, at2."""
    n = F.lit(max(rows.count(), 1))
    draws = spark.range(samples).select(F.col("id").alias("k"), draw(n, F.col("id"), "a", seed=seed).alias("at1"), draw(n, F.col("id"), "b", seed=seed).alias("at2"))
    return draws.filter("at1 <> at2").dropDuplicates(["at1", "at2"])


def repeat_suffix(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Marks the second and later draws of a key with _2, _3, ..."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("label", F.when(k == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("_"), k.cast("string"))))


def shuffled(rows: DataFrame, key: str, seed: int = 1) -> DataFrame:
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))))


def random_splice(rows: DataFrame, least: int, most: int, seed: int = 1) -> DataFrame:
    """A splice of drawn size and start of every sequence (id, seq)."""
    n = F.length("seq")
    size = F.least(n, F.lit(least) + draw(F.lit(max(most - least, 1)), F.col("id"), "size", seed=seed))
    start = draw(n - size + 1, F.col("id"), "start", seed=seed) + 1
    return rows.select("id", start.alias("start"), size.alias("size"), F.substring("seq", start.cast("int"), size.cast("int")).alias("seq"))
