"""Connected components by alternating star steps over an edge table."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoints(spark: SparkSession) -> None:
    """Sets the checkpoint folder if the session has none: ``spark.checkpoint.dir``,
    or a temporary folder, which only a driver that runs the tasks itself can share."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[.*\])?$", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(named or f"file://{tempfile.gettempdir()}/strandlake-checkpoints")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (u, v) reaches.

    Every step is a minimum per node, combined before its shuffle, and a join of
    the edges with one row per node. ``checkpoint`` cuts the lineage of a step.
    """
    ensure_checkpoints(edges.sparkSession)
    loops = edges.select("u").union(edges.select("v")).distinct().select(F.col("u").alias("node"), F.col("u").alias("component"))
    edges = edges.filter("u <> v").select("u", "v").checkpoint()
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        near = large.join(least, F.col("u") == F.col("n"))
        edges = near.select("u", F.col("m").alias("v")).union(near.select(F.col("v"), F.col("m"))).filter("u <> v").distinct().checkpoint()
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return loops.join(found.withColumnRenamed("component", "least"), "node", "left").select("node", F.coalesce("least", "component").alias("component"))
