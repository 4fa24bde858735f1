"""All pairs of distinct sequences, with the ids of the rows that have them.

A text is a row with the ids that share it, so that what is told of two texts needs
no join to get to their rows: it is exploded twice where it was computed. Texts are
dealt in blocks, and two blocks meet in one cell of a join: a task holds the texts of
one block, and any number of tasks share the pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most ids in a row of ``texts``; a sequence that more rows have is several texts.
COPIES = 1024
#: Texts of a block, at most, and so many at least where blocks are made for the sake of tasks.
BLOCK, LEAST_BLOCK = 2048, 16


def texts(rows: DataFrame, *by: str) -> DataFrame:
    """by, seq, ids, key (of seq and the text's number): distinct sequences of rows (by, id, seq)."""
    at = F.row_number().over(Window.partitionBy(*by, "seq").orderBy("id")) - 1
    part = rows.filter("seq IS NOT NULL").select(*by, "id", "seq").withColumn("part", F.floor(at / COPIES))
    return part.groupBy(*by, "seq", "part").agg(F.collect_list("id").alias("ids")).select(*by, "seq", "ids", F.xxhash64("seq", "part").alias("key"))


def pairs(made: DataFrame, most: int, *by: str, groups: int = 1, once: bool = True) -> DataFrame:
    """Pairs within ``by`` of texts (by, key, ...), at most ``most`` in a group: all columns with 1 and with 2, and each text with itself.

    ``once``: a pair of texts comes one way round, in no particular order; else both ways.
    """
    spread = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(math.ceil(most / BLOCK), min(math.ceil(most / LEAST_BLOCK), math.isqrt(8 * spread)), 1)
    cells = groups * (blocks * (blocks + 1) // 2 if once else blocks * blocks)
    own = F.pmod(F.col("key"), F.lit(blocks)).cast("int")
    first, last = F.lit(0), F.lit(blocks - 1)

    def side(k: int) -> DataFrame:
        low, high = (own, last) if once and k == 1 else (first, own) if once else (first, last)
        dealt = made.select(*by, *(F.col(c).alias(f"{c}{k}") for c in made.columns if c not in by), own.alias(f"block{k}"), F.explode(F.sequence(low, high)).alias(f"block{3 - k}"))
        return dealt.repartition(max(spread, cells // 4), *by, "block1", "block2")

    # Merged, as the estimate of its size would have a side broadcast that is many times the table.
    found = side(1).join(side(2).hint("merge"), [*by, "block1", "block2"])
    return (found.filter("block1 < block2 OR key1 <= key2") if once else found).drop("block1", "block2")


def of_rows(found: DataFrame, once: bool = True) -> DataFrame:
    """Rows' pairs id1 < id2 from pairs of texts (key1, ids1, key2, ids2, ...)."""
    keep = [c for c in found.columns if c not in ("key1", "ids1", "key2", "ids2")]
    opened = found.select(*keep, "key1", "key2", "ids2", F.explode("ids1").alias("id1")).select(*keep, "key1", "key2", "id1", F.explode("ids2").alias("id2"))
    if not once:
        return opened.filter("id1 < id2").select("id1", "id2", *keep)
    # Texts of one key meet either way round or are the same.
    return opened.filter("id1 < id2 OR key1 <> key2 AND id1 <> id2").select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), *keep)
