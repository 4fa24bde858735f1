"""Position-specific matrices of an alignment in long form (id, pos, base)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import seqfn

BASES = ("A", "C", "G", "T")


def counts(columns: DataFrame) -> DataFrame:
    """pos, a, c, g, t: how many rows have each base there."""
    return columns.groupBy("pos").agg(*(F.count_if(F.col("base") == b).alias(b.lower()) for b in BASES))


def weights(matrix: DataFrame, pseudo: float = 1.0) -> DataFrame:
    """Log-odds (base 2) of each base against a quarter, with ``pseudo`` counts in all."""
    total = sum((F.col(b.lower()) for b in BASES), F.lit(0)) + pseudo
    odds = lambda b: F.log2((F.col(b) + pseudo / 4) / total / 0.25).alias(b)
    return matrix.select("pos", *(odds(b.lower()) for b in BASES))


def information(matrix: DataFrame) -> DataFrame:
    """Bits of each position: 2 less the entropy of its bases; none without bases."""
    total = sum((F.col(b.lower()) for b in BASES), F.lit(0))
    part = lambda b: F.when(F.col(b) > 0, F.col(b) / total * F.log2(F.col(b) / total)).otherwise(0.0)
    return matrix.select("pos", F.when(total > 0, 2 + sum((part(b.lower()) for b in BASES), F.lit(0.0))).alias("bits"))


def pattern(matrix: DataFrame) -> DataFrame:
    """Per position: the code of its bases, and they as a class of a regular expression (a dot without any)."""
    seen = F.filter(F.array(*(F.when(F.col(b.lower()) > 0, b) for b in BASES)), lambda x: x.isNotNull())
    text = F.when(F.size(seen) == 0, ".").when(F.size(seen) == 1, F.get(seen, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(seen, ""), F.lit("]")))
    return matrix.select("pos", seqfn.iupac_code(seen).alias("code"), text.alias("regexp"))


def scores(columns: DataFrame, weighted: DataFrame) -> DataFrame:
    """Sum of each row's weights (a gap or another letter counts 0)."""
    own = F.coalesce(*(F.when(F.col("base") == b, F.col(b.lower())) for b in BASES), F.lit(0.0))
    return columns.join(weighted, "pos").groupBy("id").agg(F.sum(own).alias("score"))
