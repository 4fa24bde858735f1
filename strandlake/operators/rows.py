"""Row-wise operators on an alignment: rows (ord, id, seq), in the order of ``ord``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import seqfn
from strandlake.operators import alignment, resample


def placed(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Rows with their place from 1 on, counted partition by partition."""
    return resample.numbered(rows, order).withColumn("place", (F.col("at") + 1).cast("long")).drop("at")


def by_list(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows whose id is listed (id, place), at the list's places."""
    return rows.drop("place").join(listed.select("id", "place"), "id")


def reference_first(rows: DataFrame, reference: str) -> DataFrame:
    """Places with the reference ahead of the others, which keep their order; all do where no row has that id."""
    own = F.col("id") == reference
    before = rows.filter(own).agg(F.min("ord").alias("ref_ord"))
    at = F.when(F.col("ref_ord").isNull(), F.col("place")).when(own & (F.col("ord") == F.col("ref_ord")), F.lit(1)).when(F.col("ord") < F.col("ref_ord"), F.col("place") + 1).otherwise(F.col("place"))
    return placed(rows).crossJoin(F.broadcast(before)).withColumn("place", at.cast("long")).drop("ref_ord")


def at_places(rows: DataFrame, first: int, last: int) -> DataFrame:
    return placed(rows).filter(F.col("place").between(first, last))


def at_listed_places(rows: DataFrame, places: list[int]) -> DataFrame:
    return placed(rows).filter(F.col("place").isin(places))


def with_id(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col("id") == name)


def without_ids(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("id"), "id", "left_anti")


def sliced(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Columns start to end, without rows that have only gaps there."""
    return rows.withColumn("seq", seqfn.splice(F.col("seq"), start, end)).filter(F.col("seq").rlike("[^-]"))


def masked(rows: DataFrame, start: int, end: int, mark: str = "?") -> DataFrame:
    """Letters of columns start to end become ``mark``; gaps stay."""
    inside = F.regexp_replace(seqfn.splice(F.col("seq"), start, end), "[^-]", mark)
    return rows.withColumn("seq", F.concat(F.substring("seq", 1, start - 1), inside, F.substring("seq", end + 1, 1 << 30)))


def mapped(rows: DataFrame, pattern: str, to: str) -> DataFrame:
    """Every match of a pattern in a sequence replaced."""
    return rows.withColumn("seq", F.regexp_replace("seq", pattern, to))


def undotted(rows: DataFrame, reference: str) -> DataFrame:
    """Dots become the letter of the reference row: the inverse of ``alignment.against_reference``. Without that row, rows as they are."""
    ref = rows.filter(F.col("id") == reference).agg(F.min(seqfn.characters(F.col("seq"))).alias("r"))
    full = F.array_join(F.zip_with(seqfn.characters(F.col("seq")), "r", lambda x, y: F.when(x == ".", y).otherwise(x)), "")
    return rows.crossJoin(F.broadcast(ref)).withColumn("seq", F.coalesce(full, "seq")).drop("r")


def facts(rows: DataFrame) -> DataFrame:
    """One row: sequences, length, whether all are as long, residues, the longest id."""
    size = F.length("seq")
    return rows.agg(
        F.count(F.lit(1)).alias("n_sequences"), F.max(size).cast("long").alias("length"), (F.min(size) == F.max(size)).alias("is_flush"),
        F.sum(seqfn.degapped_length(F.col("seq"))).alias("n_residues"), F.max(F.length("id")).cast("long").alias("longest_id"),
    )


def without_columns(columns: DataFrame, kind: str) -> DataFrame:
    """The long form without columns that match, mismatch, have gaps, or have nothing else; positions stay."""
    letters, gap = F.count_distinct("base"), F.max((F.col("base") == "-").cast("int")) == 1
    gone: dict[str, Column] = {"match": (letters == 1) & ~gap, "mismatch": (letters > 1) & ~gap, "gaps": gap, "all_gaps": (letters == 1) & gap}
    kept = columns.groupBy("pos").agg(gone[kind].alias("gone")).filter(~F.col("gone")).select("pos")
    return columns.join(kept, "pos", "left_semi")


def without_gaps_of(columns: DataFrame, reference: str) -> DataFrame:
    """The long form without columns where the reference row has a gap; positions stay."""
    kept = columns.filter((F.col("id") == reference) & (F.col("base") != "-")).select("pos")
    return columns.join(kept, "pos", "left_semi")


def gap_matrix(columns: DataFrame) -> DataFrame:
    return columns.select("id", "pos", (F.col("base") == "-").alias("gap"))


def codon_index(columns: DataFrame) -> DataFrame:
    """The running number of each row's codon at its residues."""
    found = alignment.residue_columns(columns)
    return found.select("id", "pos", (F.floor((F.col("residue") - 1) / 3) + 1).cast("long").alias("codon"))
