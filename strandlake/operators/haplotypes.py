"""Haplotypes of gapped sequences, and thinning of alignments, in the order of the rows.

Two sequences are compatible if no column in which both have a base differs, and some
column is compared. A pair is looked for by segments of ``SEGMENT`` columns: both show the
same text in every segment that neither has a gap in. A sequence with at most
``BROKEN`` broken segments is found by any other through one of that one's ``BROKEN`` + 1
rarest whole segments; two sequences without gaps are compatible only if they are equal.
Sequences with more broken segments are compared with all of their sample.

What a loop over the rows decides one by one, whether a row stands apart from all those
kept before it, is decided in rounds: a row whose earlier neighbours are all settled
is settled, too. There are as many rounds as the longest chain of such waits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strandlake.functions import distance, seqfn
from strandlake.operators import otu
from strandlake.operators.graph import ensure_checkpoints

SEGMENT = 16
BROKEN = 3
#: Rows of a block, and those of it that are compared at a time with another block.
BLOCK, SLAB = 2048, 32
NONE = np.iinfo(np.int64).max


def kept_in_order(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``ord`` of the rows (ord) that a loop in their order keeps: those that no pair (early, late) joins with a kept one before them."""
    ensure_checkpoints(rows.sparkSession)
    open_ = rows.select("ord").distinct().checkpoint()
    waits = pairs.select("early", "late").filter("early < late").distinct().checkpoint()
    kept = None
    while not open_.isEmpty():
        free = open_.join(waits.select(F.col("late").alias("ord")), "ord", "left_anti").checkpoint()
        kept = free if kept is None else kept.union(free)
        out = waits.join(free.select(F.col("ord").alias("early")), "early", "left_semi").select(F.col("late").alias("ord")).distinct().checkpoint()
        settled = free.union(out)
        open_ = open_.join(settled, "ord", "left_anti").checkpoint()
        # A pair matters while its later row is open and its earlier one isn't out.
        waits = waits.join(settled.select(F.col("ord").alias("late")), "late", "left_anti").join(out.select(F.col("ord").alias("early")), "early", "left_anti").checkpoint()
    return rows.select("ord").limit(0) if kept is None else kept


def _blocks(texts: DataFrame) -> DataFrame:
    """sample, sparse, block, no, p: a sample's rows (sample, ord, p, sparse) in blocks of ``BLOCK``, sorted by their numbers."""
    at = F.row_number().over(Window.partitionBy("sample", "sparse").orderBy("ord")) - 1
    dealt = texts.withColumn("block", F.floor(at / BLOCK).cast("int"))
    rows = F.sort_array(F.collect_list(F.struct("ord", "p")))
    return dealt.groupBy("sample", "sparse", "block").agg(rows.alias("rows")).select("sample", "sparse", "block", F.col("rows.ord").alias("no"), F.col("rows.p").alias("p"))


def _words(planes: pa.ListArray) -> dict[str, np.ndarray]:
    """The bit planes of a block's rows, one array of words by rows for each; absent words have no base."""
    sizes = np.diff(planes.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    word = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat, out = planes.flatten(), {}
    for k, name in enumerate("vxy"):
        out[name] = np.zeros((int(sizes.max(initial=0)), len(sizes)), np.int64)
        out[name][word, row] = flat.field(k).to_numpy()
    return out


def _fits(a: dict[str, np.ndarray], b: dict[str, np.ndarray], rows: slice) -> np.ndarray:
    """Which of these rows of a and which rows of b are compatible."""
    some = apart = np.zeros((1, 1), np.int64)
    for k in range(min(len(a["v"]), len(b["v"]))):
        v, x, y = (a[c][k, rows, None] for c in "vxy")
        both = v & b["v"][k]
        some = some | both
        apart = apart | (x ^ b["x"][k] | y ^ b["y"][k]) & both
    return np.broadcast_to((apart == 0) & (some != 0), (a["v"][:, rows].shape[1], b["v"].shape[1]))


def _compared(batches: Iterator[pa.RecordBatch], least: bool) -> Iterator[pa.RecordBatch]:
    """ord1, ord2 of the compatible rows of two blocks; or of each row the least with which it is so."""
    for batch in batches:
        for i in range(batch.num_rows):
            sample, no1, no2 = (batch.column(c)[i : i + 1] for c in ("sample", "no1", "no2"))
            one, two = (_words(batch.column(c)[i].values) for c in ("p1", "p2"))
            no1, no2 = no1.flatten().to_numpy(), no2.flatten().to_numpy()
            same, low, high = np.array_equal(no1, no2), np.full(len(no1), NONE), np.full(len(no2), NONE)
            for first in range(0, len(no1), SLAB):
                rows = slice(first, first + SLAB)
                fits = _fits(one, two, rows)
                if same:
                    fits = fits & (no2 < no1[rows, None])
                if not fits.any():
                    continue
                if least:  # rows are sorted by number, so the first is the least
                    low[rows] = np.where(fits.any(1), no2[fits.argmax(1)], NONE)
                    if not same and no2[-1] > no1[0]:
                        high = np.minimum(high, np.where(fits.any(0), no1[rows][np.ascontiguousarray(fits.T).argmax(1)], NONE))
                    continue
                a, b = np.nonzero(fits)
                yield from _pairs(sample, no1[rows][a], no2[b])
            if least:
                yield from _pairs(sample, low, no1)
                yield from _pairs(sample, high, no2)


def _pairs(sample: pa.Array, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs, the smaller number first; ``NONE`` is no number."""
    x, y = x[x != NONE], y[x != NONE]
    if len(x):
        yield pa.RecordBatch.from_arrays([sample.take(pa.array(np.zeros(len(x), np.int32))), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["sample", "ord1", "ord2"])


def compatible_pairs(texts: DataFrame, segment: int = SEGMENT, broken: int = BROKEN, least: bool = False) -> DataFrame:
    """sample, ord1, ord2 (ord1 < ord2) of compatible sequences (sample, ord, seq), which are distinct within a sample.

    Sparse rows are dealt in blocks, and a block is compared with another by bit planes.
    With ``least``, of a row's pairs with smaller numbers the one with the least is there,
    and not all others need be.
    """
    ensure_checkpoints(texts.sparkSession)
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = texts.select("sample", F.col("ord").cast("long").alias("ord"), "seq").repartition(n, "sample", "ord")  # else as many tasks as their few bytes ask for
    masked = spread.select("sample", "ord", F.regexp_replace(F.upper("seq"), "[^ACGT]", "-").alias("m"))
    spans = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("m") / segment).cast("int") - 1, F.lit(0)))
    parts = F.transform(spans, lambda i: F.substring(F.col("m"), i * segment + 1, F.lit(segment)))
    cut = masked.withColumn("parts", parts).withColumn("gaps", F.size(F.filter("parts", lambda t: F.contains(t, F.lit("-")))))
    solid = F.size("parts") - F.col("gaps")
    sparse = (F.col("gaps") > broken) | (solid <= broken) & (F.col("gaps") > 0)
    rows = cut.select("sample", "ord", "parts", "gaps", sparse.alias("sparse"), distance.planes(F.col("m")).alias("p")).checkpoint()
    # Rows with few gaps find others by their rarest whole segments.
    solid = rows.filter("NOT sparse")
    whole = solid.select("sample", "ord", "gaps", "p", F.posexplode("parts").alias("i", "part")).filter("part <> '' AND NOT contains(part, '-')")
    times = whole.groupBy("sample", "i", "part").agg(F.count(F.lit(1)).alias("times"))
    rare = F.row_number().over(Window.partitionBy("sample", "a").orderBy("times", "i"))
    asked = whole.filter("gaps > 0").join(times, ["sample", "i", "part"]).withColumnsRenamed({"ord": "a", "p": "pa"}).withColumn("k", rare).filter(F.col("k") <= broken + 1)
    counts = distance.plane_counts(F.col("pa"), F.col("pb"))
    met = asked.select("sample", "i", "part", "a", "pa").join(whole.select("sample", "i", "part", F.col("ord").alias("b"), F.col("p").alias("pb")), ["sample", "i", "part"]).filter("a <> b")
    met = met.withColumn("c", counts).filter("c.n > 0 AND c.ts = 0 AND c.tv = 0").select("sample", F.least("a", "b").alias("ord1"), F.greatest("a", "b").alias("ord2")).distinct()
    # Sparse rows are compared with all of their sample, block by block.
    blocks = _blocks(rows.select("sample", "ord", "p", "sparse")).checkpoint()
    side = lambda k: blocks.select("sample", *(F.col(c).alias(f"{c}{k}") for c in ("sparse", "block", "no", "p")))
    keys = lambda k: side(k).select("sample", f"sparse{k}", f"block{k}")
    dealt = keys(1).filter("sparse1").join(keys(2), "sample").filter("NOT sparse2 OR block2 <= block1")
    dealt = dealt.join(side(1), ["sample", "sparse1", "block1"]).join(side(2), ["sample", "sparse2", "block2"])
    dealt = dealt.repartition(n, "sample", "block1", "sparse2", "block2").select("sample", "no1", "p1", "no2", "p2")
    schema = StructType([texts.schema["sample"], StructField("ord1", LongType()), StructField("ord2", LongType())])
    found = dealt.mapInArrow(lambda b: _compared(b, least), schema)
    return met.union(found)


def _distinct(rows: DataFrame) -> DataFrame:
    """sample, seq, first (the ord of the first row with it)."""
    return rows.groupBy("sample", "seq").agg(F.min("ord").alias("first"))


def _by_sort(side: DataFrame) -> DataFrame:
    """For joins with as many rows as the table: Spark takes these for small by the size of their few compressed columns, and broadcasts them."""
    return side.hint("merge")


def collapsed(rows: DataFrame) -> DataFrame:
    """sample, ord, haplotype: for each row (sample, ord, seq) the first, in the order of texts, of the sample's sequences that are compatible with its own."""
    ensure_checkpoints(rows.sparkSession)
    # Written once: where sequences are derived, joins would derive them again, also to see that they are no nulls.
    rows = rows.select("sample", "ord", "seq").checkpoint()
    # Numbered in the order of texts, so that the first of a pair is its text's first.
    texts = rows.groupBy("sample", "seq").agg(F.count(F.lit(1)).alias("copies")).select("sample", "seq", F.row_number().over(Window.partitionBy("sample").orderBy("seq")).alias("no")).checkpoint()
    pairs = compatible_pairs(texts.select("sample", F.col("no").alias("ord"), "seq"), least=True)
    least = pairs.groupBy("sample", F.col("ord2").alias("no")).agg(F.min("ord1").alias("least"))
    named = texts.join(least, ["sample", "no"], "left").select("sample", "seq", F.coalesce("least", "no").alias("least"))
    named = named.join(texts.select("sample", F.col("no").alias("least"), F.col("seq").alias("haplotype")), ["sample", "least"])
    return rows.join(_by_sort(named.select("sample", "seq", "haplotype")), ["sample", "seq"]).select("sample", "ord", "haplotype")


def first_compatible(rows: DataFrame) -> DataFrame:
    """sample, ord, haplotype as a loop over each sample's rows (sample, ord, seq) gives them.

    A row has the haplotype of its own text, if that is one; else the first in the order
    of texts of the haplotypes made so far that are compatible with it; else it makes one.
    ``ord`` tells all rows apart.
    """
    ensure_checkpoints(rows.sparkSession)
    rows = rows.select("sample", "ord", "seq").checkpoint()
    texts = _distinct(rows).checkpoint()
    pairs = compatible_pairs(texts.select("sample", F.col("first").alias("ord"), "seq")).checkpoint()
    kept = kept_in_order(texts.select(F.col("first").alias("ord")), pairs.select(F.col("ord1").alias("early"), F.col("ord2").alias("late")))
    made = texts.join(kept.select(F.col("ord").alias("first")), "first", "left_semi").checkpoint()
    rest = rows.join(made.select("sample", "seq"), ["sample", "seq"], "left_anti").join(_by_sort(texts), ["sample", "seq"])
    near = pairs.select("sample", F.col("ord1").alias("first"), F.col("ord2").alias("other")).union(pairs.select("sample", "ord2", "ord1"))
    near = near.join(made.select("sample", F.col("first").alias("other"), F.col("seq").alias("haplotype")), ["sample", "other"])
    found = rest.join(near, ["sample", "first"]).filter(F.col("other") < F.col("ord")).groupBy("sample", "ord").agg(F.min("haplotype").alias("haplotype"))
    return rows.join(made.select("sample", "seq"), ["sample", "seq"], "left_semi").select("sample", "ord", F.col("seq").alias("haplotype")).unionByName(found)


def haplotype_counts(members: DataFrame, locations: DataFrame) -> DataFrame:
    """haplotype, location, members of collapsed rows (ord, haplotype) and where they are from (ord, location)."""
    return members.join(_by_sort(locations), "ord").groupBy("haplotype", "location").agg(F.count(F.lit(1)).alias("members"))


def purged(rows: DataFrame, similarity: float, length: int | None = None) -> DataFrame:
    """The rows (ord, seq) that a loop in their order keeps, which drops what is more similar than ``similarity`` to a kept one before it.

    Similarity is the share of equal bases where both have one; it is to be more than a
    half. Of rows with one text the first stays.
    """
    if not 0.5 < similarity < 1:
        raise ValueError("similarity must be between a half and one")
    texts = rows.groupBy("seq").agg(F.min("ord").alias("ord"))
    # Of all distances with so many differences the greatest, that of transitions alone.
    cutoff = -math.log(1 - 2 * min(1 - similarity, 0.4999)) / 2
    found = otu.near_pairs(texts.select(F.col("ord").alias("id"), F.regexp_replace(F.upper("seq"), "[^ACGT]", "-").alias("seq")), cutoff, 1, length)
    same = found.filter((F.col("n") - F.col("ts") - F.col("tv")) / F.col("n") > similarity)
    kept = kept_in_order(texts, same.select(F.least("id1", "id2").alias("early"), F.greatest("id1", "id2").alias("late")))
    return rows.join(kept, "ord", "left_semi")


def by_start(rows: DataFrame) -> DataFrame:
    """Rows with start (the column of the first residue, from 1) and residues, by which they are sorted."""
    first = F.length(F.regexp_extract("seq", "^[-.]*", 0)) + 1
    return rows.withColumn("start", first.cast("long")).withColumn("residues", seqfn.degapped_length(F.col("seq")))
