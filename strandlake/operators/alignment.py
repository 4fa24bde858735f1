"""Column-wise operators on an alignment in long form (id, pos, base)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import seqfn


def long_form(aligned: DataFrame) -> DataFrame:
    return aligned.select("id", F.posexplode(seqfn.characters(F.col("seq"))).alias("at", "base")).select("id", (F.col("at") + 1).alias("pos"), "base")


def wide_form(columns: DataFrame) -> DataFrame:
    """id, seq from the long form, in order of pos."""
    parts = F.sort_array(F.collect_list(F.struct("pos", "base")))
    return columns.groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["base"]), "").alias("seq"))


def column_counts(columns: DataFrame) -> DataFrame:
    return columns.groupBy("pos", "base").agg(F.count(F.lit(1)).alias("n"))


def consensus(columns: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Per column the commonest letter other than a gap (ties: the first in the alphabet), ? below ``threshold`` percent."""
    total = columns.groupBy("pos").agg(F.count(F.lit(1)).alias("rows"))
    best = column_counts(columns.filter("base <> '-'")).groupBy("pos").agg(F.max_by("base", F.struct("n", -F.ascii("base"))).alias("base"), F.max("n").alias("n"))
    return total.join(best, "pos", "left").select("pos", F.when(F.coalesce(F.col("n"), F.lit(0)) * 100 >= threshold * F.col("rows"), F.coalesce("base", F.lit("?"))).otherwise("?").alias("base"))


def consensus_iupac(columns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per column, and per alignment where ``by`` tells several apart, the code of its bases."""
    return columns.groupBy(*by, "pos").agg(seqfn.iupac_code(F.collect_set(F.when(F.col("base").isin("A", "C", "G", "T"), F.col("base")))).alias("code"))


def match_line(columns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """* where all letters of a column are one and no gap, a blank elsewhere."""
    return columns.groupBy(*by, "pos").agg(F.when((F.count_distinct("base") == 1) & (F.max("base") != "-"), "*").otherwise(" ").alias("mark"))


def gap_lines(columns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per column: whether any letter is a gap, and whether all are."""
    gap = F.col("base") == "-"
    return columns.groupBy(*by, "pos").agg(F.bool_or(gap).alias("any_gap"), F.bool_and(gap).alias("all_gap"))


def covered_columns(columns: DataFrame, share: float) -> DataFrame:
    """The alignment without columns that fewer than int(rows * share) rows cover, renumbered in order."""
    rows = columns.agg(F.count_distinct("id").alias("rows"))
    kept = columns.groupBy("pos").agg(F.count_if(F.col("base") != "-").alias("covered")).crossJoin(F.broadcast(rows)).filter(F.col("covered") >= F.floor(F.col("rows") * share)).select("pos")
    return columns.join(kept, "pos", "left_semi")


def average_identity(columns: DataFrame) -> DataFrame:
    """Equal pairs of letters over all pairs, in percent, gaps left out."""
    n = column_counts(columns.filter("base <> '-'"))
    per = n.groupBy("pos").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("equal"), F.sum("n").alias("all"))
    return per.agg((100 * F.sum("equal") / F.sum(F.col("all") * (F.col("all") - 1))).alias("identity"))


def overall_identity(columns: DataFrame) -> DataFrame:
    """Fully conserved columns over all columns, in percent."""
    return match_line(columns).agg((100 * F.count_if(F.col("mark") == "*") / F.count(F.lit(1))).alias("identity"))


def bracket_string(columns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per column its letter, or all its letters as [A/G]."""
    letters = F.array_sort(F.collect_set("base"))
    return columns.groupBy(*by, "pos").agg(letters.alias("b")).select(*by, "pos", F.when(F.size("b") == 1, F.get("b", F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join("b", "/"), F.lit("]"))).alias("text"))


def residue_columns(columns: DataFrame) -> DataFrame:
    """The column of each row's k-th residue."""
    k = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return columns.filter("base <> '-'").select("id", k.alias("residue"), "pos")


def against_reference(aligned: DataFrame, reference: str) -> DataFrame:
    """Letters equal to the reference row's become dots. Without that row, rows as they are."""
    ref = aligned.filter(F.col("id") == reference).agg(F.min(seqfn.characters(F.col("seq"))).alias("r"))
    dotted = F.array_join(F.zip_with(seqfn.characters(F.col("seq")), "r", lambda x, y: F.when(x == y, ".").otherwise(x)), "")
    return aligned.crossJoin(F.broadcast(ref)).select("id", F.when(F.col("id") == reference, F.col("seq")).otherwise(F.coalesce(dotted, "seq")).alias("seq"))


def cigar(columns: DataFrame) -> DataFrame:
    """Run lengths of letters (M) and gaps (D) of each row."""
    rows = columns.withColumn("op", F.when(F.col("base") == "-", "D").otherwise("M"))
    order = Window.partitionBy("id").orderBy("pos")
    run = F.col("pos") - F.row_number().over(Window.partitionBy("id", "op").orderBy("pos"))
    runs = rows.withColumn("run", run).groupBy("id", "op", "run").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
    parts = F.sort_array(F.collect_list(F.struct("pos", F.concat(F.col("n").cast("string"), F.col("op")).alias("t"))))
    del order
    return runs.groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("cigar"))


def unique_sequences(aligned: DataFrame) -> DataFrame:
    """Distinct sequences, their first id, and how many rows have them."""
    return aligned.groupBy("seq").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


def supermatrix(parts: DataFrame) -> DataFrame:
    """id, seq from (gene, id, seq): every gene in order, gaps for ids that lack one."""
    genes = parts.groupBy("gene").agg(F.max(F.length("seq")).alias("size"))
    grid = parts.select("id").distinct().crossJoin(F.broadcast(genes)).join(parts, ["gene", "id"], "left").withColumn("seq", F.coalesce("seq", F.expr("repeat('-', size)")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("gene", "seq"))), lambda x: x["seq"]), "")
    return grid.groupBy("id").agg(joined.alias("seq"))


def gene_partitions(parts: DataFrame) -> DataFrame:
    """Start and end of each gene in the supermatrix."""
    genes = parts.groupBy("gene").agg(F.max(F.length("seq")).alias("size"))
    end = F.sum("size").over(Window.orderBy("gene").rowsBetween(Window.unboundedPreceding, 0))
    return genes.select("gene", (end - F.col("size") + 1).cast("long").alias("start"), end.cast("long").alias("end"))


def appended(parts: DataFrame, mark: str = "\n") -> DataFrame:
    """One record per file: the first header, all sequences in order."""
    rows = F.sort_array(F.collect_list(F.struct("ord", "id", "seq")))
    return parts.groupBy("file").agg(rows.alias("r")).select("file", F.get("r", F.lit(0))["id"].alias("id"), F.array_join(F.transform("r", lambda x: x["seq"]), mark).alias("seq"))
