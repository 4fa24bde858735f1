"""Documents to packed training sequences, in five stages.

Each stage takes all that the one before kept, written as Parquet and read
again, so that a lost executor never reaches back over a stage. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import minhash, mixing, packing, suffix, toxicity
from strandlake.llm.common import Scratch, joinable, table

#: Words of a shingle of the near-duplicate stage; its similarity is ``minhash.PERCENT``.
SHINGLE_WORDS = 5


def fresh(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score, toxic = fresh(docs, "__score"), fresh(docs, "__toxic")
    return toxicity.score(docs, model, score, toxic).filter(F.col(toxic) == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays.

    Rows that share a doc_id are documents of their own, equal rows one; rows without
    a doc_id all stay.
    """
    scratch = Scratch(spark, "near")
    known, key, at = docs.filter("doc_id IS NOT NULL"), fresh(docs, "__key"), fresh(docs, "__at")
    own = F.col("doc_id").cast("long")
    keyed, again = known.withColumn(key, own), None
    twice = scratch.keep(known.groupBy(own.alias(at)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(at), "twice")
    if not twice.isEmpty():
        # Numbers beyond all ids stand for what ids don't tell apart; they are written, so that reruns agree.
        beyond = known.agg(F.max(own)).first()[0] + 1
        again = scratch.keep(known.join(twice, own == F.col(at), "left_semi").distinct().withColumn(key, F.monotonically_increasing_id() + beyond), "again")
        keyed = known.join(twice, own == F.col(at), "left_anti").withColumn(key, own).unionByName(again)
    found = minhash.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), scratch, SHINGLE_WORDS).select(F.col("doc_id").alias("i"), "component_id")
    if again is None:
        stays = found.filter("i = component_id").select("i")
    else:
        real = again.select(F.col(key).alias("k"), own.alias("real"))
        least = F.min(F.struct(F.coalesce("real", "i").alias("real"), "i")).alias("least")
        stays = found.join(real, F.col("i") == F.col("k"), "left").groupBy("component_id").agg(least).select("least.i")
    return keyed.join(joinable(scratch.keep(stays.toDF(at), "stays")), F.col(key) == F.col(at), "left_semi").drop(key).unionByName(docs.filter("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes and more that an earlier document holds are cut out; all rows stay."""
    return suffix.remove_repeats(docs, Scratch(spark, "cut"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share asks for."""
    return mixing.mix_documents(docs, Scratch(spark, "mix"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither training nor banding nor packing; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the pieces of the packed sequences.

    Nulls, empty and very long texts, repeated rows, an empty table and further columns,
    whatever their names, are each stage's to deal with, as its docstring and its
    operator's say; every stage but the last returns the columns that it was given.
    """
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    done = ""
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if done:
            scratch.drop(done)  # each stage reads the one before alone
        done = name
    return STAGES[-1][1](spark, docs, sf_dir)
