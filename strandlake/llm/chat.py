"""Chat formatting after collapsing cumulative snapshots of a conversation.

Logs often hold a conversation again each time it grew. Every turn gets the
rolling hash of its prefix: the running XOR, by turn, of 128 bits of hash of
(position, role, text). A conversation whose whole hash is a proper prefix's
hash of another is a snapshot of that one; an anti-join drops it. Of equal
conversations the least conv_id stays. The rest are rendered.

SQL functions only. Turns are dealt by conversation once; the anti-join sees one
row per distinct conversation and one per distinct prefix, so a conversation or
a first turn that a third of the log repeats is one row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import table

#: The template's marks, and what stands for them inside a text.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
MARK, MARK_IN_TEXT = "<|", "< |"
#: Names of roles in logs.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant"}


def _role(role: Column) -> Column:
    low = F.lower(F.trim(role))
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.when(F.coalesce(low, F.lit("")) == "", "user").otherwise(F.coalesce(F.get(F.array(known[low]), F.lit(0)), low))


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, turns (role, text, in order) of the maximal conversations.

    Turns are ordered by turn (null first), then role and text; a null role is
    ``user``, a null text empty, before comparison. Turns with a null conv_id
    belong to no conversation and are dropped. Repeated turns count each.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _role(F.col("role").cast("string")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("at", F.row_number().over(order))
    rolling = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, seed in (("h1", 1), ("h2", 2)):
        rows = rows.withColumn(name, F.bit_xor(F.xxhash64(F.lit(seed), "at", "role", "text")).over(rolling))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", "h1", "h2"))).alias("t"))
    last = F.element_at("t", -1)
    whole = whole.select("conv_id", F.size("t").alias("n_turns"), last["h1"].alias("h1"), last["h2"].alias("h2"), "t")
    # A distinct conversation, at its least id; its turns ride along once.
    distinct = whole.groupBy("h1", "h2", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    before = F.filter("t", lambda x: x["at"] < F.size("t"))
    prefixes = whole.select(F.explode(before).alias("p")).select(F.col("p.h1").alias("h1"), F.col("p.h2").alias("h2"), F.col("p.at").alias("n_turns")).distinct()
    maximal = distinct.join(prefixes, ["h1", "h2", "n_turns"], "left_anti").select(F.col("conv_id").alias("c"), "n_copies")
    kept = whole.join(maximal, F.col("conv_id") == F.col("c"))
    return kept.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.col("n_copies").cast("long").alias("n_copies"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def render(turns: Column) -> Column:
    """Template text; the template's marks inside a text are parted, so that none is forged."""
    safe = lambda x: F.replace(x, F.lit(MARK), F.lit(MARK_IN_TEXT))
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(OPEN), safe(x["role"]), F.lit("\n"), safe(x["text"]), F.lit(CLOSE + "\n"))), "")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, n_copies (of the same conversation), rendered, per maximal conversation."""
    kept = collapse(table(spark, sf_dir, "conversations"))
    return kept.select("conv_id", "n_turns", "n_copies", render(F.col("turns")).alias("rendered"))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) AS pos, r, x
  FROM (SELECT conv_id, turn, coalesce(text, '') AS x,
          CASE WHEN coalesce(lower(trim(role)), '') = '' THEN 'user' WHEN lower(trim(role)) = 'human' THEN 'user'
               WHEN lower(trim(role)) IN ('gpt', 'bot', 'ai', 'model') THEN 'assistant' ELSE lower(trim(role)) END AS r
        FROM conversations WHERE conv_id IS NOT NULL)),
p AS (SELECT conv_id, pos, string_agg(length(r) || ':' || r || length(x) || ':' || x, '' ) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix,
        max(pos) OVER (PARTITION BY conv_id) AS n FROM t),
whole AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies, max(n) AS n_turns FROM p WHERE pos = n GROUP BY prefix),
maximal AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n))
SELECT m.conv_id, CAST(m.n_turns AS BIGINT) AS n_turns, CAST(m.n_copies AS BIGINT) AS n_copies,
  string_agg('<|im_start|>' || replace(r, '<|', '< |') || chr(10) || replace(x, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM maximal m JOIN t ON t.conv_id = m.conv_id GROUP BY ALL
"""
