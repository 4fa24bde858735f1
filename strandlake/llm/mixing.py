"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its
documents. The whole part is taken outright; the fractions are copy
probabilities that are rounded in pairs: of two open documents of a source,
mass is moved from one to the other, by a random choice that keeps each
probability's mean and the pair's words, until one of them is 0 or 1. So a
source's words stay what they were up to the last open document.

A document that holds over 1 / ``LONG`` of its source's words would leave more
open than the rest can take up. Such documents, fewer than ``LONG`` a source,
are rounded first, the longest ahead, and what each gains or loses is shared
among all words of the source that are not rounded yet.

Documents are dealt to buckets by a hash of their key; a bucket leaves at most
one open document per source, and the open ones climb a reduction tree, ``FAN``
buckets to one on each level, until one per source is left, which is rounded on
its own. No task sees more than a bucket, however large a source is. Every draw
is a hash of the documents' keys, so reruns agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import WORD, Scratch, joinable, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Rows of a bucket, about, and buckets merged into one on each level of the tree.
BUCKET_ROWS = 20_000
FAN = 32
#: Documents of more than this part of their source are rounded before the others.
LONG = 1000
SEED = 20

STATE = "key long, doc_id long, source string, size long, source_size long, target double, base long, p double, done boolean, bucket long"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from one row (source, size) per document.

    Sources in code point order, null last, weigh ``weights``, repeating, and
    share ``share`` times all sizes. A target stops at ``most`` times its source
    and the excess is shared again: the targets are min(weight * level, cap),
    and the level follows in closed form from the running sums of caps and
    weights in ascending order of cap / weight. A source without words gets 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*map(F.lit, weights))
    per = per.withColumn("weight", F.get(w, (F.row_number().over(by_name) - 1) % len(weights))).withColumn("cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (share * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    level = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.withColumn("level", level).select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def draw(*keys: int) -> float:
    """A number in (0, 1) that depends on nothing but the keys."""
    raw = hashlib.blake2b(np.array((SEED, *keys), "<i8").tobytes(), digest_size=8).digest()
    return (int.from_bytes(raw, "little") + 0.5) / 2**64


def move(p: float, a: int, q: float, b: int, u: float) -> tuple[float, float]:
    """Moves mass between probabilities p and q of documents with a and b words.

    Words a*p + b*q stay; up to rounding one of the results is 0 or 1; the mean
    of each result over u is what it was.
    """
    up = min(1 - p, q * b / a)  # p rises, q falls
    down = min(p, (1 - q) * b / a)  # p falls, q rises
    step = up if u * (up + down) < down else -down
    p, q = p + step, q - step * a / b
    near = lambda x: 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
    return near(p), near(q)


def _pivot(rows: pd.DataFrame) -> pd.DataFrame:
    """Rounds a bucket: at most one document of a source stays open.

    Long documents are paired first, so that the one left open is short.
    """
    rows = rows.sort_values(["source", "size", "key", "doc_id"], ascending=[True, False, True, True], kind="stable", na_position="last").reset_index(drop=True)
    p, size, key, source, done = (rows[c].tolist() for c in ("p", "size", "key", "source", "done"))
    held: dict = {}
    for i in range(len(rows)):
        if done[i]:
            continue
        name = source[i] if isinstance(source[i], str) else None
        j = held.get(name)
        if j is None:
            held[name] = i
            continue
        p[j], p[i] = move(p[j], size[j], p[i], size[i], draw(key[j], key[i]))
        done[j], done[i] = p[j] in (0.0, 1.0), p[i] in (0.0, 1.0)
        still = [k for k in (j, i) if not done[k]]
        held[name] = still[0] if still else None
    return rows.assign(p=p, done=done)


LONG_ROW = "key long, doc_id long, source string, size long, source_size long, target double, copies long, rate double"


def _long_first(rows: pd.DataFrame, most: float) -> pd.DataFrame:
    """Copies of a source's long documents, and the copies per word (rate) left for its others.

    Means stay while the rate is between 0 and ``most``; what is beyond that is missed.
    """
    rows = rows.sort_values(["size", "key", "doc_id"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
    wanted, left, copies = float(rows.target[0]), int(rows.source_size[0]), []
    for i, (key, size) in enumerate(zip(rows["key"].tolist(), rows["size"].tolist(), strict=True)):
        rate = min(max(wanted / left, 0.0), most)
        base = int(rate + 1e-12)
        p = rate - base
        copies.append(base + int(p >= 1e-9 and draw(key, size, i) < p))
        wanted, left = wanted - copies[-1] * size, left - size
    return rows.assign(copies=copies, rate=min(max(wanted / left, 0.0), most) if left else 0.0)


def mix(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for rows (key, doc_id, source, size).

    ``key`` deals and draws; rows with equal keys are rounded each. Documents
    without words get 0 copies. An empty table gives no rows.
    """
    sizes = scratch.keep(sizes.selectExpr("cast(key as long) key", "cast(doc_id as long) doc_id", "cast(source as string) source", "size"), "sizes")
    n = sizes.count()
    targets = scratch.keep(source_targets(sizes, weights, share, most), "targets")
    buckets = max(1, -(-n // BUCKET_ROWS))
    per = targets.withColumnRenamed("source", "name")
    sized = sizes.join(per, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    is_long = F.col("size") * LONG > F.col("source_size")
    first = sized.filter(is_long).groupBy("source").applyInPandas(lambda rows: _long_first(rows, most), LONG_ROW)
    first = scratch.keep(first, "long")
    rates = first.groupBy(F.col("source").alias("name")).agg(F.max("rate").alias("rate"))
    rate = F.coalesce(F.col("rate"), F.col("target") / F.col("source_size"))
    rows = (
        sized.filter(~is_long)
        .join(rates, F.col("source").eqNullSafe(F.col("name")), "left")
        .withColumn("base", F.when(F.col("size") > 0, F.floor(rate + 1e-12)).otherwise(0).cast("long"))
        .withColumn("p", F.when(F.col("size") > 0, F.greatest(rate - F.col("base"), F.lit(0.0))).otherwise(0.0))
        .withColumn("done", F.col("p") < 1e-9)
        .withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(buckets)))
        .select("key", "doc_id", "source", "size", "source_size", "target", "base", "p", "done", "bucket")
    )
    out, level = [], 0
    while True:
        rows = scratch.keep(rows.groupBy("bucket").applyInPandas(_pivot, STATE), f"level{level}")
        out.append(rows.filter("done"))
        if buckets == 1:
            break
        buckets, level = -(-buckets // FAN), level + 1
        rows = rows.filter("not done").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
    last = rows.filter("not done").withColumn("p", (F.pmod(F.xxhash64("key", F.lit(SEED + 1)), F.lit(1 << 30)) / (1 << 30) < F.col("p")).cast("double"))
    whole = out[0]
    for more in [*out[1:], last]:
        whole = whole.unionByName(more)
    whole = whole.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + F.col("p").cast("long")).alias("copies"))
    return whole.unionByName(first.select(whole.columns))


def document_sizes(docs: DataFrame) -> DataFrame:
    """Without a doc_id a document is dealt and drawn by its text; a null text has no words."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"))


def mix_documents(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it.

    Rows that share doc_id, source and size get the same number of copies, the
    largest that was drawn for one of them. Columns stay as they are.
    """
    chosen = mix(document_sizes(docs), scratch, **options).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).filter("copies > 0")
    chosen = chosen.select(*(F.col(c).alias(f"__{c}") for c in chosen.columns))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id")) & F.col("source").cast("string").eqNullSafe(F.col("__source")) & (words(F.col("text")) == F.col("__size"))
    return docs.join(joinable(scratch.keep(chosen, "chosen")), same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken per document.

    Sources (null is one of its own) keep their documents whole: taken is size
    times the copies, 0 to 2. A null or empty text has size 0 and is not taken;
    an empty table gives no rows.
    """
    rows = mix(document_sizes(table(spark, sf_dir, "documents")), Scratch(spark, "op9"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
