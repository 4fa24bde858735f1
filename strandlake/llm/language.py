"""Language of a text by rank-order profiles of its n-grams.

A text's n-grams are runs of one to three characters of its lower-case words, with a
blank on either side of a word. A language's profile is the ranking of its
``PROFILE`` most frequent n-grams over all texts that it is learned from; a text's
own ranking is compared with each. An n-gram is out of place by the difference of its
ranks, or by ``PROFILE`` where the language's profile lacks it, and the language with
the least sum is the prediction.

Learning is one pass that counts n-grams batch by batch, adds them up within a task,
and ranks the sums of all tasks; predicting is one pass over all texts with the
profiles of ``AT_ONCE`` languages, on average, at a time (all of them, as a rule).
An n-gram is a number: its characters, 21 bits each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import small_batches, table
from strandlake.llm.tokens import slices

#: N-grams of a profile.
PROFILE = 400
#: Languages whose profiles a pass over the texts holds, on average.
AT_ONCE = 200
UNKNOWN = "und"
#: Characters whose n-grams are counted at a time, and distinct n-grams that a task holds before it adds up.
PIECE, HELD = 1 << 19, 1 << 20

_OTHER = re.compile(r"[\W\d_]+")
BLANK = ord(" ")


def letters(text: str | None) -> str:
    """The words of a text, lower-case, runs of letters alone, one blank between."""
    plain = _OTHER.sub(" ", (text or "").lower()).strip()
    if plain and not plain.replace(" ", "a").isalpha():  # digits that aren't decimal count as word characters above
        plain = " ".join("".join(c if c.isalpha() else " " for c in plain).split())
    return plain


def grams(plain: str) -> np.ndarray:
    """All n-grams of words that ``letters`` gave, repeats included."""
    at = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    two = at[:-1] << 21 | at[1:]
    three = at[:-2] << 42 | two[1:]
    return np.concatenate([at[at != BLANK], two, three[at[1:-1] != BLANK]])


def counted(plain: str, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, ascending, and how often each occurs. Long texts are counted in pieces that end between words."""
    parts, k = [], 0
    while k < len(plain):
        end = plain.find(" ", k + piece)
        end = len(plain) if end < 0 else end
        parts.append(np.unique(grams(plain[k:end]), return_counts=True))
        k = end + 1
    return summed(parts)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, where = np.unique(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in parts)]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([np.zeros(0), *(n for _, n in parts)]), len(keys)).astype(np.int64)


def ranking(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties by number."""
    return keys[np.argsort(-counts, kind="stable")[:most]]


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, n = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    for batch in batches:
        for part in slices([batch], "text", 1 << 20):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                plain = letters(text)
                if plain:
                    found = counted(plain)
                    held.setdefault(lang, []).append(found)
                    size += len(found[0])
            if size > HELD:
                held = {lang: [summed(parts)] for lang, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD:
                    yield from out()
                    held, size = {}, 0
    yield from out()


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def profiles(docs: DataFrame) -> DataFrame:
    """lang, gram, rank (from 0) of every language of ``docs`` (lang, text); rows without language or letters teach nothing."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(_learned, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    at = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", at - 1).filter(F.col("rank") < PROFILE).select("lang", "gram", "rank")


class Profiles:
    """Rankings of some languages side by side: a row per n-gram, a column per language, ``PROFILE`` where it has none."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        self.keys = np.array(sorted({g for _, g, _ in rows}), np.int64)
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int64)
        column = {lang: k for k, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.keys, gram), column[lang]] = rank

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a ranking to each language, 0 to 1: 1 where nothing is shared."""
        at = np.searchsorted(self.keys, own)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != own)] = len(self.keys)
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(own))[:, None]))
        return apart.sum(0) / (PROFILE * max(1, len(own)))


def _predicted(batches: Iterator[pa.RecordBatch], known: Profiles) -> Iterator[pa.RecordBatch]:
    """The batches with the nearest of these languages where it is nearer than the one that they come with."""
    for batch in batches:
        for part in slices([batch], "text", 1 << 20):
            langs, far = part.column("lang_pred").to_pylist(), part.column("distance").to_pylist()
            for k, text in enumerate(part.column("text").to_pylist()):
                plain = letters(text)
                if plain:
                    d = known.distances(ranking(*counted(plain)))
                    j = int(d.argmin())
                    if langs[k] is None or (d[j], known.langs[j]) < (far[k], langs[k]):
                        langs[k], far[k] = known.langs[j], float(d[j])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names[:-2]), pa.array(langs, pa.string()), pa.array(far, pa.float64())], names=part.schema.names)


def predict(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """``docs`` with lang_pred and score (1 - distance) by the profiles ``learned`` (lang, gram, rank), in place of columns so named.

    A text that is null or has no letter, or any where nothing was learned, is
    ``und`` with score 0. Of languages equally near the first by name is taken.
    Repeated rows are predicted each; very long texts are ranked whole; other
    columns stay; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    learned = learned.persist()
    n = learned.filter("rank = 0").count()
    docs = docs.drop("lang_pred", "score", "distance").withColumn("text", F.col("text").cast("string"))
    out = docs.withColumns({"lang_pred": F.lit(None).cast("string"), "distance": F.lit(1.0)})
    blocks = -(-n // AT_ONCE)
    for block in range(blocks):
        own = learned.filter(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == block)
        known = Profiles([tuple(r) for r in own.select("lang", "gram", "rank").toLocalIterator()])
        if known.langs:
            out = out.mapInArrow(lambda batches, known=known: _predicted(batches, known), out.schema)
    learned.unpersist()
    return out.withColumns({"score": F.when(F.col("lang_pred").isNull(), 0.0).otherwise(1 - F.col("distance")), "lang_pred": F.coalesce("lang_pred", F.lit(UNKNOWN))}).drop("distance")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score per document; learned from all documents that are not held out.

    A null doc_id is neither held out nor learned from.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    learned = profiles(docs.filter("doc_id IS NOT NULL").filter(~held_out("doc_id")))
    return predict(docs.drop("lang"), learned).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
