"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over ``CONTEXT`` bytes ends a chunk wherever its low bits are all
ones; each chunk gives one character. The block size (chunk length to expect) is
a power of two, chosen so that a signature has about ``LENGTH`` characters; a
fingerprint holds the signatures of that block size and of twice it, so texts
whose sizes differ up to fourfold still share one. Likeness is one less the edit
distance of the signatures of a shared block size over the longer's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import Scratch, table
from strandlake.llm.minhash import mix64
from strandlake.llm.tokens import slices

CONTEXT = 4
LENGTH = 64
MIN_BLOCK = 2
#: Fixed value: the 64 characters of a signature.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _inverse(x: int) -> int:
    y = x
    for _ in range(6):
        y = y * (2 - x * y) % 2**64
    return y


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n``."""
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((int(_BASE), _inverse(int(_BASE)))):
            steps = np.full(n, np.uint64(base))
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def signature(raw: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Block size, and the signatures (letters) of that and of twice that size."""
    buf = np.frombuffer(raw, np.uint8)
    n = len(buf)
    empty = np.zeros(0, np.uint8)
    if not n:
        return MIN_BLOCK, empty, empty
    up, down = _powers(n + 1)
    spread = _SPREAD[buf]
    rolling = spread.copy()
    for k in range(1, CONTEXT):
        rolling[k:] += spread[:-k] * up[k]
    rolling = mix64(rolling)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(spread * up[:n], out=total[1:])
    block = MIN_BLOCK
    ends = np.flatnonzero(rolling & np.uint64(block - 1) == np.uint64(block - 1))
    while len(ends) + (len(ends) > 0 and ends[-1] != n - 1) > LENGTH:  # letters: one a cut, and one after the last
        block *= 2
        ends = ends[rolling[ends] & np.uint64(block - 1) == np.uint64(block - 1)]
    twice = ends[rolling[ends] & np.uint64(2 * block - 1) == np.uint64(2 * block - 1)]

    def letters(cuts: np.ndarray) -> np.ndarray:
        edge = np.concatenate([[0], cuts + 1, [n]]) if not len(cuts) or cuts[-1] != n - 1 else np.concatenate([[0], cuts + 1])
        piece = (total[edge[1:]] - total[edge[:-1]]) * down[edge[:-1]]
        return _LETTERS[(mix64(piece) >> np.uint64(58)).astype(np.int64)]

    return block, letters(ends), letters(twice)


def fingerprint(found: tuple[int, np.ndarray, np.ndarray]) -> str:
    block, one, two = found
    return f"{block}:{one.tobytes().decode()}:{two.tobytes().decode()}"


def edit_distances(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Levenshtein distances of pairs of at most 64 (a) letters, side by side, bit-parallel."""
    n = len(a)
    size = np.array([len(x) for x in a], np.int64)
    if n and size.max() > 64:
        raise ValueError("a word holds 64 letters")
    other = np.array([len(x) for x in b], np.int64)
    masks = np.zeros((n, 128), np.uint64)
    for k, x in enumerate(a):
        np.bitwise_or.at(masks[k], x, np.uint64(1) << np.arange(len(x), dtype=np.uint64))
    width = int(other.max()) if n else 0
    text = np.zeros((n, width), np.uint8)
    for k, x in enumerate(b):
        text[k, : len(x)] = x
    one = np.uint64(1)
    full = np.where(size >= 64, ~np.uint64(0), (one << (size % 64).astype(np.uint64)) - one)
    high = one << np.maximum(size - 1, 0).astype(np.uint64)
    pv, mv, score = full.copy(), np.zeros(n, np.uint64), size.copy()
    rows = np.arange(n)
    for j in range(width):
        live = (j < other) & (size > 0)
        eq = masks[rows, text[:, j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        change = ((ph & high) != 0).astype(np.int64) - ((mh & high) != 0)
        ph, mh = (ph << one) | one, mh << one
        pv = np.where(live, (mh | ~(xv | ph)) & full, pv)
        mv = np.where(live, ph & xv & full, mv)
        score += np.where(live, change, 0)
    return np.where(size == 0, other, score)


def likeness(pairs: list[tuple[tuple, tuple]]) -> np.ndarray:
    """Of pairs of signatures: the best over their shared block sizes, 0 without one."""
    a, b, owner = [], [], []
    for k, (x, y) in enumerate(pairs):
        for i, one in enumerate(x[1:]):
            for j, two in enumerate(y[1:]):
                if x[0] << i == y[0] << j:
                    a.append(one)
                    b.append(two)
                    owner.append(k)
    best = np.zeros(len(pairs))
    if a:
        longer = np.maximum([len(x) for x in a], [len(x) for x in b])
        near = 1 - edit_distances(a, b) / np.maximum(longer, 1)
        np.maximum.at(best, owner, near)
    return best


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
PLACED = ROW + ", part long, head string, tail string"


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as much of the following text's beginning, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(ids: list, texts: list[str], signs: list[tuple], following: list[str], signs_after: list[tuple]) -> list[tuple]:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    raw = [_utf8(c) for c in changed]
    signs_changed = [signature(r) for r in raw]
    near = likeness(list(zip(signs, signs_changed, strict=True)))
    after = likeness(list(zip(signs, signs_after, strict=True)))
    return [(d, len(t), hashlib.sha256(r).hexdigest(), fingerprint(s), fingerprint(c), float(x), float(y)) for d, t, r, s, c, x, y in zip(ids, texts, raw, signs, signs_changed, near, after, strict=True)]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition. The last document's follower is in another
    partition: it goes out with its text as ``tail``, the first with its as ``head``."""
    part, held, first = TaskContext.get().partitionId(), None, True
    for batch in batches:
        for piece in slices([batch], "text", 1 << 20):
            ids, texts = piece.column("doc_id").to_pylist(), [t or "" for t in piece.column("text").to_pylist()]
            signs = [signature(_utf8(t)) for t in texts]
            if first:
                yield _batch([(None,) * 7 + (part, texts[0], None)], PLACED)
                first = False
            if held:
                ids, texts, signs = [held[0], *ids], [held[1], *texts], [held[2], *signs]
            rows = _rows(ids[:-1], texts[:-1], signs[:-1], texts[1:], signs[1:])
            yield _batch([r + (part, None, None) for r in rows], PLACED)
            held = (ids[-1], texts[-1], signs[-1])
    if held:
        yield _batch([(held[0],) + (None,) * 6 + (part, None, held[1])], PLACED)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, after = (batch.column(c).to_pylist() for c in ("doc_id", "tail", "head"))
        signs, signs_after = ([signature(_utf8(t)) for t in x] for x in (texts, after))
        yield _batch(_rows(ids, texts, signs, after, signs_after), ROW)


def fingerprints(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, as ``ROW``.

    The next document is the one with the next smaller doc_id; after the last
    comes the first. Texts are shuffled once, into ranges of doc_id; only the
    document at the end of a range meets its follower by a join. A null doc_id
    comes last; rows that share a doc_id follow each other by text; a null text
    is empty; a lone document follows itself; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = F.col("doc_id").desc_nulls_last()
    placed = scratch.keep(docs.repartitionByRange(n, order).sortWithinPartitions(order, "text").mapInArrow(_placed, PLACED), "placed")
    heads = placed.filter("head IS NOT NULL")
    parts = sorted(r.part for r in heads.select("part").collect())  # one number per range
    follows = spark.createDataFrame([(p, parts[(k + 1) % len(parts)]) for k, p in enumerate(parts)], "p long, q long")
    tails = placed.filter("tail IS NOT NULL").select("doc_id", "tail", "part")
    ends = tails.join(follows, F.col("part") == F.col("p")).select("doc_id", "tail", "q").join(heads.select(F.col("part").alias("r"), "head"), F.col("q") == F.col("r")).select("doc_id", "tail", "head")
    columns = [f.split()[0] for f in ROW.split(", ")]
    return placed.filter("head IS NULL AND tail IS NULL").select(columns).unionByName(ends.mapInArrow(_joined, ROW))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"), Scratch(spark, "op6"))
