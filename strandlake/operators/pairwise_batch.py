"""Alignment of many pairs at a time, and quality control by alignment to references.

The dynamic program runs over anti-diagonals, whose cells do not depend on each other,
for all pairs of a block side by side, in numpy on Arrow batches. A cell leaves four
bits, by which all paths of a block are traced back together. Scores and alignments
are those of ``pairwise.align``, cell by cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import distance, seqfn
from strandlake.operators.graph import ensure_checkpoints

#: Cells whose bits a block holds; a larger single pair is a block of its own.
CELLS = 1 << 26
DIAGONAL, UP, UP_MORE, LEFT_MORE = 1, 2, 4, 8
GAP = ord("-")


def _codes(texts: list[str], size: int) -> np.ndarray:
    out = np.zeros((len(texts), size), np.int32)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.int32)
    return out


def _block(a: list[str], b: list[str], match: float, mismatch: float, gap_open: float, gap_extend: float, free_ends: bool) -> tuple[np.ndarray, list[str], list[str]]:
    """Scores and alignments of pairs, all in one table of the longest texts' size."""
    p = len(a)
    n, m = (np.array([len(t) for t in x]) for x in (a, b))
    rows, cols = int(n.max()), int(m.max())
    x, y = np.ascontiguousarray(_codes(a, rows).T), np.ascontiguousarray(_codes(b, cols).T[::-1])
    costs = (match, mismatch, gap_open, gap_extend)
    if not all(float(v).is_integer() for v in costs):
        kind, low = np.float64, -np.inf
    elif (rows + cols + 2) * max(map(abs, costs)) < 14_000:
        kind, low = np.int16, -16_000
    else:
        kind, low = np.int32, -(1 << 29)
    match, mismatch, gap_open, gap_extend = (kind(v) for v in costs)
    bits = np.zeros((rows + cols + 1, rows + 1, p), np.uint8)
    # Of a diagonal d, row i holds cell (i, d - i) of each pair. The two diagonals before are kept.
    best = [np.full((rows + 1, p), low, kind) for _ in range(3)]
    up, left = ([np.full((rows + 1, p), low, kind) for _ in range(2)] for _ in range(2))
    scores, longer, flags = np.empty((rows + 1, p), kind), np.empty((rows + 1, p), kind), np.empty((rows + 1, p), bool)
    each = np.arange(p)
    end_score, end_i, end_j = np.full(p, low, kind), np.zeros(p, np.int64), np.zeros(p, np.int64)

    def marked(d: int, here: slice, flag: np.ndarray, bit: int) -> None:
        bits[d, here] |= flag.view(np.uint8) * np.uint8(bit)

    for d in range(rows + cols + 1):
        now, one, two = best[d % 3], best[(d - 1) % 3], best[(d - 2) % 3]
        u, u1, w, w1 = up[d % 2], up[(d - 1) % 2], left[d % 2], left[(d - 1) % 2]
        lo, hi = max(1, d - cols), min(rows, d - 1)
        if lo <= hi:
            here, above = slice(lo, hi + 1), slice(lo - 1, hi)
            score, ext, flag = scores[here], longer[here], flags[here]
            for gap, gap1, before, bit in ((u, u1, above, UP_MORE), (w, w1, here, LEFT_MORE)):
                np.add(gap1[before], gap_extend, out=ext)
                np.add(one[before], gap_open + gap_extend, out=score)
                np.maximum(score, ext, out=gap[here])
                np.equal(gap[here], ext, out=flag)
                marked(d, here, flag, bit)
            np.equal(x[lo - 1 : hi], y[cols - d + lo : cols - d + hi + 1], out=flag)
            np.multiply(flag, match - mismatch, out=score, casting="unsafe")
            np.add(score, mismatch, out=score)
            np.add(two[above], score, out=score)
            np.maximum(u[here], w[here], out=ext)
            np.maximum(score, ext, out=now[here])
            np.equal(now[here], score, out=flag)
            marked(d, here, flag, DIAGONAL)
            np.equal(now[here], u[here], out=flag)
            marked(d, here, flag, UP)
        for v in (now, u, w):  # what lies beyond this diagonal's cells is left from another one
            v[: max(0, d - cols)] = low
            v[min(rows, d) + 1 :] = low
        edge = kind(0) if free_ends or d == 0 else gap_open + d * gap_extend
        if d <= cols:
            now[0], u[0], w[0] = edge, low, low if free_ends or not d else edge
        if d <= rows:
            now[d], u[d], w[d] = edge, low if free_ends or not d else edge, low
        # The best cell of the last row or column, the later of equals; or the last cell.
        for i, j in [(n, d - n), (d - m, m)] if free_ends else [(n, d - n)]:
            ok = (i >= 0) & (j >= 0) & (i <= n) & (j <= m) & (free_ends | (j == m))
            score = now[np.where(ok, i, 0), each]
            take = ok & ((score > end_score) | ((score == end_score) & ((i > end_i) | ((i == end_i) & (j > end_j)))))
            end_score, end_i, end_j = np.where(take, score, end_score), np.where(take, i, end_i), np.where(take, j, end_j)
    return (end_score, *_traced(a, b, bits, end_i, end_j))


def _traced(a: list[str], b: list[str], bits: np.ndarray, end_i: np.ndarray, end_j: np.ndarray) -> tuple[list[str], list[str]]:
    """The alignments that lead to the end cells: all pairs take a step at a time."""
    p = len(a)
    i, j = end_i.copy(), end_j.copy()
    each = np.arange(p)
    gap = np.zeros(p, np.int8)  # 0: none open, 1: up, 2: left
    steps = []
    while True:
        live = (i > 0) & (j > 0)
        inside = live | (gap > 0)
        if not inside.any():
            break
        cell = bits[i + j, i, each]
        fresh = live & (gap == 0)
        diagonal = fresh & ((cell & DIAGONAL) > 0)
        gap = np.where(fresh & ~diagonal, np.where((cell & UP) > 0, 1, 2), gap)
        go_up, go_left = inside & ~diagonal & (gap == 1), inside & ~diagonal & (gap == 2)
        # A gap goes on where its value came from a longer one.
        more = np.where(go_up, (cell & UP_MORE) > 0, (cell & LEFT_MORE) > 0)
        steps.append(np.where(diagonal, 1, np.where(go_up, 2, np.where(go_left, 3, 0))).astype(np.uint8))
        i = i - (diagonal | go_up)
        j = j - (diagonal | go_left)
        gap = np.where((go_up | go_left) & more, gap, 0)
    path = np.array(steps[::-1], np.uint8).reshape(len(steps), p).T
    out_a, out_b = [], []
    for k in range(p):
        s = path[k][path[k] > 0]
        first, second = _codes([a[k]], len(a[k]))[0], _codes([b[k]], len(b[k]))[0]
        x, y = np.full(len(s), GAP, np.int32), np.full(len(s), GAP, np.int32)
        x[s != 3] = first[i[k] : end_i[k]]
        y[s != 2] = second[j[k] : end_j[k]]
        text = lambda v: v.tobytes().decode("utf-32-le")
        head_a, head_b = a[k][: i[k]] + "-" * int(j[k]), "-" * int(i[k]) + b[k][: j[k]]
        tail_a, tail_b = a[k][end_i[k] :] + "-" * int(len(b[k]) - end_j[k]), "-" * int(len(a[k]) - end_i[k]) + b[k][end_j[k] :]
        out_a.append(head_a + text(x) + tail_a)
        out_b.append(head_b + text(y) + tail_b)
    return out_a, out_b


def align_many(a: list[str], b: list[str], match: float = 4, mismatch: float = -3, gap_open: float = -2, gap_extend: float = -1, free_ends: bool = True) -> list[tuple[float, str, str]]:
    """``pairwise.align`` of each pair: score and both texts with gaps.

    Pairs are dealt to blocks by their sizes, so that a block's table is little larger than its pairs'.
    """
    out: list = [None] * len(a)
    order = sorted(range(len(a)), key=lambda k: (len(a[k]), len(b[k])))
    at = 0
    while at < len(order):
        held, most = [], 0
        while at < len(order):
            k = order[at]
            size = max(most, (len(a[k]) + len(b[k]) + 1) * (len(a[k]) + 1))
            if held and size * (len(held) + 1) > CELLS:
                break
            held.append(k)
            most, at = size, at + 1
        found = _block([a[k] for k in held], [b[k] for k in held], match, mismatch, gap_open, gap_extend, free_ends)
        for k, score, x, y in zip(held, *found, strict=True):
            out[k] = (float(score), x, y)
    return out


def _aligned(batches: Iterator[pa.RecordBatch], options: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            found = align_many(*([t or "" for t in part.column(c).to_pylist()] for c in ("seq1", "seq2")), **options)
            made = [pa.array([f[c] for f in found], t) for c, t in enumerate((pa.float64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], *made], names=[*part.schema.names[:-2], "score", "aligned1", "aligned2"])


def aligned_pairs(pairs: DataFrame, **options) -> DataFrame:
    """score, aligned1, aligned2 in place of seq1, seq2; other columns stay. A null sequence is empty."""
    keep = [c for c in pairs.columns if c not in ("seq1", "seq2", "score", "aligned1", "aligned2")]
    rows = pairs.select(*keep, F.col("seq1").cast("string").alias("seq1"), F.col("seq2").cast("string").alias("seq2"))
    schema = rows.select(*keep).schema.add("score", "double").add("aligned1", "string").add("aligned2", "string")
    return rows.mapInArrow(lambda b: _aligned(b, options), schema)


def to_reference(rows: DataFrame, references: DataFrame, both_directions: bool = True, **options) -> DataFrame:
    """Rows (id, seq) aligned with every reference (ref, refseq): id, ref, reverse, score, n, k2p, aligned.

    With ``both_directions`` a row is also tried as its reverse complement, and counts
    as that where it scores higher. ``n`` is the number of bases compared, ``k2p`` their
    distance, and ``aligned`` the row in the reference's columns: what it has between two
    of these is left out. References are a few given sequences, so that the
    alignments grow with the rows.
    """
    fresh = rows.select("id", F.upper(seqfn.degapped(F.coalesce("seq", F.lit("")))).alias("s"))
    ways = [(False, F.col("s"))] + ([(True, seqfn.reverse_complement(F.col("s"), full=True))] if both_directions else [])
    tried = fresh.select("id", F.explode(F.array(*(F.struct(F.lit(r).alias("reverse"), s.alias("seq1")) for r, s in ways))).alias("w")).select("id", "w.reverse", "w.seq1")
    pairs = tried.crossJoin(references.select("ref", F.upper(seqfn.degapped("refseq")).alias("seq2")))
    made = aligned_pairs(pairs, **options)
    best = made.groupBy("id", "ref").agg(F.max_by(F.struct("reverse", "score", "aligned1", "aligned2"), F.struct("score", ~F.col("reverse"))).alias("b")).select("id", "ref", "b.*")
    measured = best.withColumn("c", distance.counts(F.col("aligned1"), F.col("aligned2")))
    columns = F.filter(F.zip_with(seqfn.characters(F.col("aligned1")), seqfn.characters(F.col("aligned2")), lambda x, y: F.when(y != "-", x)), lambda x: x.isNotNull())
    return measured.select("id", "ref", "reverse", "score", F.col("c.n").alias("n"), distance.k2p(F.col("c.n"), F.col("c.ts"), F.col("c.tv")).alias("k2p"), F.array_join(columns, "").alias("aligned"))


def _consensus(aligned: DataFrame) -> DataFrame:
    """ref, refseq: the most frequent base of every column of the rows aligned with a reference, ties by letter; gaps don't count."""
    long = aligned.select("ref", F.posexplode(seqfn.characters(F.col("aligned"))).alias("pos", "base")).filter("base IN ('A', 'C', 'G', 'T')")
    most = long.groupBy("ref", "pos", "base").agg(F.count(F.lit(1)).alias("n")).groupBy("ref", "pos").agg(F.max_by("base", F.struct("n", F.translate("base", "ACGT", "4321"))).alias("base"))
    return most.groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("refseq"))


def quality_controlled(rows: DataFrame, references: DataFrame, cutoff: float, most_rounds: int = 10, **options) -> DataFrame:
    """Rows (id, seq) that lie within ``cutoff`` of a reference (ref, refseq), aligned anew until none is dropped.

    Returns id, ref (the nearest reference, ties by name), reverse, k2p, aligned, rounds
    (that the row was aligned in) and passed. In the first round rows are aligned with
    the references; in each later one what is left is aligned with the consensus of the
    rows that went with a reference, a better middle than the reference itself, and
    rows beyond the cutoff are dropped. A row has the values of its last round.
    """
    ensure_checkpoints(rows.sparkSession)
    left, centres, out = rows.select("id", "seq").checkpoint(), references.select("ref", "refseq"), None
    nearest = F.min(F.struct("k2p", "ref", "reverse", "aligned")).alias("b")
    for k in range(1, most_rounds + 1):
        found = to_reference(left, centres, **options).groupBy("id").agg(nearest).select("id", "b.ref", "b.reverse", "b.k2p", "b.aligned", F.lit(k).alias("rounds"), (F.col("b.k2p") <= cutoff).alias("passed")).checkpoint()
        dropped, kept = found.filter("NOT passed"), found.filter("passed")
        out = dropped if out is None else out.unionByName(dropped)
        if dropped.isEmpty() or kept.isEmpty() or k == most_rounds:
            break
        left = left.join(kept.select("id"), "id", "left_semi")
        centres = _consensus(kept).checkpoint()
    return out.unionByName(kept)
