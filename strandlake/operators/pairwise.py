"""Pairwise alignment by dynamic programming, and trees built from distances.

Both are inherently sequential, so they run as Python on Arrow batches: one
alignment per row of pairs, one tree per group of distances.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def align(a: str, b: str, match: float = 4, mismatch: float = -3, gap_open: float = -2, gap_extend: float = -1, free_ends: bool = True, local: bool = False) -> tuple[float, str, str]:
    """Score and both texts with gaps (-). A gap of k letters costs ``gap_open + k * gap_extend``.

    ``free_ends`` leaves gaps before and after either text free; ``local``
    aligns the best-scoring parts only. Ties: a letter pair before a gap.
    """
    n, m, low = len(a), len(b), float("-inf")
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    up = [[low] * (m + 1) for _ in range(n + 1)]
    left = [[low] * (m + 1) for _ in range(n + 1)]
    if not (free_ends or local):
        for i in range(1, n + 1):
            best[i][0] = up[i][0] = gap_open + i * gap_extend
        for j in range(1, m + 1):
            best[0][j] = left[0][j] = gap_open + j * gap_extend
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            up[i][j] = max(best[i - 1][j] + gap_open, up[i - 1][j]) + gap_extend
            left[i][j] = max(best[i][j - 1] + gap_open, left[i][j - 1]) + gap_extend
            here = max(best[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), up[i][j], left[i][j])
            best[i][j] = max(here, 0.0) if local else here
    if local:
        i, j = max(((i, j) for i in range(n + 1) for j in range(m + 1)), key=lambda p: (best[p[0]][p[1]], -p[0], -p[1]))
    elif free_ends:
        i, j = max([*((n, j) for j in range(m + 1)), *((i, m) for i in range(n + 1))], key=lambda p: (best[p[0]][p[1]], p))
    else:
        i, j = n, m
    score = best[i][j]
    x, y = ("", "") if local else (a[i:] + "-" * (m - j), "-" * (n - i) + b[j:])
    while i and j and not (local and best[i][j] == 0):
        if best[i][j] == best[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            x, y = a[i] + x, b[j] + y
            continue
        gap = up if best[i][j] == up[i][j] else left
        while True:
            here = gap[i][j]
            if gap is up:
                i -= 1
                x, y = a[i] + x, "-" + y
            else:
                j -= 1
                x, y = "-" + x, b[j] + y
            if here != gap[i][j] + gap_extend:
                break
    return score, x if local else a[:i] + "-" * j + x, y if local else "-" * i + b[:j] + y


def _aligned(batches: Iterator[pa.RecordBatch], options: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [align(a or "", b or "", **options) for a, b in zip(batch.column("seq1").to_pylist(), batch.column("seq2").to_pylist(), strict=True)]
        cols = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.float64(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("id1"), batch.column("id2"), *cols], names=["id1", "id2", "score", "aligned1", "aligned2"])


def aligned_pairs(pairs: DataFrame, **options) -> DataFrame:
    """id1, id2, score, aligned1, aligned2 for pairs (id1, id2, seq1, seq2)."""
    rows = pairs.selectExpr("cast(id1 as string) id1", "cast(id2 as string) id2", "seq1", "seq2")
    return rows.mapInArrow(lambda b: _aligned(b, options), "id1 string, id2 string, score double, aligned1 string, aligned2 string")


def build_tree(names: list[str], distance: dict[tuple[str, str], float], method: str = "nj") -> list[tuple[int, int | None, str | None, float | None]]:
    """(node, parent, label, length) by neighbour joining (``nj``) or averaging (``upgma``); the root is the last node."""
    d = {(i, j): distance.get((a, b), distance.get((b, a), 0.0)) for i, a in enumerate(names) for j, b in enumerate(names) if i != j}
    rows = {i: [i, None, name, None] for i, name in enumerate(names)}
    open_, sizes, heights = list(range(len(names))), {i: 1 for i in range(len(names))}, {i: 0.0 for i in range(len(names))}
    while len(open_) > 1:
        total = {i: sum(d[i, j] for j in open_ if j != i) for i in open_}
        n = len(open_)
        key = (lambda i, j: d[i, j]) if method == "upgma" or n == 2 else (lambda i, j: (n - 2) * d[i, j] - total[i] - total[j])
        i, j = min(((i, j) for k, i in enumerate(open_) for j in open_[k + 1 :]), key=lambda p: (key(*p), p))
        new = len(rows)
        if method == "upgma":
            heights[new] = d[i, j] / 2
            li, lj = heights[new] - heights[i], heights[new] - heights[j]
        else:
            li = d[i, j] / 2 + ((total[i] - total[j]) / (2 * (n - 2)) if n > 2 else 0.0)
            lj = d[i, j] - li
        rows[new] = [new, None, None, None]
        for x, length in ((i, li), (j, lj)):
            rows[x][1], rows[x][3] = new, length
        for k in open_:
            if k not in (i, j):
                far = (sizes[i] * d[i, k] + sizes[j] * d[j, k]) / (sizes[i] + sizes[j]) if method == "upgma" else (d[i, k] + d[j, k] - d[i, j]) / 2
                d[new, k] = d[k, new] = far
        sizes[new] = sizes[i] + sizes[j]
        open_ = [k for k in open_ if k not in (i, j)] + [new]
    return [tuple(r) for r in rows.values()]


def trees_of_groups(pairs: DataFrame, by: str, method: str = "nj") -> DataFrame:
    """One tree per group of distances (``by``, id1, id2, distance). A group's matrix is held by one task."""
    import pandas as pd

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*rows["id1"], *rows["id2"]})
        made = build_tree(names, {(a, b): x for a, b, x in zip(rows["id1"], rows["id2"], rows["distance"], strict=True)}, method)
        out = pd.DataFrame(made, columns=["node", "parent", "label", "length"]).astype({"parent": "Int64", "length": "Float64"})
        out.insert(0, "tree", str(rows[by].iloc[0]))
        return out

    return pairs.groupBy(by).applyInPandas(one, "tree string, node long, parent long, label string, length double")
