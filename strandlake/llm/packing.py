"""Packing token sequences by Karmarkar-Karp multiway differencing.

Every document's ids are cut into pieces and the pieces are dealt to windows of
equal capacity. Within a block of documents, each piece begins as a partial
partition (its length in one window, nothing in the others); the two partitions
with the largest spread are merged with opposing imbalances, fullest window of
one onto the emptiest of the other, until one partition is left, whose windows
are nearly equal. A block takes as many windows as its tokens need; while the
fullest exceeds the capacity, the block takes one window more.

Blocks are cut off the scan as it goes, so nothing is shuffled and a task holds
one block at a time. A block ends when its tokens fill its windows but for
``slack`` tokens each, cutting the document at hand if need be.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.common import lean, small_batches, table
from strandlake.llm.tokens import END_ID, SLICE, default_tokenizer, encoder, slices

CAPACITY = 2048
#: Windows of a block, tokens left free in each, and the longest piece.
WINDOWS = 64
SLACK = 12
PIECE = 512

FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """The pieces (by index) of each of ``windows`` windows of nearly equal sum.

    A partial partition is its windows' sums and, for each window, the first and
    last of a chain of pieces (-1: none), so that a merge links chains only.
    """
    if windows == 1:
        return [list(range(len(lengths)))]
    chain = np.full(len(lengths) + 1, -1)
    sums, ends = np.zeros((len(lengths), windows), np.int64), np.full((len(lengths), 2, windows), -1)
    sums[:, -1] = lengths
    ends[:, :, -1] = np.arange(len(lengths))[:, None]
    heap = [(-n, i, i) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        total = sums[a] + sums[b, ::-1]
        order = total.argsort(kind="stable")
        (head, tail), (head_b, tail_b) = ends[a], ends[b, :, ::-1]
        free = tail < 0
        chain[tail] = np.where(free, -1, head_b)
        ends[a, 0] = np.where(free, head_b, head)[order]
        ends[a, 1] = np.where(tail_b < 0, tail, tail_b)[order]
        total = total[order]
        total -= total[0]
        sums[a] = total
        serial += 1
        heapq.heappush(heap, (-int(total[-1]), serial, a))
    out = []
    for at in ends[heap[0][2], 0].tolist() if heap else [-1] * windows:
        out.append([])
        while at >= 0:
            out[-1].append(at)
            at = int(chain[at])
    return out


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows for pieces of at most ``capacity``; the count rises while one overflows."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        found = difference(lengths, windows)
        if all(sum(lengths[i] for i in w) <= capacity for w in found):
            return [w for w in found if w]
        windows += 1


class Packer:
    """Cuts a run of documents into blocks and yields their pieces."""

    def __init__(self, capacity: int, first_sequence: int, windows: int = WINDOWS, slack: int = SLACK, piece: int = PIECE):
        self.capacity, self.piece = capacity, min(piece, capacity)
        self.target = max(1, windows * (capacity - min(slack, capacity // 8)))
        self.next, self.held, self.total = first_sequence, [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[tuple]]:
        at, n = 0, len(ids)
        while at < n:
            size = min(self.cut(n - at), n - at, self.target - self.total)
            self.held.append((doc_id, at, size, zlib.crc32(ids[at : at + size]), n))
            at += size
            self.total += size
            if self.total >= self.target:
                yield self.flush()

    def cut(self, rest: int) -> int:
        """Long pieces first, short ones at a document's end: these even out the windows."""
        long = self.piece
        return long if rest >= 2 * long else long // 2 if 4 * rest >= 3 * long else long // 4 or 1

    def flush(self) -> list[tuple]:
        rows = []
        for window in pack([p[2] for p in self.held], self.capacity):
            offset = 0
            for i in sorted(window):
                rows.append((*self.held[i], self.next, offset))
                offset += self.held[i][2]
            self.next += 1
        self.held, self.total = [], 0
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, FIELDS, strict=True)], names=[n for n, _ in FIELDS])


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, start (ids of its document before it), length,
    ids_crc32 (of the piece's ids as little-endian unsigned 32-bit), doc_tokens
    (with the end id), sequence_id, offset (in the sequence, gapless from 0).

    A null or empty text is the end id alone. A null doc_id stays null. Rows
    that repeat are packed each on its own, very long texts in as many pieces as
    they need, an empty table gives no rows, other columns are not read.
    sequence_id is unique, not consecutive over tasks.
    """
    path = tokenizer or default_tokenizer()
    small_batches(docs.sparkSession)

    @lean(holds=True)
    def run(batches):
        enc = encoder(path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 36)
        for batch in slices(batches, "text", SLICE):
            ids, ends = enc.encode_array(batch.column("text"), end_id)
            first = 0
            for doc_id, last in zip(batch.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                for rows in packer.add(doc_id, ids[first:last]):
                    yield _batch(rows)
                first = last
        yield _batch(packer.flush() if packer.held else [])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
