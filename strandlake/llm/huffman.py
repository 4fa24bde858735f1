"""Token ids as files of canonical, length-limited Huffman codes.

Code lengths come from the global counts of all ids by the package-merge
algorithm, at most ``longest`` bits; codes are canonical, so a file carries
only the lengths. Documents are range-partitioned by id, sorted, and written as
independent blocks: a block holds the ids of its documents as one bit stream and
the bit offset of every ``STRIDE``-th id, from which a reader decodes all
strides side by side with one table look-up per id.

File: ``MAGIC``; blocks; directory (one ``ENTRY`` per block); ``FOOTER``. Block:
doc ids, document lengths, bit offsets, bit stream, as laid out in ``Block``.
The codebook is a file of its own, referred to by its checksum.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import Scratch, lean, table
from strandlake.llm.tokens import END_ID, SLICE, default_tokenizer, encoder, slices

#: Longest code, for up to 32,768 used ids; with more, one bit more than their number has.
MAX_BITS = 16
STRIDE = 128
#: Ids gathered before a block is written; a block never splits a document.
BLOCK_IDS = 1 << 19
#: Documents' token bytes of one output partition, about.
PARTITION_BYTES = 32 << 20

MAGIC = b"SLHUF\x01"
ENTRY = struct.Struct("<QQII")  # offset, bytes, documents, crc32
FOOTER = struct.Struct("<QII6s")  # directory offset, blocks, codebook checksum, magic
HEAD = struct.Struct("<IQQI")  # documents, ids, bits, stride


def longest(used: int) -> int:
    """The limit on the code lengths of so many ids."""
    return max(MAX_BITS, used.bit_length() + 1)


def code_lengths(counts: np.ndarray, max_bits: int | None = None) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for every id with a count (package-merge)."""
    used = np.flatnonzero(counts)
    max_bits = max_bits or longest(len(used))
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 2:
        lengths[used] = 1
        return lengths
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols have no codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    merged, kinds = leaves, []
    for _ in range(max_bits - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        merged = both[by]
        kinds.append(by < n)
    take, bits = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(kinds):
        own = int(np.count_nonzero(is_leaf[:take]))
        bits[:own] += 1
        take = 2 * (take - own)
    bits[:take] += 1
    lengths[order] = bits
    return lengths


class Codebook:
    """Canonical codes of code lengths, and the table that decodes them."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        self.codes = np.zeros(len(lengths), np.uint32)
        self.bits = bits = max(MAX_BITS, int(lengths.max(initial=0)))
        self.symbols = np.zeros(1 << bits, np.uint32)
        self.widths = np.zeros(1 << bits, np.uint8)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        width = lengths[order].astype(np.int64)
        span = np.int64(1) << (bits - width)
        starts = np.cumsum(span) - span
        self.codes[order] = starts >> (bits - width)
        self.symbols[: span.sum()] = np.repeat(order, span)
        self.widths[: span.sum()] = np.repeat(width, span)
        self.checksum = zlib.crc32(self.lengths)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray, int]:
        """Bit stream (most significant bit first), bit offset of every stride, bits."""
        width = self.lengths[ids].astype(np.int64)
        if len(ids) and not width.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(width)
        bits = int(ends[-1]) if len(ids) else 0
        starts = ends - width
        word, shift = starts >> 5, 64 - (starts & 31) - width
        value = self.codes[ids].astype(np.uint64) << shift.astype(np.uint64)
        out = np.zeros((bits >> 5) + 2, np.uint64)
        if len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            at = word[first]
            out[at] += np.add.reduceat(value >> np.uint64(32), first)
            out[at + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes()[: -(-bits // 8)], starts[::STRIDE].astype(np.uint32 if bits < 1 << 32 else np.uint64), bits

    def decode(self, stream: bytes, offsets: np.ndarray, n: int, stride: int) -> np.ndarray:
        """All strides step by step, one look-up per id."""
        raw = np.frombuffer(stream + bytes(8), np.uint8).astype(np.uint32)
        raw = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # 32 bits from each byte on
        drop = np.uint32(32 - self.bits)
        at = offsets.astype(np.int64)
        out = np.zeros((len(at), stride), np.uint32)
        last = n - stride * (len(at) - 1) if len(at) else 0
        for k in range(min(stride, n)):
            if k == last:
                at = at[:-1]
            peek = (raw[at >> 3] << (at & 7).astype(np.uint32)) >> drop
            out[: len(at), k] = self.symbols[peek]
            at = at + self.widths[peek]
        return out.reshape(-1)[:n]


def block(book: Codebook, doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    stream, offsets, bits = book.encode(ids)
    return b"".join((HEAD.pack(len(docs), len(ids), bits, STRIDE), np.array([d is not None for d in doc_ids], np.uint8).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([len(d) for d in docs], "<u4").tobytes(), offsets.astype("<u8").tobytes(), stream))


def read_block(book: Codebook, raw: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    docs, n, _, stride = HEAD.unpack_from(raw)
    at = HEAD.size
    known = np.frombuffer(raw, np.uint8, docs, at)
    doc_ids = np.frombuffer(raw, "<i8", docs, at := at + docs)
    sizes = np.frombuffer(raw, "<u4", docs, at := at + 8 * docs)
    offsets = np.frombuffer(raw, "<u8", -(-n // stride), at := at + 4 * docs)
    ids = book.decode(raw[at + 8 * len(offsets) :], offsets, n, stride)
    first = 0
    for d, ok, size in zip(doc_ids.tolist(), known.tolist(), sizes.tolist(), strict=True):
        yield d if ok else None, ids[first : first + size]
        first += size


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@lean(holds=True)
def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in slices(batches, "text", SLICE):
        ids, ends = enc.encode_array(batch.column("text"), end_id)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _packed(ids, ends)], names=["doc_id", "ids"])


def _tokens(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(lambda b: _encoded(b, path, end_id), "doc_id long, ids binary")


def _packed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Each text's ids as ``_ids`` reads them."""
    if not len(ids) or ids.max() < 1 << 16:
        offsets = np.concatenate([[0], 2 * ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u2"))])
    each = np.split(ids, ends[:-1])
    return pa.array([one.astype("<u2").tobytes() if not len(one) or one.max() < 1 << 16 else b"\0" + one.tobytes() for one in each], pa.binary())


def _ids(raw: bytes) -> np.ndarray:
    """Two bytes an id, or after a zero byte (an odd length) four."""
    return np.frombuffer(raw, "<u4", offset=1) if len(raw) % 2 else np.frombuffer(raw, "<u2").astype(np.uint32)


def _counts(tokens: DataFrame) -> np.ndarray:
    """Counts of all ids. What reaches the driver is bounded by the vocabulary."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column("ids"):
                ids = _ids(raw.as_py())
                found = np.bincount(ids, minlength=len(total))
                found[: len(total)] += total
                total = found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


@lean
def _write_part(batches, lengths: np.ndarray, out_dir: str):
    book, (store, root) = Codebook(lengths), _file_system(out_dir)
    part, name = TaskContext.get().partitionId(), f"{root}/part-{uuid.uuid4().hex}"
    held_ids, held, gathered, total_docs, total_ids, directory = [], [], 0, 0, 0, []
    at = len(MAGIC)
    with store.open_output_stream(name) as f:
        f.write(MAGIC)

        def put():
            nonlocal at, held, held_ids, gathered
            raw = block(book, held_ids, held)
            f.write(raw)
            directory.append(ENTRY.pack(at, len(raw), len(held), zlib.crc32(raw)))
            at += len(raw)
            held, held_ids, gathered = [], [], 0

        for batch in batches:
            for d, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = _ids(raw.as_py())
                held_ids.append(d)
                held.append(ids)
                gathered += len(ids)
                total_docs, total_ids = total_docs + 1, total_ids + len(ids)
                if gathered >= BLOCK_IDS:
                    put()
        if held:
            put()
        f.write(b"".join(directory) + FOOTER.pack(at, len(directory), book.checksum, MAGIC))
        at += len(directory) * ENTRY.size + FOOTER.size
    if not total_docs:
        store.delete_file(name)
        return
    yield pa.RecordBatch.from_pylist([{"part": part, "path": name, "n_docs": total_docs, "n_ids": total_ids, "n_bytes": at}])


def write_token_files(docs: DataFrame, out_dir: str, scratch: Scratch, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes all documents' ids in ascending doc_id order (nulls first); returns the manifest.

    One row per file: part (its place in the order), path, n_docs, n_ids, n_bytes.
    A file counts only when its task ended well: a repeated task writes another.
    """
    tokens = scratch.keep(_tokens(docs, tokenizer or default_tokenizer(), end_id), "tokens")
    book = Codebook(code_lengths(_counts(tokens)))
    store, root = _file_system(out_dir)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/codebook") as f:
        f.write(book.lengths.tobytes())
    lengths = book.lengths
    size = tokens.agg(F.sum(F.length("ids"))).first()[0] or 0
    parts = max(1, -(-size // PARTITION_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) if size > PARTITION_BYTES else 1)

    def run(batches):
        return _write_part(batches, lengths, out_dir)

    # Rows that share a doc_id, or have none, are parted by how their ids begin.
    order = F.col("doc_id").asc_nulls_first()
    placed = tokens.repartitionByRange(parts, order, F.substring("ids", 1, 16)).sortWithinPartitions(order, "ids")
    manifest = scratch.keep(placed.mapInArrow(run, "part long, path string, n_docs long, n_ids long, n_bytes long"), "manifest")
    scratch.drop("tokens")
    return manifest


@lean
def _read_parts(batches, out_dir: str):
    store, root = _file_system(out_dir)
    with store.open_input_file(f"{root}/codebook") as f:
        book = Codebook(np.frombuffer(f.read(), np.uint8))
    for batch in batches:
        for row in batch.to_pylist():
            with store.open_input_file(row["path"]) as f:
                start = row["base"]
                f.seek(row["n_bytes"] - FOOTER.size)
                at, blocks, checksum, magic = FOOTER.unpack(f.read(FOOTER.size))
                if magic != MAGIC or checksum != book.checksum:
                    raise ValueError(f"{row['path']} is no token file of this codebook")
                f.seek(at)
                directory = f.read(blocks * ENTRY.size)
                for where, size, _, crc in ENTRY.iter_unpack(directory):
                    f.seek(where)
                    if zlib.crc32(raw := f.read(size)) != crc:
                        raise ValueError(f"{row['path']} is damaged at {where}")
                    docs = list(read_block(book, raw))
                    sizes = np.array([len(ids) for _, ids in docs], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array(start + np.cumsum(sizes) - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([ids.tobytes() for _, ids in docs], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    start += int(sizes.sum())


def read_token_files(manifest: DataFrame, out_dir: str) -> DataFrame:
    """Documents read back: doc_id, start (ids of all documents before it), ids (uint32 bytes), n_tokens."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))

    def run(batches):
        return _read_parts(batches, out_dir)

    n = max(1, manifest.count())
    return files.select("path", "base", "n_bytes").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_digest(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            crc = [zlib.crc32(raw.as_buffer()) for raw in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return docs.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from the files.

    A null or empty text is the end id alone; a null doc_id comes first and
    stays null; repeated rows are written each; documents that share a doc_id
    are ordered by their ids; a very long text is one block; other columns are
    not read; an empty table gives no file and no rows.
    """
    scratch = Scratch(spark, "op5")
    out = f"{scratch.path}/files"
    return token_digest(read_token_files(write_token_files(table(spark, sf_dir, "documents"), out, scratch), out))
