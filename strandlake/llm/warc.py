"""WARC archives: a writer, and a sequential reader that verifies what it reads.

Writer: one gzip member per record, so that records stay addressable. Records
with equal payloads are written once as ``response``; the others are
``revisit`` records that carry the HTTP header and refer to the response.

Reader: one pass over a stream in fixed-size chunks. ``zlib.decompressobj``
inflates members as they come, a new one wherever a member ends; the WARC header
frames its block by Content-Length, across chunk and member borders; the
payload digest (and block digest) is recomputed and compared.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import Scratch, table
from strandlake.llm.tokens import slices

CHUNK = 1 << 16
#: An archive is closed when it holds about so many bytes of payloads.
ARCHIVE_BYTES = 256 << 20
MIN_REVISIT_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """The archive is damaged; the message says where and how."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int = 0  # of the record's first byte in the uncompressed stream
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def inflate(read: Callable[[int], bytes], chunk: int = CHUNK) -> Iterator[bytes]:
    """Uncompressed bytes of consecutive gzip members, or of a plain stream as it is."""
    raw = read(chunk)
    if raw[:2] != b"\x1f\x8b":
        while raw:
            yield raw
            raw = read(chunk)
        return
    member = zlib.decompressobj(31)
    while raw:
        try:
            out = member.decompress(raw, 16 * chunk)
        except zlib.error as e:
            raise WarcError(f"damaged gzip member: {e}") from e
        if out:
            yield out
        if member.eof:
            raw = member.unused_data.lstrip(b"\0") or read(chunk)
            if raw:
                member = zlib.decompressobj(31)
        else:
            raw = member.unconsumed_tail or read(chunk)
    if not member.eof:
        raise WarcError("the last gzip member is cut off")


class _Stream:
    """Lines and counted blocks from chunks."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.held, self.at = iter(chunks), bytearray(), 0

    def more(self) -> bool:
        got = next(self.chunks, None)
        if got is None:
            return False
        self.held += got
        return True

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise WarcError(f"the archive ends {n - len(self.held)} bytes early in the record at {self.at}")
        out = bytes(self.held[:n])
        del self.held[:n]
        self.at += n
        return out

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at a clean end."""
        seen = 0
        while (found := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.more():
                if self.held.strip():
                    raise WarcError(f"no record header at {self.at}")
                return None
        return self.take(found + len(mark))


def _fields(lines: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def read_records(read: Callable[[int], bytes], verify: bool = True) -> Iterator[Record]:
    """Records of one archive in order; raises ``WarcError`` at the first damage."""
    stream = _Stream(inflate(read))
    while True:
        while stream.held[:2] == b"\r\n" or (len(stream.held) < 2 and stream.more()):
            if stream.held[:2] == b"\r\n":
                stream.take(2)
        at = stream.at
        head = stream.until(b"\r\n\r\n")
        if head is None:
            return
        first, *lines = head.decode("utf-8", "replace").rstrip("\r\n").split("\r\n")
        if not first.startswith("WARC/"):
            raise WarcError(f"no WARC version at {at}")
        headers = _fields(lines)
        if not headers.get("content-length", "").isdigit():
            raise WarcError(f"no Content-Length in the record at {at}")
        record = Record(headers, stream.take(int(headers["content-length"])), at)
        record.payload = record.block
        if headers.get("content-type", "").startswith("application/http"):
            top, _, record.payload = record.block.partition(b"\r\n\r\n")
            record.http = _fields(top.decode("utf-8", "replace").split("\r\n")[1:])
        if verify:
            for name, held in (("warc-block-digest", record.block), ("warc-payload-digest", record.payload)):
                if name in headers and not (name == "warc-payload-digest" and record.kind == "revisit"):
                    algorithm, _, value = headers[name].partition(":")
                    if algorithm.lower() == "sha1" and value != digest(held):
                        raise WarcError(f"{name} doesn't match in the record at {at}")
        yield record


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+|null)>", uri or "")
    if not found:
        raise WarcError(f"no page in the id {uri}")
    return None if found[1] == "null" else int(found[1])


def make_record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\r\n]+", " ", url or "urn:unknown").strip() or "urn:unknown"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(batches: Iterable[pa.RecordBatch], out_dir: str) -> Iterator[pa.RecordBatch]:
    store, root = _file_system(out_dir)
    f = name = None
    n = gathered = 0
    for batch in batches:
        for part in slices([batch], "html"):
            for row in part.to_pylist():
                if f is None:
                    name = f"{root}/pages-{uuid.uuid4().hex}.warc.gz"
                    f = store.open_output_stream(name, compression=None)
                    n = gathered = 0
                payload = row["html"] or b""
                f.write(make_record(row["page_id"], row["url"], payload, row["digest"], row["refers_to"], row["revisit"]))
                n, gathered = n + 1, gathered + len(payload)
                if gathered >= ARCHIVE_BYTES:
                    f.close()
                    yield pa.RecordBatch.from_pylist([{"path": name, "n_records": n}])
                    f = None
    if f is not None:
        f.close()
        yield pa.RecordBatch.from_pylist([{"path": name, "n_records": n}])


def _read(batches: Iterable[pa.RecordBatch], out_dir: str) -> Iterator[pa.RecordBatch]:
    store, _ = _file_system(out_dir)
    for batch in batches:
        for archive in batch.to_pylist():
            rows, n = [], 0
            with store.open_input_stream(archive["path"], compression=None) as f:
                for r in read_records(f.read):
                    revisit = r.kind == "revisit"
                    rows.append((_page_id(r.headers.get("warc-record-id")), r.headers.get("warc-target-uri"), int(r.http["content-length"]), r.headers["warc-payload-digest"].partition(":")[2], r.kind, _page_id(r.headers.get("warc-refers-to")) if revisit else None, None if revisit else r.payload))
                    n += 1
                    if len(rows) == 512:
                        yield _rows(rows)
                        rows = []
            if n != archive["n_records"]:
                raise WarcError(f"{archive['path']}: {n} records for {archive['n_records']}")
            if rows:
                yield _rows(rows)


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in READ.split(", ")])


def _base32(hexed):
    """Bare upper-case base32 of a hex column, 8 bits to 5 by SQL alone."""
    bits = F.concat(*(F.lpad(F.conv(F.substring(hexed, k, 10), 16, 2), 40, "0") for k in range(1, 41, 10)))
    digits = [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(F.substring(bits, k, 5), 2, 10).cast("int") + 1, F.lit(1)) for k in range(1, 161, 5)]
    return F.concat(*digits)


def write_archives(pages: DataFrame, out_dir: str, scratch: Scratch, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes a record per row (page_id, url, html); returns the manifest (path, n_records).

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes, that
    with the largest page_id is the response (a null page_id only if all are
    null; rows that share the largest are all responses), the others revisit it.
    The join that finds them has one row per payload on one side, so Spark can
    split the groups of copies on the other.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("hexed", F.sha1("html"))
    largest = rows.filter(F.length("html") >= min_revisit_bytes).groupBy("hexed").agg(F.max("page_id").alias("largest")).withColumnRenamed("hexed", "same")
    rows = rows.join(largest, (F.col("hexed") == F.col("same")) & (F.length("html") >= min_revisit_bytes), "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    rows = rows.select("page_id", "url", "html", _base32(F.col("hexed")).alias("digest"), F.when(revisit, F.col("largest")).alias("refers_to"), revisit.alias("revisit"))
    store, root = _file_system(out_dir)
    store.create_dir(root, recursive=True)
    return scratch.keep(rows.mapInArrow(lambda batches: _write(batches, out_dir), "path string, n_records long"), "manifest")


def read_archives(manifest: DataFrame, out_dir: str) -> DataFrame:
    """All records of the archives of a manifest, one task per archive at best."""
    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(lambda batches: _read(batches, out_dir), READ)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to per page, as read back.

    A null html is an empty payload, a null url is ``urn:unknown``, a null
    page_id comes back null; repeated rows give a record each; an empty table
    gives no archive and no rows.
    """
    scratch = Scratch(spark, "op10")
    out = f"{scratch.path}/archives"
    return read_archives(write_archives(table(spark, sf_dir, "pages"), out, scratch), out).drop("url", "payload")


#: The digest is base32 by hand: DuckDB has sha1 as hex.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hexed, max(page_id) OVER (PARTITION BY html) AS largest FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_transform(range(5), lambda b:
       CASE WHEN (strpos('0123456789abcdef', substr(hexed, 1 + CAST((5 * k + b) // 4 AS INT), 1)) - 1) & (8 >> CAST((5 * k + b) % 4 AS INT)) > 0 THEN 16 >> CAST(b AS INT) ELSE 0 END), lambda x, y: x + y), 1), '' ORDER BY k) FROM range(32) r(k)) AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to
FROM q
"""
