"""Removal of repeated byte strings by prefix-free parsing.

A byte is removed when a ``MATCH``-byte string over it also starts in a document
with a smaller doc_id. The corpus' suffixes, in order to a depth of ``MATCH``
bytes, tell which: of equal neighbours, all but those of the least document.
That order is built from a parse and a dictionary instead of from all suffixes:

1. Parse. A rolling hash over ``MATCH - 1`` bytes triggers a cut wherever it is 0
   modulo ``STRIDE``; a phrase runs from a trigger to the end of the next one.
   Phrases overlap by a trigger, so every string of ``MATCH`` bytes lies in
   exactly one phrase of its document. The dictionary is the distinct phrases,
   each with its least document; the parse says where they occur. An occurrence
   in a later document is a repeat from end to end and needs no suffixes. What
   repeats is so handled once per phrase, which is the point on such text.
2. Anchors. Only suffixes of dictionary phrases at their least document are
   left. Those that can be equal share their anchor: the least-hashed
   ``GRAM``-byte string in their first ``MATCH`` bytes. Suffixes whose anchor no
   other document has are dropped. The others travel by their anchor, as pieces
   of text that hold all neighbouring suffixes with the same one.
3. Suffix arrays. Each task sorts the suffixes of its pieces to depth ``MATCH``
   by prefix doubling. Of equal neighbours all but the least document's repeat.
   Suffixes with an anchor that very many documents have (``hot``) travel by
   a hash of their own bytes instead, each task's equal ones as one, as far as
   it remembers them. Of equal pieces only the least document's are sorted.

All exchanges carry packed arrays. A string found in very many documents is cut
down to one entry per batch before it is sent, so no task gets a hot one whole;
which anchors are hot is a bit map of fixed size.
Equality is that of bytes, or for whole phrases of a 128-bit digest; the 48-bit
hashes of anchors only select candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strandlake.llm.common import Scratch, lean, table
from strandlake.llm.minhash import mix64
from strandlake.llm.tokens import slices

MATCH = 50
GRAM = 24
STRIDE = 128
#: Bytes of text of a batch: numpy holds some hundred times as much.
BATCH = 1 << 20
#: Places hashed at a time, and windows with a hot anchor that a task remembers, at most.
BLOCK, KNOWN = 1 << 15, 1 << 18
#: Bytes of the input for a partition of an exchange, at most, as Spark estimates them.
PARTITION_BYTES = 16 << 20

BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = mix64(np.arange(1, 257, dtype=np.uint64) * BASE)
LAST = (1 << 63) - 1  # stands for a null doc_id: after all others

#: Bits of the map of hot anchors. An anchor is hot if more documents have it than
#: HOT_DOCS, whose pieces are a quarter of a megabyte, or one in HOT_SHARE.
HOT_BITS = 1 << 20
HOT_DOCS = 4096
HOT_SHARE = 20_000
#: Parts in which texts are brought together with their flags, one after the other.
PASSES = 2
#: Buckets of the suffixes' exchange per partition: a task works on one at a time.
SPREAD = 8

ANCHOR, PHRASE, SUFFIX, DONE, HOT = range(5)
ROUTED = "bucket long, kind int, uid long, doc long, blob binary"
FLAGGED = "uid long, doc long, kind int, blob binary"


def gram_hashes(buf: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Rolling hashes of all strings of each size, a block that fits a core's cache at a time."""
    out = {s: np.empty(max(0, len(buf) - s + 1), np.uint64) for s in sizes}
    for a in range(0, len(buf), BLOCK):
        for s, h in _block_hashes(buf[a : a + BLOCK + max(sizes) - 1], sizes).items():
            most = max(0, min(BLOCK, len(out[s]) - a))
            out[s][a : a + most] = h[:most]
    return out


def _block_hashes(buf: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """The same of one block, by doubling."""
    def joined(head: np.ndarray, tail: np.ndarray, power: np.uint64) -> np.ndarray:
        out = head * power
        out += tail
        return out

    h = _SPREAD[buf]
    out = {s: (None, 0) for s in sizes}
    power, size = BASE, 1
    while True:
        for s in sizes:
            if s & size:
                got, have = out[s]
                if got is None:
                    out[s] = (h, size)
                else:
                    n = len(h) - have
                    out[s] = (joined(got[:n], h[have : have + n], power) if n > 0 else h[:0], have + size)
        if size * 2 > max(sizes):
            break
        n = len(h) - size
        h = joined(h[:n], h[size : size + n], power) if n > 0 else h[:0]
        with np.errstate(over="ignore"):
            power = power * power
        size *= 2
    return {s: mix64(v) for s, (v, _) in out.items()}


class Parsed:
    """Phrases and anchors of a batch of texts, laid end to end."""

    def __init__(self, texts: list[bytes], match: int = MATCH, gram: int = GRAM, stride: int = STRIDE):
        self.texts, self.match = texts, match
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.raw = b"".join(texts)
        self.buf = np.frombuffer(self.raw, np.uint8)
        n, trigger = len(self.buf), match - 1
        grams = gram_hashes(self.buf, (gram, trigger))
        place = np.int32 if n < 1 << 31 else np.int64  # half the memory
        doc = np.repeat(np.arange(len(texts), dtype=place), self.sizes)
        left = self.ends.astype(place)[doc]  # bytes from here to the document's end
        left -= np.arange(n, dtype=place)
        #: Where a string of ``match`` bytes starts, and its document.
        self.windows = np.flatnonzero(left >= match).astype(place)
        self.doc = doc
        cuts = np.flatnonzero(grams.pop(trigger) & np.uint64(stride - 1) == 0) if n >= trigger else np.zeros(0, np.int64)
        cuts = cuts[(left[cuts] >= match)]
        del left
        firsts = self.starts[self.sizes >= match]
        self.phrase_at = np.union1d(cuts, firsts)
        self.phrase_doc = doc[self.phrase_at]
        after = np.append(self.phrase_at[1:], n)
        own = np.append(self.phrase_doc[1:], -1) == self.phrase_doc
        self.phrase_end = np.where(own, after + trigger, self.ends[self.phrase_doc])
        # The anchor of each window: the first of the least gram hashes in it.
        if len(self.windows):
            key = grams[gram] & np.uint64(0xFFFFFFFF00000000)
            key |= np.arange(len(key), dtype=np.uint64)
            width, size = match - gram + 1, 1
            while size * 2 <= width:
                key = np.minimum(key[:-size], key[size:])
                size *= 2
            if size < width:
                key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
            self.anchor_at = (key[self.windows] & np.uint64(0xFFFFFFFF)).astype(place)
            del key
            self.anchor_key = grams[gram][self.anchor_at] & np.uint64((1 << 48) - 1)
        else:
            self.anchor_at, self.anchor_key = np.zeros(0, place), np.zeros(0, np.uint64)

    def digests(self) -> np.ndarray:
        """128 bits of each phrase."""
        make, raw = hashlib.blake2b, self.raw
        got = b"".join(make(raw[a:b], digest_size=16).digest() for a, b in zip(self.phrase_at.tolist(), self.phrase_end.tolist(), strict=True))
        return np.frombuffer(got, np.uint64).reshape(-1, 2)


def _least(doc: np.ndarray, head: np.ndarray) -> np.ndarray:
    """For sorted groups that begin at ``head``: the least document, per member."""
    sizes = np.diff(np.append(head, len(doc)))
    return np.repeat(np.minimum.reduceat(doc, head), sizes) if len(doc) else doc


def _heads(*sorted_keys: np.ndarray) -> np.ndarray:
    n = len(sorted_keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(arrays), *(len(a) for a in arrays)], "<u4").tobytes(), *(a.tobytes() for a in arrays)])


def _unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    sizes, at, out = np.frombuffer(raw, "<u4", n, 4), 4 + 4 * n, []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size, at))
        at += out[-1].nbytes
    return out


class _Out:
    """Rows of one kind of record batch, yielded in portions."""

    def __init__(self, names: tuple[str, ...], types: tuple):
        self.names, self.types, self.rows = names, types, []

    def add(self, *row):
        self.rows.append(row)

    def batches(self, most: int = 4096) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(self.rows), most):
            cols = zip(*self.rows[k : k + most], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, self.types, strict=True)], names=list(self.names))
        self.rows = []


def _routed() -> _Out:
    return _Out(("bucket", "kind", "uid", "doc", "blob"), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))


def _flagged() -> _Out:
    return _Out(("uid", "doc", "kind", "blob"), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))


def _per_doc(which: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(which):
        return
    order = np.argsort(which, kind="stable")
    which, values = which[order], values[order]
    head = np.flatnonzero(np.diff(which, prepend=-1))
    for a, b in zip(head.tolist(), np.append(head[1:], len(which)).tolist(), strict=True):
        yield int(which[a]), values[a:b]


def _by_bucket(route: np.ndarray, own: np.ndarray, buckets: int) -> tuple[np.ndarray, Iterator[tuple[int, int, int, np.ndarray]]]:
    """Order by bucket and document; and of each bucket its first and last place, and where its documents begin."""
    bucket = (route % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((own, bucket))
    if not len(order):
        return order, iter(())
    bucket, own = bucket[order], own[order]
    new = _heads(bucket, own)
    head = _heads(bucket)
    cuts = np.searchsorted(new, np.append(head, len(bucket))).tolist()
    ends = np.append(head[1:], len(bucket)).tolist()
    spans = zip(bucket[head].tolist(), head.tolist(), ends, cuts[:-1], cuts[1:], strict=True)
    return order, ((b, first, last, new[a:z]) for b, first, last, a, z in spans)


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]


@lean
def _parse(batches: Iterator[pa.RecordBatch], buckets: int, match: int) -> Iterator[pa.RecordBatch]:
    """Anchors and phrases of each batch, once each; what the batch itself repeats is flagged."""
    for batch in batches:
        for part in slices([batch], "text", BATCH):
            yield from _parse_part(part, buckets, match)


def _parse_part(part: pa.RecordBatch, buckets: int, match: int) -> Iterator[pa.RecordBatch]:
    """``_parse`` of one slice; what it takes is free again before the next one."""
    uid, doc = part.column("uid").to_numpy(), part.column("doc").to_numpy()
    p, out = Parsed(_texts(part), match), _routed()
    if not len(p.windows):
        return
    # Anchors: one entry per distinct anchor and document.
    first = np.flatnonzero(np.diff(p.anchor_at, prepend=-1))
    key, own = p.anchor_key[first], p.doc[p.windows[first]]
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    one = _heads(key, own)
    key, own = key[one], own[one]
    head = _heads(key)
    shared = np.repeat(np.diff(np.append(head, len(key))) > 1, np.diff(np.append(head, len(key))))
    for d, keys in _per_doc(own[shared], key[shared]):
        out.add(int(uid[d]) % buckets, DONE, int(uid[d]), int(doc[d]), bytes([ANCHOR]) + keys.astype("<u4").tobytes())
    many = np.minimum(np.diff(np.append(head, len(key))), 255).astype(np.uint8)
    key, own = key[head], own[head]
    order, spans = _by_bucket(key, own, buckets)
    own = own[order]
    low = np.ascontiguousarray(key[order]).view(np.uint8).reshape(-1, 8)[:, :7].copy()
    low[:, 6] = many[order]
    for b, first, last, head in spans:
        docs = own[head]
        out.add(b, ANCHOR, None, None, _pack(uid[docs], doc[docs], np.diff(head, append=last).astype("<u4"), low[first:last].reshape(-1)))
    # Phrases: one entry per distinct phrase, at its least document here.
    digest, own = p.digests(), p.phrase_doc
    order = np.lexsort((uid[own], doc[own], digest[:, 1], digest[:, 0]))
    digest, own = digest[order], own[order]
    head = _heads(digest[:, 0], digest[:, 1])
    repeats = doc[own] > _least(doc[own], head)
    for d, keys in _per_doc(own[repeats], digest[repeats, 0]):
        out.add(int(uid[d]) % buckets, DONE, int(uid[d]), int(doc[d]), bytes([PHRASE]) + keys.tobytes())
    for b, at in _per_doc((digest[head, 0] % np.uint64(buckets)).astype(np.int64), head):
        out.add(b, PHRASE, None, None, _pack(np.ascontiguousarray(digest[at]).reshape(-1), uid[own[at]], doc[own[at]]))
    yield from out.batches()


def _gathered(batches: Iterator[pa.RecordBatch], out: _Out) -> dict[int, dict[int, list[bytes]]]:
    """Blobs by bucket and kind; what is done already goes out."""
    held: dict[int, dict[int, list[bytes]]] = {}
    for batch in batches:
        for bucket, kind, uid, doc, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "uid", "doc", "blob")), strict=True):
            if kind == DONE:
                out.add(uid, doc, blob[0], blob[1:])
            else:
                held.setdefault(bucket, {}).setdefault(kind, []).append(blob)
    return held


@lean
def _match_keys(batches: Iterator[pa.RecordBatch], hot_docs: int) -> Iterator[pa.RecordBatch]:
    """Flags anchors that several documents have, and phrases that an earlier one has."""
    out = _flagged()
    buckets = _gathered(batches, out)
    yield from out.batches()
    while buckets:
        yield from _match_bucket(buckets.popitem()[1], out, hot_docs)


def _match_bucket(held: dict[int, list[bytes]], out: _Out, hot_docs: int) -> Iterator[pa.RecordBatch]:
    if ANCHOR in held:
        parts = [_unpack(b, "<i8", "<i8", "<u4", "u1") for b in held.pop(ANCHOR)]
        counts = [p[2] for p in parts]
        uid, doc = (np.concatenate([np.repeat(p[k], c) for p, c in zip(parts, counts, strict=True)]) for k in (0, 1))
        low = np.concatenate([p[3] for p in parts]).reshape(-1, 7)
        key = np.zeros((len(low), 8), np.uint8)
        key[:, :6] = low[:, :6]
        key = key.view("<u8").reshape(-1)
        order = np.argsort(key, kind="stable")
        key, uid, doc, many = key[order], uid[order], doc[order], low[order, 6].astype(np.int64)
        head = _heads(key)
        sizes = np.diff(np.append(head, len(key)))
        hot = key[head][np.add.reduceat(many, head) > hot_docs]
        for slot in np.unique(hot % np.uint64(HOT_BITS)).tolist():
            out.add(None, slot, HOT, b"")
        shared = np.repeat(sizes > 1, sizes)
        # Within a document the lower half tells anchors apart; what it mixes up is one more candidate.
        yield from _flags(out, ANCHOR, uid[shared], doc[shared], key[shared].astype("<u4"))
    if PHRASE in held:
        parts = [_unpack(b, "<u8", "<i8", "<i8") for b in held.pop(PHRASE)]
        digest = np.concatenate([p[0] for p in parts]).reshape(-1, 2)
        uid, doc = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        order = np.lexsort((digest[:, 1], digest[:, 0]))
        digest, uid, doc = digest[order], uid[order], doc[order]
        repeats = doc > _least(doc, _heads(digest[:, 0], digest[:, 1]))
        yield from _flags(out, PHRASE, uid[repeats], doc[repeats], digest[repeats, 0])


def _flags(out: _Out, kind: int, uid: np.ndarray, doc: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(uid):
        return
    order = np.lexsort((doc, uid))
    uid, doc, values = uid[order], doc[order], values[order]
    head = _heads(uid, doc)
    for a, b in zip(head.tolist(), np.append(head[1:], len(uid)).tolist(), strict=True):
        out.add(int(uid[a]), int(doc[a]), kind, values[a:b].tobytes())
    yield from out.batches()


def _members(keys: np.ndarray, doc: np.ndarray, flags: list[np.ndarray]) -> np.ndarray:
    """For each (document, key) of a batch: whether its document's flags hold the key."""
    held = np.concatenate([np.zeros(0, np.uint64), *flags])
    if not len(keys) or not len(held):
        return np.zeros(len(keys), bool)
    owner = np.repeat(np.arange(len(flags)), [len(f) for f in flags])
    # Keys and documents are numbered, so that one lookup serves the batch.
    order = np.lexsort((owner, held))
    held, owner = held[order], owner[order]
    values = held[_heads(held)]
    at = np.minimum(np.searchsorted(values, keys), len(values) - 1)
    rank = np.searchsorted(values, held)
    both = rank * len(flags) + owner
    return (values[at] == keys) & np.isin(at * len(flags) + doc, both)


def _send(out: _Out, p: Parsed, uid: np.ndarray, doc: np.ndarray, at: np.ndarray, size: np.ndarray, own: np.ndarray, route: np.ndarray, buckets: int) -> None:
    """Pieces of text (start, size, document) to the buckets of their routes."""
    order, spans = _by_bucket(route, own, buckets)
    at, size, own = at[order], size[order], own[order]
    ends = np.cumsum(size)
    text = p.buf[np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
    short, pos, small = size.astype("<u2"), (at - p.starts[own]).astype("<u4"), zstandard.ZstdCompressor(level=1)
    for b, first, last, head in spans:
        docs = own[head]
        index = np.repeat(np.arange(len(head), dtype="<u4"), np.diff(head, append=last))
        raw = _pack(text[ends[first] - size[first] : ends[last - 1]], short[first:last], uid[docs], doc[docs], index, pos[first:last])
        out.add(b, SUFFIX, None, None, small.compress(raw))


class _Known:
    """Windows with a hot anchor that a task has sent, ``KNOWN`` at most, and their least document."""

    def __init__(self, match: int):
        self.hashes, self.text, self.doc = np.zeros(0, np.uint64), np.zeros((0, match), np.uint8), np.zeros(0, np.int64)

    def later(self, hashes: np.ndarray, text: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which of these distinct windows a document before theirs has sent; the others are remembered."""
        out = np.zeros(len(hashes), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            same = np.flatnonzero(self.hashes[at] == hashes)
            same = same[(self.text[at[same]] == text[same]).all(1)]
            out[same] = self.doc[at[same]] < doc[same]
            self.doc[at[same]] = np.minimum(self.doc[at[same]], doc[same])
            fresh = np.ones(len(hashes), bool)
            fresh[same] = False
        else:
            fresh = np.ones(len(hashes), bool)
        new = np.flatnonzero(fresh)[: KNOWN - len(self.hashes)]
        both = np.concatenate([self.hashes, hashes[new]])
        order = np.argsort(both, kind="stable")
        self.hashes, self.text, self.doc = both[order], np.concatenate([self.text, text[new]])[order], np.concatenate([self.doc, doc[new]])[order]
        return out


@lean
def _suffixes(batches: Iterator[pa.RecordBatch], buckets: int, match: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Dictionary suffixes of each batch that may repeat; spans that are known to."""
    sent = _Known(match)
    for batch in batches:
        for part in slices([batch], "text", BATCH):
            yield from _suffixes_part(part, sent, buckets, match, hot)


def _suffixes_part(part: pa.RecordBatch, sent: _Known, buckets: int, match: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``_suffixes`` of one slice; what it takes is free again before the next one."""
    uid, doc = part.column("uid").to_numpy(), part.column("doc").to_numpy()
    p, out = Parsed(_texts(part), match), _routed()
    if not len(p.windows):
        return
    flags = {ANCHOR: [], PHRASE: []}
    for row in part.column("flags").to_pylist():
        for kind, size in ((ANCHOR, "<u4"), (PHRASE, "<u8")):
            flags[kind].append(np.frombuffer(b"".join(f["blob"] for f in row if f["kind"] == kind), size).astype(np.uint64))
    repeat = _members(p.digests()[:, 0], p.phrase_doc, flags[PHRASE])
    marks = np.zeros(len(p.buf) + 1, np.int32)
    np.add.at(marks, p.phrase_at[repeat], 1)
    np.add.at(marks, p.phrase_end[repeat], -1)
    begins = np.zeros(len(p.buf), np.int32)
    begins[p.phrase_at] = 1
    phrase = np.cumsum(begins, dtype=np.int32)[p.windows] - 1
    own = p.doc[p.windows]
    first = np.flatnonzero(np.diff(p.anchor_at, prepend=-1) | np.diff(own, prepend=-1))
    known = np.repeat(_members(p.anchor_key[first] & np.uint64(0xFFFFFFFF), own[first], flags[ANCHOR]), np.diff(np.append(first, len(own))))
    left = np.flatnonzero(known & ~repeat[phrase])
    at, own, key = p.windows[left], own[left], p.anchor_key[left]
    own_way = hot[(key % np.uint64(HOT_BITS)).astype(np.int64)]
    if own_way.any():
        h_at, h_own = at[own_way], own[own_way]
        text = np.lib.stride_tricks.sliding_window_view(p.buf, match)[h_at]
        order = _byte_order(text)
        text, h_at, h_own = text[order], h_at[order], h_own[order]
        head = _text_heads(text)
        least = _least(doc[h_own], head)
        route = gram_hashes(text[head].reshape(-1), (match,))[match][::match]
        later = np.repeat(sent.later(route, text[head], least[head]), np.diff(np.append(head, len(text))))
        again = later | (doc[h_own] > least)
        np.add.at(marks, h_at[again], 1)
        np.add.at(marks, h_at[again] + match, -1)
        route = np.repeat(route, np.diff(np.append(head, len(text))))[~again]
        _send(out, p, uid, doc, h_at[~again], np.full(len(route), match), h_own[~again], route, buckets)
    at, own, key, anchor = at[~own_way], own[~own_way], key[~own_way], p.anchor_at[left][~own_way]
    if len(at):
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(anchor) != 0)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at))) + match - 1
        _send(out, p, uid, doc, at[first], size, own[first], key[first], buckets)
    # No span leaves its document, so one sum over the batch will do.
    hit = np.cumsum(marks)[: len(p.buf)] > 0
    for d, (a, b) in enumerate(zip(p.starts.tolist(), p.ends.tolist(), strict=True)):
        if hit[a:b].any():
            out.add(int(uid[d]) % buckets, DONE, int(uid[d]), int(doc[d]), bytes([DONE]) + _runs(hit[a:b]).astype("<u4").tobytes())
    yield from out.batches()


def _byte_order(text: np.ndarray) -> np.ndarray:
    """Order of rows of bytes: as big-endian numbers, eight bytes at a time."""
    n, width = text.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = text
    words = padded.view(">u8").astype(np.uint64)
    return np.lexsort(words.T[::-1])


def _text_heads(text: np.ndarray) -> np.ndarray:
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]).any(1)
    return np.flatnonzero(new)


def _runs(hit: np.ndarray) -> np.ndarray:
    """Starts and ends, by turns, of the runs of True."""
    edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).reshape(-1)


def _sorted_with_index(key: np.ndarray, key_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, and where each was: by one sort of key and index in a word, if they fit."""
    bits = max(1, int(len(key)).bit_length())
    if key_bits + bits > 64:
        order = np.argsort(key)
        return key[order], order
    both = np.sort(key << np.uint64(bits) | np.arange(len(key), dtype=np.uint64))
    return both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def suffix_order(buf: np.ndarray, at: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at ``at`` in order of their first ``match`` bytes, and where a new string begins.

    Prefix doubling: ranks by 5 bytes, then by pairs of ranks 10, 20, ... bytes deep.
    """
    wide = np.concatenate([buf, np.zeros(match, np.uint8)]).astype(np.uint64)
    depth = min(5, match)
    n = len(wide) - depth + 1
    key, bits = wide[:n], 8 * depth
    for k in range(1, depth):
        key = key << np.uint64(8) | wide[k : n + k]
    while depth < match:
        ordered, index = _sorted_with_index(key, bits)
        new = np.zeros(len(key), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(len(key), np.uint64)
        rank[index] = np.cumsum(new, dtype=np.uint64)
        half = max(1, int(rank.max(initial=0)).bit_length())
        step = min(depth, match - depth)
        key, bits, depth = rank[:-step] << np.uint64(half) | rank[step:], 2 * half, depth + step
    ordered, order = _sorted_with_index(key[at], bits)
    return order, _heads(ordered)


def _repeated_pieces(buf: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which pieces of text an earlier document has, too, byte for byte: they repeat from end to end."""
    raw, ends, first = buf.tobytes(), np.cumsum(size), {}
    which = np.array([first.setdefault(raw[a:b], len(first)) for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)], np.int64)
    least = np.full(len(first), LAST)
    np.minimum.at(least, which, doc)
    return doc > least[which]


@lean
def _merge(batches: Iterator[pa.RecordBatch], match: int) -> Iterator[pa.RecordBatch]:
    """The suffix array of each bucket; flags suffixes that an earlier document has."""
    out = _flagged()
    buckets = _gathered(batches, out)
    yield from out.batches()
    while buckets:
        parts = [_unpack(zstandard.decompress(b), "u1", "<u2", "<i8", "<i8", "<u4", "<u4") for b in buckets.popitem()[1][SUFFIX]]
        buf = np.concatenate([p[0] for p in parts])
        size = np.concatenate([p[1] for p in parts]).astype(np.int64)
        uid, doc = (np.concatenate([p[k][p[4]] for p in parts]) for k in (2, 3))
        pos = np.concatenate([p[5] for p in parts]).astype(np.int64)
        del parts
        whole = _repeated_pieces(buf, size, doc)
        if whole.any():
            ends = np.stack([pos[whole], pos[whole] + size[whole]], 1).astype("<u4")
            yield from _flags(out, DONE, uid[whole], doc[whole], ends)
        buf, size, uid, doc, pos = buf[np.repeat(~whole, size)], size[~whole], uid[~whole], doc[~whole], pos[~whole]
        n = size - match + 1
        piece = np.repeat(np.arange(len(size)), n)
        offset = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        order, head = suffix_order(buf, (np.cumsum(size) - size)[piece] + offset, match)
        piece, offset = piece[order], offset[order]
        mine = doc[piece]
        again = mine > _least(mine, head)
        piece, offset = piece[again], offset[again]
        if len(piece):
            order = np.lexsort((offset, piece))
            piece, offset = piece[order], offset[order]
            new = np.ones(len(piece), bool)
            new[1:] = (np.diff(piece) != 0) | (np.diff(offset) != 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(piece)) - 1
            at = pos[piece]
            spans = np.stack([at[first] + offset[first], at[last] + offset[last] + match], 1).astype("<u4")
            yield from _flags(out, DONE, uid[piece[first]], doc[piece[first]], spans)


def _flags_by_document(flags: DataFrame) -> DataFrame:
    return flags.groupBy("uid", "doc").agg(F.collect_list(F.struct("kind", "blob")).alias("flags"))


def _keyed(docs: DataFrame) -> DataFrame:
    docs = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("__doc"), F.col("text").cast("string").alias("__text"))
    return docs.withColumn("__uid", F.xxhash64("__doc", "__text"))


def _partitions(docs: DataFrame) -> int:
    """The session's, or as many as the input's estimated bytes ask for."""
    found = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, found, -(-size // PARTITION_BYTES) if size < 1 << 55 else 0)  # beyond: not known


def repeated_spans(docs: DataFrame, scratch: Scratch, match: int = MATCH) -> DataFrame:
    """(uid, doc, flags) of documents that have bytes to remove.

    The blobs of ``flags`` hold pairs of byte offsets; ``removed`` unites them.
    """
    texts = _keyed(docs).select(F.col("__uid").alias("uid"), F.col("__doc").alias("doc"), F.col("__text").alias("text"))
    n = _partitions(texts)
    buckets = SPREAD * n
    hot_docs = max(HOT_DOCS, docs.count() // HOT_SHARE)
    keys = texts.mapInArrow(lambda b: _parse(b, n, match), ROUTED).repartitionById(n, F.col("bucket").cast("int")).mapInArrow(lambda b: _match_keys(b, hot_docs), FLAGGED)
    keys = scratch.keep(keys, "keys")
    hot = np.zeros(HOT_BITS, bool)  # of fixed size, and so is what comes to the driver
    hot[keys.filter(F.col("kind") == HOT).select("doc").distinct().toArrow()["doc"].to_numpy()] = True
    flags = scratch.keep(_flags_by_document(keys.filter(F.col("kind") != HOT)), "flags")
    scratch.drop("keys")
    known = flags.select(F.col("uid").alias("u"), F.col("doc").alias("d"), "flags")
    # In the order of documents, so that what a task remembers comes from the first ones. A part at a time,
    # written: else the shuffle of all texts would lie beside their flags and what comes of both, or beside the next one.
    part = lambda uid, k: F.pmod(F.col(uid), F.lit(PASSES)) == k
    of = lambda k: texts.filter(part("uid", k)).join(known.filter(part("u", k)), (F.col("doc") == F.col("d")) & (F.col("uid") == F.col("u")))
    marked = reduce(DataFrame.unionByName, [scratch.keep(of(k).select("uid", "doc", "text", "flags"), f"marked{k}", "zstd") for k in range(PASSES)])
    scratch.drop("flags")
    suffixes = marked.mapInArrow(lambda b: _suffixes(b, buckets, match, hot), ROUTED).repartitionById(n, (F.col("bucket") % n).cast("int"))
    spans = scratch.keep(_flags_by_document(suffixes.mapInArrow(lambda b: _merge(b, match), FLAGGED)), "spans")
    for k in range(PASSES):
        scratch.drop(f"marked{k}")
    return spans


def removed(n_bytes: int, flags: list[dict] | None) -> np.ndarray:
    """Runs to remove of a document: starts and ends by turns."""
    if not flags:
        return np.zeros(0, np.int64)
    marks = np.zeros(n_bytes + 1, np.int32)
    got = np.frombuffer(b"".join(f["blob"] for f in flags), "<u4").astype(np.int64)
    np.add.at(marks, got[::2], 1)
    np.add.at(marks, got[1::2], -1)
    return _runs(np.cumsum(marks)[:n_bytes] > 0)


def _whole_characters(raw: bytes, runs: np.ndarray) -> np.ndarray:
    """Runs drawn in to character borders, so that what is left is valid UTF-8."""
    buf = np.frombuffer(raw, np.uint8)
    out = []
    for a, b in zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True):
        while a < b and buf[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(buf) and buf[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out += [a, b]
    return np.array(out, np.int64)


def kept_bytes(raw: bytes, runs: np.ndarray) -> bytes:
    edges = [0, *runs.tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _with_spans(docs: DataFrame, scratch: Scratch, match: int) -> DataFrame:
    spans = repeated_spans(docs, scratch, match)
    known = spans.select(F.col("uid").alias("__u"), F.col("doc").alias("__d"), F.col("flags").alias("__flags"))
    return _keyed(docs).join(known, (F.col("__uid") == F.col("__u")) & (F.col("__doc") == F.col("__d")), "left")


def remove_repeats(docs: DataFrame, scratch: Scratch, match: int = MATCH) -> DataFrame:
    """The documents with repeated strings cut out of ``text`` (at whole characters).

    Rows and columns stay; a document that repeats from end to end keeps an empty
    text, and a null text stays null. ``n_chars``, where there is one, is made
    to fit. For nulls, ties and repeated rows see ``removal_digest``.
    """
    columns = docs.columns

    @lean
    def run(batches):
        for batch in batches:
            for part in slices([batch], "__text", BATCH):
                out = []
                for t, flags in zip(part.column("__text").to_pylist(), part.column("__flags").to_pylist(), strict=True):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    runs = _whole_characters(raw, removed(len(raw), flags))
                    out.append(kept_bytes(raw, runs).decode("utf-8", "surrogatepass") if len(runs) else t)
                yield part.select(columns).append_column("__kept", pa.array(out, part.schema.field("__text").type))

    found = _with_spans(docs, scratch, match)
    cut = found.mapInArrow(run, StructType([*docs.schema.fields, StructField("__kept", StringType())]))
    fresh = {"text": F.col("__kept"), "n_chars": F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("__kept"), F.lit(0))).cast(docs.schema["n_chars"].dataType) if "n_chars" in columns else None}
    return cut.select(*(fresh[c].alias(c) if fresh.get(c) is not None else F.col(c) for c in columns))


def removal_digest(docs: DataFrame, scratch: Scratch, match: int = MATCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of (doc_id, text).

    A null text is empty; texts of fewer than ``match`` bytes lose nothing. A null
    doc_id comes after all others. Rows that share a doc_id never remove from
    each other. Very long texts are taken whole; other columns are not read. An
    empty table gives no rows.
    """

    @lean
    def run(batches):
        for batch in batches:
            for part in slices([batch], "text", BATCH):
                rows = []
                for t, flags in zip(part.column("text").to_pylist(), part.column("__flags").to_pylist(), strict=True):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    runs = removed(len(raw), flags)
                    rows.append((len(raw), int((runs[1::2] - runs[::2]).sum()), len(runs) // 2, hashlib.sha256(kept_bytes(raw, runs)).hexdigest()))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scratch, match)
    return found.select("doc_id", F.col("__text").alias("text"), "__flags").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that repeat a 50-byte string of an earlier one, removed."""
    return removal_digest(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))
