"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

1. Signatures (one pass over the texts). Every element of a document's shingle
   set draws a random permutation of the ``HASHES`` places, one rank at a time;
   at rank j it offers j + u to its place, and a place keeps the least offer.
   As offers of rank j are at least j, drawing ends once every place holds less:
   after a few ranks for a long document. The draws of all elements of a batch
   of documents are made side by side.
2. Classes. Documents with equal sets (a 128-bit digest) are one class, known by
   its least doc_id; everything below sees a class once.
3. Banding. A class falls into one bucket per band of its signature. In every
   bucket one class is drawn as hub; the others are compared with it, never all
   with all.
4. Verification on the whole sets, by a join; links are closed to components.
5. Where a bucket still holds several components, its smaller ones are compared
   with further hubs from its largest, ``ROUNDS`` times over.
6. What is apart then is compared in full: in every bucket that holds several
   components, each class outside the largest one with every class of another
   component, unless one of three exact bounds rules the pair out. Jaccard distance
   is a metric, so classes whose distances to the bucket's first hub differ by
   more than the distance allowed cannot be near. No more of a class can be
   shared with another than the elements that any other class of these buckets
   has. And the elements that only one of two sets has are at least as many as the
   places where their parity maps differ (``PARITY`` places, each the parity of the
   number of elements that hash to it). So no candidate pair is lost, and pairs
   are only listed where their outcome can matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import Scratch, lean, table
from strandlake.llm.graph import components
from strandlake.llm.tokens import slices

#: 24 bands of 5: a pair of similarity 0.8 shares none with probability 7e-5.
BANDS = 24
ROWS = 5
HASHES = BANDS * ROWS
PERCENT = 80
#: Further hubs that are tried before the full comparison.
ROUNDS = 1
#: Places of a set's parity map, a multiple of 64.
PARITY = 1024
#: Elements whose draws are made side by side.
ELEMENTS = 1 << 15


def words(text: str | None) -> list[bytes]:
    """Words in UTF-8, A-Z as a-z: both are what ``bytes`` does with ASCII letters and white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    out = x >> np.uint64(30)
    out ^= x
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class Shingler:
    """Shingle sets as sorted distinct 64-bit hashes; hashes of words are kept, up to a bound."""

    KNOWN = 300_000

    def __init__(self, shingle_words: int):
        self.k, self.known = shingle_words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found, known = words(text), self.known
        hashes = [*map(known.get, found)]
        if None in hashes:
            new = {w: word_hash(w) for w, h in zip(found, hashes, strict=True) if h is None}
            if len(known) < self.KNOWN:
                known.update(new)
            hashes = [new[w] if h is None else h for w, h in zip(found, hashes, strict=True)]
        h = np.array(hashes, np.uint64)
        k = min(self.k, len(h))
        if not k:
            return h
        n = len(h) - k + 1
        out = np.full(n, np.uint64(k))
        for i in range(k):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
        return np.unique(out)


def signatures(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """SuperMinHash signatures, one row per (non-empty) set."""
    n = len(sets)
    best = np.full((n, hashes), np.inf, np.float32)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    state = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    perm, flat = None, best.reshape(-1)
    for j in range(hashes):
        draw = mix64(state + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        u = (draw & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
        k = j + ((draw >> np.uint64(32)) * np.uint64(hashes - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            place = first = k
        else:
            if perm is None:
                perm = np.tile(np.arange(hashes, dtype=np.uint8 if hashes <= 256 else np.uint16), (len(state), 1))
                at = np.arange(len(state))
                perm[at, first] = 0
            at = np.arange(len(state))
            place = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
        _lower(flat, doc * hashes + place, u + np.float32(j))
        done = best.max(1) <= j + 1
        if done.all():
            break
        go = ~done[doc]
        if not go.all():
            state, doc = state[go], doc[go]
            if perm is not None:
                perm = perm[go]
            elif j == 0:
                first = first[go]
    return best


def _lower(flat: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
    """flat[at] = min(flat[at], value), also where ``at`` repeats."""
    order = np.lexsort((value, at))
    at, value = at[order], value[order]
    head = np.flatnonzero(np.diff(at, prepend=-1))
    flat[at[head]] = np.minimum(flat[at[head]], value[head])


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and document; keys of different bands differ."""
    bits = signature.view(np.uint32).astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bits.shape[:2]).copy()
    for i in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return key.view(np.int64)


@lean
def _signed(batches: Iterator[pa.RecordBatch], shingle_words: int) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(shingle_words)
    for batch in batches:
        for part in slices([batch], "text", 1 << 20):
            sets = [shingler(t) for t in part.column("text").to_pylist()]
            full = [k for k, s in enumerate(sets) if len(s)]
            keys: list[list[int] | None] = [None] * len(sets)
            for group in _groups([len(sets[k]) for k in full], ELEMENTS):
                mine = [full[g] for g in group]
                for k, row in zip(mine, band_keys(signatures([sets[k] for k in mine])).tolist(), strict=True):
                    keys[k] = row
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "keys"])


def _groups(sizes: list[int], most: int) -> Iterator[range]:
    first = held = 0
    for k, n in enumerate(sizes):
        if held and held + n > most:
            yield range(first, k)
            first, held = k, 0
        held += n
    if held:
        yield range(first, len(sizes))


PARITY_NAMES = [f"p{k}" for k in range(PARITY // 64)]


def parity(elements: np.ndarray) -> np.ndarray:
    """Per place of the map, whether an odd number of elements hash there; 64 places a number."""
    odd = np.bincount((elements >> np.uint64(20)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


@lean
def _sets(batches: Iterator[pa.RecordBatch], shingle_words: int) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(shingle_words)
    for batch in batches:
        for part in slices([batch], "text", 1 << 20):
            sets = [shingler(t) for t in part.column("text").to_pylist()]
            maps = np.stack([parity(s) for s in sets]).T
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary()), *map(pa.array, maps)], names=["id", "elements", *PARITY_NAMES])


@lean
def _compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good, apart = [], []
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            same = int(np.count_nonzero(both[1:] == both[:-1]))
            total = len(x) + len(y) - same
            good.append(100 * same >= percent * total)
            apart.append(1 - same / total)
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(good, pa.bool_()), pa.array(apart, pa.float64())], names=["u", "v", "linked", "distance"])


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) with whether they are linked, and their Jaccard distance, by their whole sets."""
    left = pairs.join(sets.select(F.col("id").alias("u"), F.col("elements").alias("a")), "u")
    both = left.join(sets.select(F.col("id").alias("v"), F.col("elements").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(lambda x: _compared(x, percent), "u long, v long, linked boolean, distance double")


def near_duplicates(docs: DataFrame, scratch: Scratch, shingle_words: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of ``docs`` (doc_id, text).

    Words are lower-cased (A-Z) and parted by ASCII white space; a text with
    fewer words than a shingle has is one shingle, one without words none, and
    is linked with nothing. Rows with a null doc_id are linked with nothing, and
    kept; rows that share a doc_id are one document, whose links are those of
    all of them. Very long texts are compared whole; other columns are not read;
    an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.keep(docs.mapInArrow(lambda b: _signed(b, shingle_words), "doc_id long, n_shingles long, digest binary, keys array<long>"), "signed")
    linked = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # A class's least document, with its size and band keys.
    classes = linked.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "keys")).alias("c")).select("digest", F.col("c.doc_id").alias("id"), F.col("c.n_shingles").alias("n"), "c.keys")
    classes = scratch.keep(classes, "classes")
    placed = classes.select("id", "n", F.explode("keys").alias("key"))
    # Hubs are drawn afresh in every bucket, so that a large group has many.
    shared = placed.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "id").alias("by"), "id", "n")).alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    buckets = scratch.keep(placed.join(shared.select(F.col("key").alias("k"), "hub"), F.col("key") == F.col("k")).select("key", "id", "n", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), "buckets")
    close = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))
    pair = (F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v"))
    texts = docs.join(buckets.select("id").distinct(), F.col("doc_id") == F.col("id")).select("doc_id", "text")
    sets = scratch.keep(texts.mapInArrow(lambda b: _sets(b, shingle_words), "id long, elements binary, " + ", ".join(f"{p} long" for p in PARITY_NAMES)), "sets")
    known = scratch.keep(_compare(buckets.filter("id <> hub").select(*pair).distinct(), sets, percent), "known")
    links = known.filter("linked").select("u", "v")
    groups = scratch.keep(components(links, scratch, "first"), "groups")
    for k in range(ROUNDS):
        split = scratch.keep(_split(buckets, groups), f"split{k}")
        hubs = split.filter("component = top").groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "id", F.lit(k)).alias("by"), "id", "n")).alias("next")).select(F.col("key").alias("k"), "next")
        tried = split.filter("component <> top").join(hubs, F.col("key") == F.col("k")).filter(close(F.col("n"), F.col("next.n"))).select("id", "component", "top", F.col("next.id").alias("hub"))
        more = scratch.keep(_compare(tried.select(*pair).distinct(), sets, percent).filter("linked").select("u", "v"), f"tried{k}")
        links = links.union(more)
        # Components that found a hub take its component's name: not yet all that
        # is connected, which only means that more is compared below.
        hit = tried.join(more, (F.col("u") == F.least("id", "hub")) & (F.col("v") == F.greatest("id", "hub")), "left_semi")
        names = hit.groupBy(F.col("component").alias("old")).agg(F.min("top").alias("new"))
        now = split.select("id", "component").distinct().join(names, F.col("component") == F.col("old")).select(F.col("id").alias("node"), F.col("new").alias("component"))
        groups = scratch.keep(groups.join(now.select("node"), "node", "left_anti").unionByName(now), f"groups{k}")
    split = scratch.keep(_split(buckets, groups), "split")
    shared = scratch.keep(_shared(split, sets), "shared")
    maps = sets.select(F.col("id").alias("m"), *PARITY_NAMES)
    rest = scratch.keep(_apart(split, shared, known, maps, close, percent), "rest")
    more = scratch.keep(_compare(rest, sets, percent).filter("linked").select("u", "v"), "more")
    groups = scratch.keep(components(links.union(more), scratch, "last"), "closed")
    for name in ("known", "sets", "buckets"):
        scratch.drop(name)
    # From classes to documents; equal doc_ids are one document and share its component.
    least = classes.join(groups, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = signed.join(least.withColumnRenamed("digest", "same"), F.col("digest") == F.col("same"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _split(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of buckets with several components: each class's component, and the bucket's largest (top)."""
    now = buckets.join(groups, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id")).drop("node")
    sizes = now.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("members", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select(F.col("key").alias("k"), F.col("top.component").alias("top"))
    return now.join(largest, F.col("key") == F.col("k")).drop("k")


@lean
def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            found = [np.frombuffer(e.as_buffer(), np.int64) for e in part.column("elements")]
            ids = np.repeat(part.column("id").to_numpy(), [len(e) for e in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(found))], names=["id", "element"])


def _shared(split: DataFrame, sets: DataFrame) -> DataFrame:
    """Per class of split buckets: how many of its elements another of these classes has."""
    held = sets.join(split.select("id").distinct(), "id", "left_semi").mapInArrow(_elements, "id long, element long")
    common = held.groupBy("element").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("element").alias("e"))
    return held.join(common, F.col("element") == F.col("e"), "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("s"))


def _apart(split: DataFrame, shared: DataFrame, known: DataFrame, maps: DataFrame, close, percent: int) -> DataFrame:
    """Candidate pairs whose classes are in different components yet and may be near."""
    near = (F.col("u") == F.least("id", "hub")) & (F.col("v") == F.greatest("id", "hub"))
    split = split.join(known.select("u", "v", "distance"), near, "left").join(shared.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left")
    split = split.select("key", "id", "n", "component", "top", F.coalesce("s", F.lit(0)).alias("s"), F.when(F.col("id") == F.col("hub"), 0.0).otherwise(F.col("distance")).alias("d"))
    # A class that shares too little for even its own size is near none.
    split = split.filter((100 + percent) * F.col("s") >= percent * (F.col("n") + F.ceil(F.col("n") * percent / 100)))
    split = split.join(maps, F.col("id") == F.col("m")).drop("m")
    few = split.filter("component <> top").select(*(F.col(p).alias(f"a_{p}") for p in PARITY_NAMES), F.col("key").alias("k"), F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("component").alias("a_component"), F.col("s").alias("a_s"), F.col("d").alias("a_d"))
    may = close(F.col("n"), F.col("a_n")) & (F.abs(F.col("d") - F.col("a_d")) <= 1 - percent / 100 + 1e-9) & ((100 + percent) * F.least("s", "a_s") >= percent * (F.col("n") + F.col("a_n")))
    unlike = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"a_{p}"))) for p in PARITY_NAMES), F.lit(0))
    may = may & ((100 + percent) * unlike <= (100 - percent) * (F.col("n") + F.col("a_n")))
    pairs = split.join(few, (F.col("key") == F.col("k")) & (F.col("component") != F.col("a_component")) & may)
    pairs = pairs.select(F.least("id", "a").alias("u"), F.greatest("id", "a").alias("v")).distinct()
    return pairs.join(known, ["u", "v"], "left_anti")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents on sets of two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op1"), shingle_words=2)
