"""Which of several filters removes what, in every order: an audit of their interaction.

Five conditions reject a document; a document's failures are a mask of five bits.
What any order of the filters keeps, removes and finds already removed follows
from how many documents have each mask, so one pass over the texts serves all 120
orders.

Four bits come from the text alone. The fifth, being a copy of a document with a
smaller doc_id, comes from a router of full texts: an RDD dealt by xxhash64 of the
text. A map task first meets its own copies, in chunks of ``CHUNK_BYTES``: all but
the least id of a chunk are decided there, so that a text that a third of the table
repeats reaches its partition once per chunk, not once per row. A partition is
sorted by (hash, id) and read as a stream; per hash a collision chain holds the
distinct full texts seen and the least id of each, which is the first to arrive,
and every later id is emitted as a copy. Masks then meet the labels by doc_id, and
``combineByKey`` adds them up to one vector of counts per part of the table, adding
within each task before the shuffle.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import xxhash
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import table

FILTERS = "ABCDE"
#: Bit of a mask that says that a document is a copy.
COPY = 16
#: Text that a map task holds at a time while it looks for its own copies.
CHUNK_BYTES = 16 << 20

_MARKS = re.compile(r"[#$%&*|]")
_UPPER = bytes(range(ord("A"), ord("Z") + 1))


def failures(text: str) -> int:
    """Bits A to D of a text: short, few distinct words, many capitals, marks."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    capitals = len(data) - len(data.translate(None, _UPPER))
    return (len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words)) + 4 * (100 * capitals > 10 * len(text)) + 8 * bool(_MARKS.search(text))


def fingerprint(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


#: ((where to go, id), (full text or None where decided, doc_id, mask, rows per part))
Routed = tuple[tuple[int, int], tuple[str | None, int | None, int, dict[str, int]]]


def sent(rows: Iterable, most_bytes: int = CHUNK_BYTES) -> Iterator[Routed]:
    """What a task sends on of its rows (doc_id, part, text): each text's least id with the
    full text, once per chunk, and all other rows with their whole mask and no text, dealt evenly."""
    chunk: dict[str, list] = {}
    held, dealt = 0, itertools.count()

    def decided(doc_id: int | None, mask: int, parts: dict[str, int]) -> Routed:
        return (xxhash.xxh64_intdigest(str(next(dealt))), 0), (None, doc_id, mask, parts)

    def flushed() -> Iterator[Routed]:
        for text, (doc_id, mask, parts) in chunk.items():
            yield (fingerprint(text), doc_id), (text, doc_id, mask, parts)

    for doc_id, part, text in rows:
        text = text or ""
        if doc_id is None:
            yield decided(None, failures(text), {part: 1})
            continue
        known = chunk.get(text)
        if known is None:
            chunk[text] = [doc_id, failures(text), {part: 1}]
            held += len(text) + 200
            if held > most_bytes:
                yield from flushed()
                chunk, held = {}, 0
        elif doc_id > known[0]:
            yield decided(doc_id, known[1] | COPY, {part: 1})
        elif doc_id == known[0]:
            known[2][part] = known[2].get(part, 0) + 1
        else:
            yield decided(known[0], known[1] | COPY, known[2])
            known[0], known[2] = doc_id, {part: 1}
    yield from flushed()


def received(rows: Iterable[Routed]) -> Iterator[tuple[int | None, str, int, int]]:
    """(doc_id, part, mask, rows) of a partition's rows, which come sorted by (hash, id)."""
    at, chain = None, []
    for (key, _), (text, doc_id, mask, parts) in rows:
        if text is not None:
            if key != at:
                at, chain = key, []
            least = next((i for t, i in chain if t == text), None)
            if least is None:
                chain.append((text, doc_id))
            elif least < doc_id:
                mask |= COPY
        for part, n in parts.items():
            yield doc_id, part, mask, n


def _part() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def masks(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, part, mask, n (rows like it) of documents (doc_id, lang, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _part().alias("part"), F.col("text").cast("string").alias("text"))
    routed: RDD = rows.rdd.mapPartitions(sent)
    if partitions is None:  # as many as Spark's own shuffles have, and more where the scan has more
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * routed.getNumPartitions())
    sorted_ = routed.repartitionAndSortWithinPartitions(partitions, partitionFunc=lambda key: key[0])
    return docs.sparkSession.createDataFrame(sorted_.mapPartitions(received), "doc_id long, part string, mask int, n long", verifySchema=False)


#: A vector of counts: documents, of quality 1, and toxic ones, by mask.
WIDTH = 3 * 32


def _add(counts: list[int], row: tuple[int, int, int, int]) -> list[int]:
    mask, n, good, toxic = row
    counts[mask] += n
    counts[32 + mask] += n * good
    counts[64 + mask] += n * toxic
    return counts


def count_vectors(found: DataFrame, labels: DataFrame) -> RDD:
    """(part, counts) of masks (doc_id, part, mask, n). Of several labels of one doc_id the greatest counts; without one it is neither good nor toxic."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    known = known.filter("id IS NOT NULL").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    both = found.join(known, F.col("doc_id") == F.col("id"), "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    rows = both.rdd.map(lambda r: (r[0], (r[1], r[2], r[3], r[4])))
    return rows.combineByKey(lambda r: _add([0] * WIDTH, r), _add, lambda a, b: [x + y for x, y in zip(a, b, strict=True)])


def report(part: str, counts: list[int]) -> Iterator[tuple]:
    """All orders and steps of one part, from its counts by mask."""
    n, good, toxic = counts[:32], counts[32:64], counts[64:]
    bits = {f: 1 << k for k, f in enumerate(FILTERS)}
    over = lambda which, test: sum(which[m] for m in range(32) if test(m))
    # Of a mask's failing filters each is met first in as many orders as the others.
    orders = 120
    shapley = {f: sum(n[m] * orders // m.bit_count() for m in range(32) if m & b) for f, b in bits.items()}
    alone = {f: n[b] for f, b in bits.items()}
    for order in map("".join, itertools.permutations(FILTERS)):
        before = 0
        for step, f in enumerate(order, 1):
            b = bits[f]
            first = lambda m, b=b, before=before: bool(m & b) and not m & before
            yield (part, order, step, over(n, lambda m: not m & (before | b)), over(n, first), over(n, lambda m: bool(m & b and m & before)),
                   alone[f], over(good, first), over(toxic, first), shapley[f])
            before |= b


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interactions(docs: DataFrame, labels: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per part (lang; null: empty string), order of the five filters, and step.

    A null text is empty. A row with a null doc_id is no copy and makes none; rows
    that share doc_id and text are no copies of each other; repeated rows count
    each. Very long texts are judged and compared whole; other columns are not read;
    an empty table gives no rows. Labels of unknown documents are passed over.
    """
    made = count_vectors(masks(docs, partitions), labels).flatMap(lambda x: report(*x))
    # The parts are those of the table; the join also shows in the plan what the RDD was made from.
    parts = docs.select(_part().alias("part")).distinct()
    return parts.join(docs.sparkSession.createDataFrame(made, REPORT, verifySchema=False), "part")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part by part, what five filters of all documents remove in each of their 120 orders."""
    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e
  FROM documents),
m AS (
  SELECT part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) AS c,
    regexp_matches(x, '[#$%&*|]') AS d, e, coalesce(q, false) AS good, coalesce(t, false) AS toxic
  FROM d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS q, bool_or(toxic = 1) AS t FROM labels GROUP BY doc_id) USING (doc_id)),
v AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT concat(p.f, q.f, r.f, s.f, t.f) AS filter_order FROM f p, f q, f r, f s, f t WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
s AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS f, filter_order[1 : step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
j AS (SELECT *, contains(fails, f) AS here, translate(fails, before, '') <> fails AS earlier FROM s, v)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (here AND NOT earlier), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (here AND earlier), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = f), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (here AND NOT earlier), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (here AND NOT earlier), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // greatest(length(fails), 1)) FILTER (here), 0) AS BIGINT) AS shapley
FROM j GROUP BY part, filter_order, step
"""
