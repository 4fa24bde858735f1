"""Repair of the turn structure of conversations by weighted finite-state composition.

Three machines are composed: an acceptor of a conversation's turns, a transducer of
edits (keep, rerole, delete, insert) and an acceptor of the role grammar, an optional
system turn and then pairs of user and assistant turns. The composition is made
lazily: a turn's symbol is composed with the grammar when the symbol is first met,
and a step with what may follow it when the two first meet. A state of the
composition is a place among the turns and a state of the grammar; the shortest path
is found in reverse topological order of the places. Weights are (cost, label
string), compared in that order. Arcs that leave a state have different labels, so
that two strings are told apart by their first letters and need not be written down
before the path is.

Spark deals conversations by conv_id and sorts their turns. The path needs a few
bytes per turn: what it reads are digests. Texts travel once, after the conversation's
path, and are hashed as they stream by; a task holds one batch of them and one byte
per turn of one conversation. The repaired hash is one running hash over a
conversation, so its texts pass through one task, however many they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import small_batches, table

KEEP, REROLE, DELETE, INSERT = "KRDI"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: Added to the cost of an edit that leaves a truncated turn in place.
TRUNCATED_COST = 1
#: The role grammar: per state, the state that a role's initial leads to. 0 is the start.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: Roles that an edit can give.
GIVEN = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
FAR = 1 << 40

#: A symbol is 3 * initial + state of the turn.
INITIALS = "sua-"
SOUND, CUT, MUST_GO = range(3)

Arc = tuple[int, str, int]


@lru_cache(maxsize=64)
def arcs(symbol: int) -> tuple[tuple[Arc, ...], ...]:
    """Edits of a turn composed with the grammar: per state the arcs (cost, label, next state)."""
    initial, kind = INITIALS[symbol // 3], symbol % 3
    more = TRUNCATED_COST if kind == CUT else 0
    out = []
    for state, step in enumerate(GRAMMAR):
        found = [(COSTS[DELETE], DELETE, state)]
        if kind != MUST_GO:
            if initial in step:
                found.append((COSTS[KEEP] + more, KEEP, step[initial]))
            found += [(COSTS[REROLE] + more, REROLE, step[x]) for x in GIVEN if x in step]
        out.append(tuple(found))
    return tuple(out)


def _inserted(best: list[tuple]) -> list[tuple]:
    """The best way on from each state where turns may also be inserted first. Inserting costs, so
    that no cycle of inserts is worth while: as many rounds as there are states will do."""
    for _ in GRAMMAR:
        best = [min([best[g], *((COSTS[INSERT] + best[step[x]][0], INSERT, step[x]) for x in GIVEN if x in step)]) for g, step in enumerate(GRAMMAR)]
    return best


END = tuple(_inserted([(0, "", g) if g in FINAL else (FAR, "", g) for g in range(len(GRAMMAR))]))


@lru_cache(maxsize=4096)
def before(symbol: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int, tuple]:
    """Costs from each state ahead of a turn, given those after it, less their least, which comes
    second; and the arc that each state takes."""
    best = _inserted([min((cost + after[to], label, to) for cost, label, to in ways) for ways in arcs(symbol)])
    least = min(b[0] for b in best)
    return tuple(b[0] - least for b in best), least, tuple((label, to) for _, label, to in best)


def shortest(symbols: bytes) -> tuple[int, str]:
    """Cost and labels of the cheapest edits of a conversation; of equally cheap ones those whose labels sort first."""
    costs, total, chosen = tuple(b[0] for b in END), 0, [tuple(b[1:] for b in END)]
    for symbol in reversed(symbols):
        costs, least, ways = before(symbol, costs)
        total += least
        chosen.append(ways)
    labels, state, cost = [], 0, total + costs[0]
    while chosen:
        label, state = chosen[-1][state]
        labels.append(label)
        if label != INSERT:
            chosen.pop()
    return cost, "".join(labels)


def _initial(role: Column) -> Column:
    return F.when(F.left(role, F.lit(1)).isin("s", "u", "a"), F.left(role, F.lit(1))).otherwise("-")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of turns after the damage that the crc32 of ``conv_id:turn`` deals out."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.encode(F.concat(plain("conv_id"), F.lit(":"), plain("turn")), "UTF-8")) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), plain("role").alias("role"), plain("text").alias("text"), code.alias("code")).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("code") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _facts(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, symbol (that of the first copy), copies, fresh (whether the first copy is new to the conversation)."""
    kind = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), MUST_GO).when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z"), SOUND).otherwise(CUT)
    symbol = 3 * (F.instr(F.lit(INITIALS), _initial(F.col("role"))) - 1) + kind
    small = rows.select("conv_id", "turn", "role", _digest().alias("digest"), symbol.cast("int").alias("symbol"), "copies")
    small = small.groupBy("conv_id", "turn", "role", "digest", "symbol").agg(F.sum("copies").alias("copies"))
    at = F.struct(F.col("turn").isNotNull(), "turn")
    first = small.groupBy("digest").agg(F.min(at).alias("first")).withColumnRenamed("digest", "d")
    return small.join(first, F.col("digest") == F.col("d")).select("conv_id", "turn", "role", "digest", "symbol", "copies", (F.col("first") == at).alias("fresh"))


def _digest() -> Column:
    """Of a conversation's turns, equal where role and text are."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role").cast("string"), "role", "text"))


#: What is known of a conversation before its texts are read.
AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Turns:
    """Symbols and counts of one conversation, turn by turn."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.symbols, self.last = conv_id, bytearray(), ""
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.least = self.most = None

    def add(self, turn: int | None, symbol: int, copies: int, fresh: bool) -> None:
        initial, kind = INITIALS[symbol // 3], symbol % 3
        gone = symbol - kind + MUST_GO
        self.symbols += bytes([symbol if fresh else gone]) + bytes([gone]) * (copies - 1)
        if kind == MUST_GO:
            self.blank += copies
        else:
            self.duplicate += copies - fresh
            self.truncated += kind == CUT and fresh
        self.illegal += (bool(self.last) and self.last + initial not in LEGAL) + (copies - 1) * (initial * 2 not in LEGAL)
        self.last = initial
        if turn is not None and turn != self.most:
            self.n_turns += 1
            self.least, self.most = turn if self.least is None else self.least, turn

    def row(self) -> tuple:
        gaps = self.most - self.least + 1 - self.n_turns if self.n_turns else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *shortest(bytes(self.symbols)))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


#: Rows and characters of audits that a batch of results holds at most.
BATCH_ROWS, BATCH_CHARS = 2048, 1 << 22


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """AUDIT rows of a partition's turns, which come sorted by conversation."""
    now, rows, held = None, [], 0
    for batch in batches:
        for conv_id, turn, symbol, copies, fresh in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "symbol", "copies", "fresh")), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    rows.append(now.row())
                    held += len(now.symbols)
                    if len(rows) >= BATCH_ROWS or held >= BATCH_CHARS:
                        yield _batch(rows, AUDIT)
                        rows, held = [], 0
                now = _Turns(conv_id)
            if copies:
                now.add(turn, symbol, copies, fresh)
    yield _batch(rows + ([now.row()] if now is not None else []), AUDIT)


RESULT = AUDIT + ", repaired_sha256 string"


def given_role(place: int, length: int) -> str:
    """The role that the grammar asks for at a place (from 0) of a repaired conversation, system apart."""
    return GIVEN["ua"[(place - length % 2) % 2]]


class _Repaired:
    """The running hash of one repaired conversation, as its turns stream by."""

    def __init__(self, known: tuple):
        self.known, self.hash = known, hashlib.sha256()
        self.labels, self.at, self.made = known[-1], 0, 0
        self.length = len(self.labels) - self.labels.count(DELETE)

    def write(self, role: str | None, text: str) -> None:
        line = f"{role or given_role(self.made, self.length)}:{text}"
        self.hash.update((("\n" if self.made else "") + line).encode("utf-8", "replace"))
        self.made += 1

    def insert(self) -> None:
        while self.labels[self.at : self.at + 1] == INSERT:
            self.write(None, "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.insert()
        label = self.labels[self.at]
        self.at += 1
        if label != DELETE:
            self.write(role if label == KEEP else None, text)

    def row(self) -> tuple:
        self.insert()
        return (*self.known, self.hash.hexdigest())


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RESULT rows of a partition's conversations, each's audit and then its turns in order."""
    now, rows, held = None, [], 0
    names = [f.split()[0] for f in AUDIT.split(", ")]
    for batch in batches:
        for conv_id, copies, role, text, *known in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "copies", "role", "text", *names[1:])), strict=True):
            if copies == 0:
                if now is not None:
                    rows.append(now.row())
                    held += len(now.labels)
                    if len(rows) >= BATCH_ROWS or held >= BATCH_CHARS:
                        yield _batch(rows, RESULT)
                        rows, held = [], 0
                now = _Repaired((conv_id, *known))
            for _ in range(copies):
                now.turn(role, text)
    yield _batch(rows + ([now.row()] if now is not None else []), RESULT)


def audits(turns: DataFrame) -> DataFrame:
    """AUDIT per conv_id of ``turns`` (conv_id, turn, role, text)."""
    small_batches(turns.sparkSession)
    facts = _facts(damaged(turns))
    # Conversations that lose all their turns count, too.
    all_ids = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("copies", F.lit(0).cast("long"))
    rows = facts.unionByName(all_ids, allowMissingColumns=True).repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", F.col("copies") > 0, F.col("turn").asc_nulls_first(), "role", "digest")
    return rows.select("conv_id", "turn", "symbol", "copies", "fresh").mapInArrow(_audited, AUDIT)


def repair(turns: DataFrame) -> DataFrame:
    """RESULT per conv_id of ``turns`` (conv_id, turn, role, text): faults, cheapest edits, hash of the repaired turns.

    Turns are taken by turn (null first), and those of one turn by role and then by a
    digest of the text, so that equal ones are neighbours. A null is one space in a
    role, in a text and in the key of the damage; turns with a null conv_id are one
    conversation. Roles other than system, user and assistant go by their initials;
    without one of s, u, a they can't be kept. Repeated rows are duplicates. Very long
    texts are hashed whole; other columns are not read; an empty table gives no rows.
    """
    known = audits(turns).withColumn("copies", F.lit(0).cast("long"))
    texts = damaged(turns).withColumn("digest", _digest())
    rows = texts.unionByName(known, allowMissingColumns=True).repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", F.col("copies") > 0, F.col("turn").asc_nulls_first(), "role", "digest")
    names = [f.split()[0] for f in AUDIT.split(", ")]
    return rows.select("copies", "role", "text", *names).mapInArrow(_hashed, RESULT)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired hash of every conversation."""
    return repair(table(spark, sf_dir, "conversations"))


def _arc(cost: str, label: str, after: str) -> str:
    """A weight in SQL: nine digits of cost, then the labels; so weights compare as strings."""
    return f"printf('%09d', {cost} + CAST(left({after}, 9) AS INT)) || '{label}' || substr({after}, 10)"


def _ways(state: int, keeps: dict[str, int], rerole: int) -> str:
    kept = " ".join(f"WHEN ini = '{x}' THEN {_arc('t', 'K', f'w{to}')}" for x, to in keeps.items())
    return f"least({_arc('3', 'D', f'w{state}')}, CASE WHEN NOT gone THEN {_arc('2 + t', 'R', f'w{rerole}')} END, CASE WHEN gone THEN NULL {kept} END)"


ORACLE_SQL = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS x, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
code AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(range(0, 8 * length(k)), lambda i: CASE WHEN i % 8 = 0 THEN CAST(ascii(substr(k, CAST(i // 8 + 1 AS INT), 1)) AS BIGINT) ELSE 0 END)),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 20 AS m FROM src),
dam AS (
  SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN translate(x, '.!?', '') ELSE x END AS x,
    unnest(range(CASE m WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM code),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest, copy) AS i, row_number() OVER (PARTITION BY conv_id, digest ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS ini
  FROM (SELECT *, md5(concat_ws(':', coalesce(CAST(conv_id AS VARCHAR), ' '), length(role), role, x)) AS digest FROM dam)),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(x, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(x, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prev, count(*) OVER (PARTITION BY conv_id) AS n FROM o),
g AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS t FROM f),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
back(conv_id, i, w0, w1, w2, w3) AS (
  SELECT conv_id, i + 1, '000000000', '000000004II', '000000002I', '000000000' FROM g WHERE i = n
  UNION ALL
  SELECT conv_id, i, least(k0, {_arc('2', 'I', 'v2')}), least(k1, {_arc('2', 'I', 'v2')}), v2, v3
  FROM (SELECT *, least(k2, {_arc('2', 'I', 'k3')}) AS v2, least(k3, {_arc('2', 'I', 'k2')}) AS v3
    FROM (SELECT g.conv_id, g.i, {_ways(0, dict(s=1, u=2), 2)} AS k0, {_ways(1, dict(u=2), 2)} AS k1, {_ways(2, dict(a=3), 3)} AS k2, {_ways(3, dict(u=2), 2)} AS k3
      FROM back JOIN g ON g.conv_id IS NOT DISTINCT FROM back.conv_id AND g.i = back.i - 1))),
a AS (SELECT conv_id, CAST(left(w0, 9) AS BIGINT) AS cost, substr(w0, 10) AS audit FROM back WHERE i = 1),
l AS (SELECT conv_id, length(translate(audit, 'D', '')) AS m, unnest(string_split(audit, '')) AS e, unnest(range(1, length(audit) + 1)) AS p FROM a WHERE audit <> ''),
r AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS j FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
h AS (
  SELECT r.conv_id, sha256(string_agg(concat(CASE WHEN e = 'K' THEN g.role WHEN (j + m) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', CASE WHEN e = 'I' THEN '' ELSE x END), chr(10) ORDER BY j)) AS sha
  FROM r LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i WHERE e <> 'D' GROUP BY r.conv_id)
SELECT s.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM src) s LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM s.conv_id
"""
