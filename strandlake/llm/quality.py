"""Quality rules as a short-circuit cascade.

The rules are conditions that reject a document. On a sample, each rule's cost
(seconds a row) and selectivity (share it rejects) are estimated; rules run in
descending order of rejection per cost, and a document that one rejects never
reaches the later ones. The order changes the work, not the verdict, which is
that no rule rejects.

SQL functions only, one pass over the rows, no shuffle: a CASE is evaluated
branch by branch, so a rejected row skips the branches after it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import WORD, table

WINDOW = 8
#: Documents, about, that the order of the rules is estimated on.
SAMPLE_ROWS = 1_000
SEED = 4
SYMBOLS = "#*$%&|<>"
SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def symbol_count(text: Column) -> Column:
    found = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(text.rlike("[" + SYMBOLS + "]"), found).otherwise(0).cast("long")


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_window_words(found: Column, window: int = WINDOW) -> Column:
    """Words that lie in a run of ``window`` words found twice or more.

    Runs are known by a 64-bit hash. Where all differ, which a set tells, the
    answer is 0; else the runs are sorted, those equal to a neighbour are
    marked, and the union of the marked runs is measured.
    """
    each = F.transform(found, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window)))

    def covered(r: Column) -> Column:
        placed = F.sort_array(F.transform(r, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            equal = lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
            return F.array_sort(F.transform(F.filter(s, lambda x, j: F.coalesce(equal(x, j), F.lit(False))), lambda x: x["i"]))

        def union(at: Column) -> Column:
            gaps = F.transform(at, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - x, F.lit(window))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

        return let(placed, lambda s: let(marked(s), union))

    def counted(h: Column) -> Column:
        return let(runs(h), lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0).cast("long")).otherwise(covered(r)))

    return F.when(F.size(found) <= window, F.lit(0).cast("long")).otherwise(let(each, counted))


#: The counts of a document, from ``text`` and its words ``__w``.
COUNTS: dict[str, Callable[[], Column]] = {
    "n_words": lambda: F.size("__w").cast("long"),
    "word_chars": lambda: F.length(F.array_join("__w", "")).cast("long"),
    "n_symbols": lambda: F.coalesce(symbol_count(F.col("text")), F.lit(0).cast("long")),
    "n_dup_lines": lambda: repeated_lines(F.col("text")),
    "n_repeat_words": lambda: repeated_window_words(F.col("__w")),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a document where ``rejects`` holds; ``needs`` are the counts it reads."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[], Column]


def _stop_words() -> Column:
    """Frequent function words of the corpus' languages."""
    listed = ["the", "and", "of", "to", "in", "is", "that", "for", "le", "la", "de", "et", "les", "des", "que", "der", "die", "das", "und", "den", "ein", "el", "los", "en", "un", "es", "una", "con"]
    return F.array(*map(F.lit, listed))


RULES = (
    Rule("too_short", ("n_words",), lambda: F.col("n_words") < 20),
    Rule("repeats_itself", ("n_repeat_words", "n_words"), lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    Rule("odd_word_length", ("word_chars", "n_words"), lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words"))),
    Rule("symbols", ("n_symbols", "n_words"), lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("repeated_lines", ("n_dup_lines", "n_words"), lambda: 3 * F.col("n_dup_lines") > F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(WORD)))),
    Rule("shouting", ("word_chars",), lambda: 2 * F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) > F.col("word_chars")),
    Rule("stutters", ("n_words",), lambda: 10 * F.size(F.filter("__w", lambda x, i: x == F.get("__w", i - 1))) > 3 * F.col("n_words")),
    Rule("no_function_words", ("n_words",), lambda: (F.col("n_words") >= 60) & ~F.arrays_overlap(F.transform(F.col("__w"), lambda x: F.lower(x)), _stop_words())),
)
BASE = ("too_short", "repeats_itself")


def with_counts(docs: DataFrame, counts: tuple[str, ...] = tuple(COUNTS)) -> DataFrame:
    docs = docs.withColumn("__w", words(F.col("text")))
    return docs.withColumns({c: COUNTS[c]() for c in counts})


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejection per cost, as estimated on about ``sample_rows`` documents.

    The sample is drawn from all rows by a hash of the row, so that reruns draw the same. Cost is the time to run the rule, with the
    counts it needs, over the sample, the better of two runs, as the first also
    compiles code; a rule that rejects nothing there goes last, cheapest first.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64(F.lit(SEED), *docs.columns), F.lit(1 << 31)) < int(share * (1 << 31))
    sample = docs.filter(drawn).select("text").persist()
    n = max(1, sample.count())
    ranks = []
    for k, rule in enumerate(rules):
        rejected = with_counts(sample, rule.needs).select(F.count_if(rule.rejects()).alias("n"))
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            share = rejected.first()["n"] / n
            runs.append(time.perf_counter() - began)
        cost = max(min(runs), 1e-6) / n
        ranks.append((-share / cost, cost, k))
    sample.unpersist()
    return [rules[k] for *_, k in sorted(ranks)]


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects; the first that does ends the evaluation."""
    kept = None
    for rule in rules:
        kept = F.when(rule.rejects(), False) if kept is None else kept.when(rule.rejects(), False)
    return kept.otherwise(True)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the counts, base_failed and kept.

    A null text has no words, so that it fails the base rules; repeated rows are
    judged each; very long texts are judged whole; columns with the names of the
    counts and verdicts are replaced; an empty table gives no rows.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    others = [r for r in order_rules(docs, rules, sample_rows) if r.name not in BASE]
    base = {r.name: r for r in rules}
    failed = base["too_short"].rejects() | base["repeats_itself"].rejects()
    kept = verdict(others)
    return with_counts(docs).withColumn("base_failed", failed).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.coalesce(kept, F.lit(False)))).drop("__w")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept per document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    row_number() OVER () AS r
  FROM documents),
runs AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, run) AS times
  FROM (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS run FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8))),
covered AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM runs WHERE times > 1) GROUP BY r),
c AS (
  SELECT doc_id, text, w, lines, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words OR 3 * n_dup_lines > len(lines)
    OR 2 * length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > word_chars
    OR 10 * len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) > 3 * n_words
    OR n_words >= 60 AND NOT list_has_any(list_transform(w, lambda x: lower(x)), ['the', 'and', 'of', 'to', 'in', 'is', 'that', 'for', 'le', 'la', 'de', 'et', 'les', 'des', 'que', 'der', 'die', 'das', 'und', 'den', 'ein', 'el', 'los', 'en', 'un', 'es', 'una', 'con'])) AS kept
FROM b
"""
