"""Toxicity classifier, regularised by counterfactual identity swaps.

A text's features are its distinct lower-case words (runs of letters, in any
script), hashed to ``DIMS`` weights of a logistic regression. Only places whose
words go with the label beyond chance (a chi-square test) get a weight, and
copies of a training text share the weight of one: both keep it from learning
single texts by heart. For every labelled
training text that names an identity group, a counterfactual is made by swapping
the identity terms for another group's of the same language; training penalises
the squared change of the score, so that a mention of a group by itself moves
the score little, which is what makes neutral mentions false positives.

Training runs on the driver on at most ``TRAIN_ROWS`` labelled rows, drawn by a
hash of doc_id; only hashed words of those reach it. Scoring is one pass over
all texts with the weights, whose size is fixed.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import lean, small_batches, table
from strandlake.llm.tokens import slices

DIMS = 1 << 18
#: Bound on the labelled rows that the model is fitted on.
TRAIN_ROWS = 12_000
EPOCHS = 400
L2 = 5e-5
#: Least chi-square of a word with the label for it to get a weight.
CHI_SQUARE = 20.0
SWAP_PENALTY = 4.0
THRESHOLD = 0.5
SEED = 8

#: Identity terms by language; terms at the same place of a
#: language's lists are each other's counterfactuals.
IDENTITY_TERMS = {
    "en": ["women", "men", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees", "gay", "lesbian", "straight", "transgender", "black", "white", "asian", "latino", "african", "european", "disabled", "elderly", "woman", "man", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "immigrant", "refugee"],
    "fr": ["femmes", "hommes", "musulmans", "chrétiens", "juifs", "athées", "immigrés", "réfugiés", "homosexuels", "noirs", "blancs", "asiatiques", "africains", "handicapés"],
    "de": ["frauen", "männer", "muslime", "christen", "juden", "atheisten", "einwanderer", "flüchtlinge", "schwule", "schwarze", "weiße", "asiaten", "afrikaner", "behinderte"],
    "es": ["mujeres", "hombres", "musulmanes", "cristianos", "judíos", "ateos", "inmigrantes", "refugiados", "homosexuales", "negros", "blancos", "asiáticos", "africanos", "discapacitados"],
}

_WORD = re.compile(r"[^\W\d_]+")


def swaps() -> dict[str, str]:
    """Each term's counterfactual: the next of its language, the last's the first."""
    return {t: terms[(k + 1) % len(terms)] for terms in IDENTITY_TERMS.values() for k, t in enumerate(terms)}


def text_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def place(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % DIMS


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, DIMS
    bias: float

    def score(self, text: str | None) -> float:
        at = {place(w) for w in text_words(text)}
        return float(sigmoid(self.bias + sum(float(self.weights[k]) for k in sorted(at))))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def features(text: str | None) -> tuple[list[int], list[int]]:
    """Places of a text's words, and of its counterfactual's (empty: it names no group)."""
    words, pairs = text_words(text), swaps()
    own = sorted({place(w) for w in words})
    if words.isdisjoint(pairs):
        return own, []
    return own, sorted({place(pairs.get(w, w)) for w in words})


def shares(rows: list[list[int]]) -> np.ndarray:
    """Weight of each training text: 1 over the number of texts like it, which
    have its two lowest hashed words in common."""
    mixed = np.random.default_rng(SEED).permutation(DIMS)
    keys = [tuple(np.sort(mixed[r])[:2].tolist()) for r in rows]
    count: dict[tuple, int] = {}
    for k in keys:
        count[k] = count.get(k, 0) + 1
    return np.array([1 / count[k] for k in keys])


def telling(own: list[list[int]], y: np.ndarray, share: np.ndarray, least: float = CHI_SQUARE) -> np.ndarray:
    """For each place, whether it goes with the label: chi-square of the 2x2 table."""
    x = _Rows(own)
    n, pos = share.sum(), (share * y).sum()
    seen, hit = x.back(share, DIMS), x.back(share * y, DIMS)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (hit * n - seen * pos) ** 2 / (seen * (n - seen) * pos * (n - pos))
    return np.nan_to_num(chi, posinf=0) >= least


class _Rows:
    """Sparse 0/1 rows for products with a weight vector."""

    def __init__(self, rows: list[list[int]]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.fromiter((c for r in rows for c in r), np.int64, len(self.row))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray, dims: int) -> np.ndarray:
        return np.bincount(self.col, g[self.row], dims)


def fit(own: list[list[int]], swapped: list[list[int]], labels: np.ndarray, epochs: int = EPOCHS, l2: float = L2, swap_penalty: float = SWAP_PENALTY) -> Model:
    """Full-batch Adam on mean log loss + l2 |w|^2 + swap_penalty mean (score - swapped score)^2.

    Without labelled rows the model scores 0 words as 0.5 less a little: all 0.
    """
    if not len(labels):
        return Model(np.zeros(DIMS, np.float32), -1.0)
    share = shares(own)
    keep = telling(own, labels.astype(np.float64), share)
    own, swapped = ([[c for c in r if keep[c]] for r in rows] for rows in (own, [s if s != o else [] for o, s in zip(own, swapped, strict=True)]))
    used, flat = np.unique(np.fromiter((c for r in (*own, *swapped) for c in r), np.int64), return_inverse=True)
    sizes = [len(r) for r in (*own, *swapped)]
    parts = [p.tolist() for p in np.split(flat, np.cumsum(sizes)[:-1])] if sizes else []
    x = _Rows(parts[: len(own)])
    pairs = [k for k, r in enumerate(swapped) if r]
    a, b = _Rows([parts[k] for k in pairs]), _Rows([parts[len(own) + k] for k in pairs])
    y, dims = labels.astype(np.float64), len(used)
    w, m, v = np.zeros(dims + 1), np.zeros(dims + 1), np.zeros(dims + 1)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(rate / (1 - rate))
    for t in range(1, epochs + 1):
        g = np.zeros(dims + 1)
        d = share * (sigmoid(x.dot(w[:-1]) + w[-1]) - y) / share.sum()
        g[:-1], g[-1] = x.back(d, dims) + 2 * l2 * w[:-1], d.sum()
        if pairs:
            pa_, pb = sigmoid(a.dot(w[:-1]) + w[-1]), sigmoid(b.dot(w[:-1]) + w[-1])
            gap = 2 * swap_penalty * (pa_ - pb) / len(pairs)
            da, db = gap * pa_ * (1 - pa_), -gap * pb * (1 - pb)
            g[:-1] += a.back(da, dims) + b.back(db, dims)
            g[-1] += da.sum() + db.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (1 - t / (epochs + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(DIMS, np.float32)
    weights[used] = w[:-1]
    return Model(weights, float(w[-1]))


def held_out(doc_id):
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fits on labelled rows that are not held out: those first by a hash of doc_id, ``train_rows`` at most.

    Labels that are null or of unknown documents are passed over; of documents
    that share a doc_id the least text counts. Without rows the model scores all 0.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out("doc_id"))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    @lean
    def run(batches):
        for batch in batches:
            for part in slices([batch], "text"):
                found = [features(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array([o for o, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.int32()))], names=["doc_id", "toxic", "own", "swapped"])

    # One text of a doc_id, the least, so that no more rows come than were chosen.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = rows.mapInArrow(run, "doc_id long, toxic int, own array<int>, swapped array<int>").toArrow().sort_by("doc_id")
    return fit(got["own"].to_pylist(), got["swapped"].to_pylist(), got["toxic"].to_numpy())


def score(docs: DataFrame, model: Model, name: str = "score", verdict: str = "predicted") -> DataFrame:
    """The documents with the score (double, 0 to 1) and the verdict (int) under the given
    names, in place of columns so named; all other columns as they are."""
    weights, bias = model.weights, model.bias
    small_batches(docs.sparkSession)
    docs = docs.drop(name, verdict).withColumn("text", F.col("text").cast("string"))

    @lean
    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            for part in slices([batch], "text"):
                out = np.empty(part.num_rows)
                for k, text in enumerate(part.column("text").to_pylist()):
                    at = set()
                    for w in text_words(text):
                        p = known.get(w)
                        if p is None:
                            p = place(w)
                            if len(known) < 300_000:
                                known[w] = p
                        at.add(p)
                    out[k] = bias + weights[np.array(sorted(at), np.int64)].astype(np.float64).sum()
                yield part.append_column(name, pa.array(sigmoid(out)))

    schema = docs.select("*").schema
    scored = docs.mapInArrow(run, schema.add(name, "double"))
    return scored.withColumn(verdict, (F.col(name) >= THRESHOLD).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted per document.

    A null or empty text has no words and is scored by the bias alone; very long
    texts are scored whole; a null doc_id is not held out; repeated rows are scored
    each; other columns are not read; an empty table gives no rows, and without
    labels nothing is predicted toxic.
    """
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")
