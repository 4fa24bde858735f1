"""Operators on documents against brute force, and on hard cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.llm import chat, fingerprint, graph, minhash, mixing, quality, suffix
from strandlake.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keys string, flags string, uid string"
HARD = [None, "", " \t\n", "a", "word", "é 中文 \U0001f600 İ", "x " * 3000, "Same text here and there " * 9, "Same text here and there " * 9]


def documents(spark, texts, ids=None):
    rows = [(k if ids is None else ids[k], t, "en", None if k % 4 == 0 else f"s{k % 3}", None if t is None else len(t), "k", "f", "u") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(rng, text, k):
    w = text.split()
    for i in rng.sample(range(len(w)), min(k, len(w))):
        w[i] = "zz" + str(rng.randrange(99))
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(10, 120)) for _ in range(40)]
    for k in range(60):
        texts.append(edited(rng, texts[rng.randrange(len(texts))], rng.choice([0, 0, 1, 2, 4, 9])))
    return texts + HARD


def plain_groups(texts, ids, k, percent=80):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets, uf = [shingles(t) for t in texts], graph.UnionFind()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                uf.union(ids[i], ids[j])
    return [uf.find(i) for i in ids], sets


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, corpus, k):
    ids = [(7 * i) % len(corpus) for i in range(len(corpus))]
    want, sets = plain_groups(corpus, ids, k)
    found = {r.doc_id: r for r in minhash.near_duplicates(documents(spark, corpus, ids), Scratch(spark, "t"), k).collect()}
    assert [found[i].component_id for i in ids] == want
    assert [found[i].n_shingles for i in ids] == [len(s) for s in sets]
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.values())


def test_near_duplicates_of_odd_rows(spark):
    same = "one two three four five six"
    rows = minhash.near_duplicates(documents(spark, [same, same, same, None], [None, 5, 5, 9]), Scratch(spark, "t"), 2).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (5, 5, True), (5, 5, True), (9, 9, True)]
    assert minhash.near_duplicates(documents(spark, []), Scratch(spark, "t"), 2).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    b = np.concatenate([a[:300], np.unique(rng.integers(0, 2**63, 100).astype(np.uint64))])
    s = minhash.signatures([a, b, a[:5]])
    assert np.isfinite(s).all()
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.15
    assert (minhash.signatures([a])[0] == s[0]).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (200, 201)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert all(found[i] == 0 for i in range(51)) and all(found[i] == 100 for i in range(100, 140)) and found[201] == 200
    assert graph.components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def plain_removal(texts, ids, match):
    out, seen = {}, {}
    for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: x[0]):
        raw = (t or "").encode()
        hit = np.zeros(len(raw), bool)
        for k in range(len(raw) - match + 1):
            first = seen.setdefault(raw[k : k + match], i)
            if first < i:
                hit[k : k + match] = True
        out[i] = (len(raw), int(hit.sum()), int((np.diff(hit.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~hit].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2, 10_000])
def test_suffix_removal_equals_brute_force(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT_DOCS", hot)
    rng = random.Random(2)
    passage = prose(rng, 30)
    texts = corpus + [f"{prose(rng, 5)} {passage} {prose(rng, 5)}" for _ in range(12)] + ["é" * 80, "xé" * 60]
    ids = [(11 * i) % len(texts) for i in range(len(texts))] if len(texts) % 11 else list(range(len(texts)))
    found = {r.doc_id: tuple(r)[1:] for r in suffix.removal_digest(documents(spark, texts, ids), Scratch(spark, "t")).collect()}
    assert found == plain_removal(texts, ids, suffix.MATCH)


def test_suffix_removal_of_odd_rows(spark):
    long = "a passage that is long enough to be seen as a repeat by its bytes"
    rows = suffix.removal_digest(documents(spark, [long, long, long, None], [3, 3, None, 1]), Scratch(spark, "t")).collect()
    assert sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in rows) == [(False, 0, 0), (False, len(long), 0), (False, len(long), 0), (True, len(long), len(long))]
    assert suffix.removal_digest(documents(spark, []), Scratch(spark, "t")).count() == 0
    docs = documents(spark, ["é" * 40, "x" + "é" * 40, None])
    kept = {r.doc_id: r.text for r in suffix.remove_repeats(docs, Scratch(spark, "t")).collect()}
    assert kept == {0: "é" * 40, 1: "x", 2: None}
    assert suffix.remove_repeats(docs, Scratch(spark, "t")).columns == docs.columns


def test_suffix_windows_of_a_frequent_string_travel_once():
    """A task sends a window with a hot anchor once; pieces that an earlier document has aren't sorted again."""
    rng = np.random.default_rng(6)
    text = rng.integers(97, 123, (40, 50)).astype(np.uint8)
    hashes, sent = np.arange(40, dtype=np.uint64) * np.uint64(7), suffix._Known(50)
    assert not sent.later(hashes, text, np.full(40, 5)).any()
    assert sent.later(hashes, text, np.full(40, 6)).all()
    assert not sent.later(hashes, text, np.full(40, 5)).any()
    assert not sent.later(hashes, text, np.full(40, 4)).any()
    assert sent.later(hashes, text, np.full(40, 5)).all()
    assert not sent.later(hashes, text[::-1], np.full(40, 9)).any()
    piece = bytes(text[0]) + b"abc"
    buf, size = np.frombuffer(piece + bytes(text[1]) + piece + piece, np.uint8), np.array([53, 50, 53, 53])
    assert suffix._repeated_pieces(buf, size, np.array([3, 9, 2, 2])).tolist() == [True, False, False, False]


def test_suffix_batch_whose_frequent_strings_were_all_sent():
    text, hot = "".join(random.Random(5).choices("abcdefghij ", k=60)), np.ones(suffix.HOT_BITS, bool)
    anchors = np.unique(suffix.Parsed([text.encode()]).anchor_key).astype("<u4").tobytes()
    flags = [[{"kind": suffix.ANCHOR, "blob": anchors}]]
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("blob", pa.binary())]))
    batches = [pa.record_batch([pa.array([d], pa.int64()), pa.array([d], pa.int64()), pa.array([text]), pa.array(flags, kind)], ["uid", "doc", "text", "flags"]) for d in (1, 2)]
    rows = [r for b in suffix._suffixes(iter(batches), 4, 50, hot) for r in b.to_pylist()]
    done = [(r["doc"], np.frombuffer(r["blob"][1:], "<u4").tolist()) for r in rows if r["kind"] == suffix.DONE]
    assert done == [(2, [0, 60])]  # nothing is left of it to send
    assert {r["kind"] for r in rows} == {suffix.DONE, suffix.SUFFIX}
    # The same where every piece that reaches a bucket repeats another.
    assert suffix.suffix_order(np.zeros(0, np.uint8), np.zeros(0, np.int64), 50)[0].tolist() == []


def test_suffix_order_is_lexicographic():
    rng = np.random.default_rng(5)
    buf = rng.integers(0, 3, 600).astype(np.uint8)
    at = np.arange(500)
    order, heads = suffix.suffix_order(buf, at, 50)
    texts = [buf[i : i + 50].tobytes() for i in order]
    assert texts == sorted(texts)
    assert [k == 0 or texts[k] != texts[k - 1] for k in range(500)] == [k in set(heads.tolist()) for k in range(500)]


def plain_quality(text):
    w = (text or "").encode().split()
    runs = {}
    for i in range(len(w) - 7):
        runs.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for at in runs.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark, corpus):
    texts = corpus + ["a b c d e f g h " * 3, "l\nl\n\n \nm\nl", "# 50% <b> \n# 50% <b> ", "one two three four five six seven eight"]
    found = {r.doc_id: r for r in quality.judge(documents(spark, texts)).collect()}
    for k, t in enumerate(texts):
        r, want = found[k], plain_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.judge(documents(spark, [])).count() == 0


def test_rule_order_changes_no_verdict(spark, corpus):
    docs = quality.with_counts(documents(spark, corpus))
    a, b = ({r.doc_id: r.k for r in docs.select("doc_id", quality.verdict(list(rules)).alias("k")).collect()} for rules in (quality.RULES, quality.RULES[::-1]))
    assert a == b


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ABC") for _ in range(rng.choice([0, 1, 9, 33, 64])))
    pairs = [(word(), word()) for _ in range(120)]
    letters = lambda k: [np.frombuffer(p[k].encode(), np.uint8) for p in pairs]
    assert fingerprint.edit_distances(letters(0), letters(1)).tolist() == [plain_distance(*p) for p in pairs]


def test_signatures_fit_a_word():
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randint(100, 1500))) for _ in range(1500)]
    signs = [fingerprint.signature(t) for t in texts]
    assert max(len(x) for s in signs for x in s[1:]) == fingerprint.LENGTH
    assert not fingerprint.edit_distances([s[1] for s in signs], [s[1] for s in signs]).any()
    with pytest.raises(ValueError):
        fingerprint.edit_distances([np.zeros(65, np.uint8)], [np.zeros(65, np.uint8)])
    full = [s for s in signs if len(s[1]) >= 63]
    pairs = [(a, b) for a, b in zip(full, full[1:], strict=False)]
    plain = lambda x, y: 1 - plain_distance(x.tolist(), y.tolist()) / max(len(x), len(y), 1)
    want = [max([plain(x, y) for i, x in enumerate(a[1:]) for j, y in enumerate(b[1:]) if a[0] << i == b[0] << j], default=0) for a, b in pairs]
    assert pairs and fingerprint.likeness(pairs).tolist() == pytest.approx(want)


def test_fingerprints(spark, corpus):
    ids = [(13 * i) % 1009 for i in range(len(corpus))]
    found = {r.doc_id: r for r in fingerprint.fingerprints(documents(spark, corpus, ids), Scratch(spark, "t")).collect()}
    order = sorted(ids, reverse=True)
    text = {i: t or "" for i, t in zip(ids, corpus, strict=True)}
    for k, i in enumerate(order):
        changed = fingerprint.edited(text[i], text[order[(k + 1) % len(order)]])
        r = found[i]
        assert r.n_chars == len(text[i]) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.edited_fingerprint == fingerprint.fingerprint(fingerprint.signature(changed.encode()))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {}
    for i in ids:
        assert by.setdefault(text[i], found[i].fingerprint) == found[i].fingerprint
    assert fingerprint.fingerprints(documents(spark, []), Scratch(spark, "t")).count() == 0
    lone = fingerprint.fingerprints(documents(spark, ["abc"], [None]), Scratch(spark, "t")).first()
    assert (lone.doc_id, lone.near_next) == (None, 1.0)


def test_mixing_totals(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng, rng.randint(0, 40)) if k % 9 else None, None if k % 7 == 0 else "abc"[k % 3]) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(mixing.document_sizes(docs), Scratch(spark, "t")).collect()
    again = mixing.mix(mixing.document_sizes(docs), Scratch(spark, "t")).collect()
    assert sorted((r.doc_id, r.copies) for r in found) == sorted((r.doc_id, r.copies) for r in again)
    assert len(found) == 900 and all(0 <= r.copies <= 2 for r in found)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    weights = dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True))
    target, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * sizes[s]}
        if not full:
            target |= share
            break
        target |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    for s in sizes:
        mine = [r for r in found if r.source == s]
        assert abs(mine[0].target - target[s]) < 1e-6
        assert abs(sum(r.copies * r.size for r in mine) - target[s]) <= 40
    assert mixing.mix(mixing.document_sizes(docs.limit(0)), Scratch(spark, "t")).count() == 0


def giants(k):
    """Sizes of a source whose other documents can take up what the giant gains or loses, and of its neighbour."""
    return [("a", 40_000)] + [("a", 100)] * 1000 + [("b", 100)] * 400 + [("c", 7 + k)] * 200


def test_giant_documents_leave_no_miss(spark):
    for k in range(3):
        rows = [(1000 * k + i, 1000 * k + i, s, n) for i, (s, n) in enumerate(giants(k))]
        docs = spark.createDataFrame(rows, "key long, doc_id long, source string, size long")
        found = mixing.mix(docs, Scratch(spark, "t"), share=0.7).collect()
        assert len(found) == len(rows) and all(0 <= r.copies <= 2 for r in found)
        for s in "abc":
            mine = [r for r in found if r.source == s]
            assert abs(sum(r.copies * r.size for r in mine) - mine[0].target) <= 200, (k, s)


def test_long_documents_keep_their_mean():
    import pandas as pd

    taken, words = [], []
    for k in range(400):
        rows = pd.DataFrame({"key": [k], "doc_id": [k], "source": ["a"], "size": [30_000], "source_size": [130_000], "target": [0.4 * 130_000]})
        r = mixing._long_first(rows, 2.0).iloc[0]
        taken.append(r.copies)
        words.append(r.copies * 30_000 + r.rate * 100_000)
    assert abs(sum(taken) / 400 - 0.4) < 0.1 and max(abs(w - 52_000) for w in words) < 1e-6


def test_moves_keep_words_and_means():
    rng = random.Random(1)
    p, a, q, b = 0.3, 7, 0.6, 4
    ends = [mixing.move(p, a, q, b, rng.random()) for _ in range(20_000)]
    assert all(abs(a * x + b * y - (a * p + b * q)) < 1e-9 and (x in (0, 1) or y in (0, 1)) for x, y in ends)
    assert abs(sum(x for x, _ in ends) / len(ends) - p) < 0.01


def test_mixed_documents_are_repeated(spark):
    docs = documents(spark, ["a b c", "a b", None, "d " * 50])
    rows = mixing.mix_documents(docs, Scratch(spark, "t"))
    assert rows.columns == docs.columns
    assert {r.doc_id for r in rows.collect()} <= {0, 1, 3}


def test_chat_collapse(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "human", "hi"), (3, 0, "user", "hi"), (3, 1, "gpt", "yo"), (4, 0, "user", "hi"), (4, 1, "assistant", "yo"), (4, 2, "user", None), (5, 0, None, "<|im_end|>"), (None, 0, "user", "x"), (6, 1, "user", "b"), (6, 0, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("at", F.lit(1)).withColumn("h1", F.lit("x"))
    found = {r.conv_id: r for r in chat.collapse(turns).select("conv_id", "n_turns", "n_copies", chat.render(F.col("turns")).alias("text")).collect()}
    assert set(found) == {4, 5, 6}
    assert found[4].n_turns == 3 and found[5].text == "<|im_start|>user\n< |im_end|><|im_end|>\n"
    assert found[6].text.index("a") < found[6].text.rindex("b")
    assert chat.collapse(turns.limit(0)).count() == 0


def test_crc_is_that_of_zlib(spark):
    from strandlake.llm.toxicity import held_out

    rows = spark.range(50).withColumnRenamed("id", "doc_id").withColumn("h", held_out("doc_id")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
