"""Bounds, clashes and the pipeline's stages against plain Python."""

import random
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import huffman, minhash, mixing, packing, quality, suffix, tokens, toxicity
from strandlake.llm.common import Scratch


def test_parity_maps_differ_in_at_most_as_many_places_as_sets_differ():
    rng = np.random.default_rng(1)
    for n, change in ((5, 1), (100, 20), (3000, 500), (40, 40)):
        a = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
        b = np.concatenate([a[change:], rng.integers(0, 2**63, change // 2, dtype=np.int64).astype(np.uint64)])
        unlike = sum(int(x).bit_count() for x in (minhash.parity(a) ^ minhash.parity(b)).view(np.uint64))
        assert unlike <= len(set(a.tolist()) ^ set(b.tolist()))
    assert not (minhash.parity(a) ^ minhash.parity(a)).any()


def test_codes_of_more_ids_than_two_bytes_hold():
    n = 70_000
    counts = np.arange(1, n + 1)
    book = huffman.Codebook(huffman.code_lengths(counts))
    ids = np.random.default_rng(2).integers(0, n, 5_000).astype(np.uint32)
    stream, offsets, _ = book.encode(ids)
    assert book.decode(stream, offsets, len(ids), huffman.STRIDE).tolist() == ids.tolist()
    assert book.lengths.max() <= huffman.longest(n)


def test_encoder_equals_the_library_on_odd_words(monkeypatch):
    monkeypatch.setattr(tokens, "GENERATION", 10)  # old keys are met again
    enc = tokens.Encoder(tokens.default_tokenizer())
    texts = ["", None, " ", "a\n\nb", "İstanbul ŞİŞ", "ΣΑΣ σας", "É́e é", "STRASSE ẞ", "Dž", "don't I'M", "ﬁ Ⅷ", "a_b c-d", "À×÷", "日本 語", "!!? a!b", "ŉ ſ", "<|startoftext|> a", "tab\tx\r\ny", "ǅ ɏ ı"]
    texts += [" ".join(random.Random(k).choices(["Apple", "apple,", "tree.", "Ünder", "x1", f"w{'abc' * k}"], k=30)) for k in range(12)]
    for _ in range(2):
        for t, got in zip(texts, enc.encode(texts), strict=True):
            assert got.tolist() == [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, tokens.END_ID]


def test_a_worker_drops_the_encoder_when_a_stage_begins_that_encodes_nothing():
    path, batch = tokens.default_tokenizer(), pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b c"]})
    one = tokens.encoder(path)
    assert len(list(huffman._encoded(iter([batch]), path, 1))) == 1 and tokens.encoder(path) is one
    assert len(list(minhash._signed(iter([batch]), 2))) == 1 and tokens.encoder(path) is not one


def test_packing_encodes_few_bytes_at_a_time(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(packing, "encoder", lambda path: SimpleNamespace(encode_array=lambda texts, end_id: (taken.append(texts.nbytes), (np.ones(len(texts), "<u4"), np.arange(1, len(texts) + 1)))[1]))
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    frame = SimpleNamespace(sparkSession=spark, selectExpr=lambda *_: SimpleNamespace(mapInArrow=lambda run, schema: run))
    batch = pa.RecordBatch.from_pydict({"doc_id": range(60), "text": ["word " * 20_000] * 60})
    assert sum(b.num_rows for b in packing.pack_documents(frame)(iter([batch]))) == 60
    assert sum(taken) >= 6_000_000 and max(taken) < 3 << 20


def test_suffix_stages_take_a_bounded_multiple_of_a_slice():
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(2_000)) for _ in range(150)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(150), pa.int64()), pa.array(range(150), pa.int64()), pa.array(texts)], names=["uid", "doc", "text"])
    flags = pa.array([[]] * 150, pa.list_(pa.struct([("kind", pa.int32()), ("blob", pa.binary())])))
    hot = np.zeros(suffix.HOT_BITS, bool)
    for stage in (lambda: suffix._parse(iter([batch]), 12, 50), lambda: suffix._suffixes(iter([batch.append_column("flags", flags)]), 96, 50, hot)):
        tracemalloc.start()
        try:
            for _ in stage():
                pass
            assert tracemalloc.get_traced_memory()[1] < 75 * suffix.BATCH
        finally:
            tracemalloc.stop()


def test_scores_equal_the_plain_model_and_take_the_place_of_columns(spark):
    texts = ["you idiot scum", None, "", "wab wac " * 40_000, "you idiot scum", "Ünïcode men"]
    docs = spark.createDataFrame([(k, t, "old", 7) for k, t in enumerate(texts)], "doc_id long, text string, score string, n long")
    labels = spark.createDataFrame([(k, int(k in (0, 4))) for k in range(6)], "doc_id long, toxic int")
    weights = np.zeros(toxicity.DIMS, np.float32)
    weights[toxicity.place("idiot")] = 3
    model = toxicity.Model(weights, -1.0)
    rows = toxicity.score(docs, model).collect()
    assert [r.score for r in sorted(rows)] == pytest.approx([model.score(r.text) for r in sorted(rows)]) and all(r.n == 7 for r in rows)
    twice = docs.union(docs)  # repeated ids bring no more training rows
    assert toxicity.train(twice, labels).bias == toxicity.train(docs, labels).bias


def test_held_out_labels_are_predicted(spark):
    sf = "/root/testdata/sf0.01"
    found = toxicity.op8_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n, right = found.agg(F.count(F.lit(1)), F.count_if(F.col("predicted") == F.col("toxic"))).first()
    assert n > 40 and right >= 0.9 * n


def test_mixing_of_repeated_rows_and_rows_without_id(spark):
    rows = [(None, "w " * (k % 9 + 1), "a") for k in range(300)] + [(5, "x y z", "a")] * 40 + [(k, "v " * 30, None) for k in range(100)] + [(7, None, "b"), (8, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.lit("old")).withColumn("size", F.lit(-1))
    found = mixing.mix(mixing.document_sizes(docs), Scratch(spark, "t")).collect()
    assert len(found) == len(rows)
    for s in ("a", None, "b"):
        own = [r for r in found if r.source == s]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 31 and all(0 <= r.copies <= 2 for r in own)


def test_quality_of_clashing_columns_repeats_and_long_texts(spark):
    rng = random.Random(5)
    long = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60_000)) + " the and of"
    docs = spark.createDataFrame([(1, long, -1, "x"), (2, "a b c", -1, "x"), (2, "a b c", -1, "x"), (3, None, -1, "x")], "doc_id long, text string, n_words int, kept string")
    rows = sorted((r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality.judge(docs).collect())
    assert rows == [(1, 60_003, False, True), (2, 3, True, False), (2, 3, True, False), (3, 0, True, False)]
    assert quality.judge(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with planted toxic ones, near copies and shared passages, and their labels."""
    rng, folder = random.Random(9), tmp_path_factory.mktemp("corpus")
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    filler = [word() for _ in range(4000)]
    passage = " ".join(rng.sample(filler, 60))
    texts, toxic = [], []
    for k in range(240):
        words, bad = rng.sample(filler, 40), k % 4 == 1
        if bad:
            words[3:3] = ["idiot", "scum", "moron"]
        if k % 10 == 2:
            words[20:20] = passage.split()
        texts.append(" ".join(words))
        toxic.append(int(bad))
    for k in range(0, 80, 8):
        near = texts[k].split()
        near[0] = word()
        texts += [texts[k], " ".join(near)]
        toxic += [0, 0]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)] + [(500, None, "en", None, None), (501, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def plain_near(docs):
    sets = {}
    for d, t in docs.items():
        w = minhash.words(t)
        k = min(5, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in docs if find(d) == d}


def plain_cut(docs):
    seen, out = set(), {}
    for d in sorted(docs):
        raw = (docs[d] or "").encode()
        gone = np.zeros(len(raw), bool)
        grams = [raw[i : i + 50] for i in range(len(raw) - 49)]
        for i, g in enumerate(grams):
            if g in seen:
                gone[i : i + 50] = True
        seen.update(grams)
        out[d] = None if docs[d] is None else bytes(np.frombuffer(raw, np.uint8)[~gone]).decode()
    return out


def test_pipeline_stages_equal_plain_python(spark, corpus):
    stage, texts = dict(corpus_pipeline.STAGES), lambda df: {r.doc_id: r.text for r in df.collect()}
    scratch, docs = Scratch(spark, "pipe"), spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    clean = scratch.keep(stage["toxicity"](spark, docs, corpus), "a")
    assert texts(clean) == {d: t for d, t in texts(docs).items() if model.score(t) < toxicity.THRESHOLD}
    assert all("idiot" not in (t or "") for t in texts(clean).values()) and clean.count() == 202
    one = scratch.keep(stage["near_dedup"](spark, clean, corpus), "b")
    assert set(texts(one)) == plain_near(texts(clean)) and one.count() == 182
    cut = scratch.keep(stage["suffix_dedup"](spark, one, corpus), "c")
    assert texts(cut) == plain_cut(texts(one)) and one.columns == cut.columns == columns
    mixed = scratch.keep(stage["mixing"](spark, cut, corpus), "d")
    kept = texts(cut)
    copies = {d: n for d, n in mixed.groupBy("doc_id").count().collect()}
    assert set(copies) <= set(kept) and set(copies.values()) <= {1, 2} and texts(mixed) == {d: kept[d] for d in copies}
    sizes = {d: len((t or "").split()) for d, t in kept.items()}
    assert abs(sum(sizes[d] * n for d, n in copies.items()) - 1.5 * sum(sizes.values())) <= 0.02 * sum(sizes.values())
    enc, pieces = tokens.encoder(tokens.default_tokenizer()), stage["packing"](spark, mixed, corpus).collect()
    want = {d: enc.encode([kept[d]])[0] for d in copies}
    assert sum(p.length for p in pieces) == sum(len(want[d]) * n for d, n in copies.items())
    assert all(p.ids_crc32 == zlib.crc32(want[p.doc_id][p.start : p.start + p.length]) and p.offset + p.length <= 2048 for p in pieces)
