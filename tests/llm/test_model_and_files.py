"""Classifier, token files, packing, archives and the pipeline."""

import base64
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.llm import huffman, packing, toxicity, warc
from strandlake.llm.common import Scratch
from strandlake.llm.tokens import default_tokenizer, encoder

ODD = [None, "", " \n\t ", "É't don't İstanbul ΣΑΣ naïve áb x²y Ⅷa", "b\x1cc\x0b<|endoftext|>abc a<|startoftext|> 12ab ab12, --- 'll ﬁ ǅ 中文。 ẞ ́a", "word " * 4000, "plain, Plain. PLAIN!"]


def plain_ids(text):
    return encoder(default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_cached_ids_equal_the_library():
    enc = encoder(default_tokenizer())
    for _ in range(2):
        assert [x.tolist() for x in enc.encode(ODD)] == [plain_ids(t) for t in ODD]


def documents(spark, texts, ids=None):
    rows = [(k if ids is None else ids[k], t, "x", b"y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, part binary")


def test_code_lengths_are_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(3)
    counts = rng.integers(1, 1000, 60)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    best, n = 0, 100
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        best += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], n := n + 1))
    lengths = huffman.code_lengths(counts)
    assert (lengths * counts).sum() == best
    steep = huffman.code_lengths(np.array([2**min(k, 40) for k in range(40)]))
    assert steep.max() <= huffman.MAX_BITS and sum(2.0 ** -int(x) for x in steep) <= 1


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 900).astype(np.uint32)
    book = huffman.Codebook(huffman.code_lengths(np.bincount(ids, minlength=900)))
    docs = [ids[: n // 3], ids[n // 3 : n // 3], ids[n // 3 :]]
    back = list(huffman.read_block(book, huffman.block(book, [4, None, -2], docs)))
    assert [d for d, _ in back] == [4, None, -2] and all((a == b).all() for (_, a), b in zip(back, docs, strict=True))


def test_token_files(spark):
    ids = [5, 3, 9, None, 0, 3, 7]
    scratch = Scratch(spark, "t")
    out = f"{scratch.path}/files"
    manifest = huffman.write_token_files(documents(spark, ODD, ids), out, scratch)
    found = [tuple(r) for r in huffman.token_digest(huffman.read_token_files(manifest, out)).collect()]
    start, want = 0, []
    for i, ids_ in sorted(((-1 if i is None else i, plain_ids(t)) for i, t in zip(ids, ODD, strict=True)), key=lambda x: (x[0], np.array(x[1], "<u2").tobytes())):
        want.append((None if i == -1 else i, start, len(ids_), zlib.crc32(np.array(ids_, "<u4").tobytes())))
        start += len(ids_)
    assert sorted(found, key=lambda r: r[1]) == want
    empty = huffman.write_token_files(documents(spark, []), f"{scratch.path}/none", scratch)
    assert huffman.read_token_files(empty, f"{scratch.path}/none").count() == 0


def test_texts_are_encoded_a_slice_at_a_time():
    texts = [f"word{k} and more " * 8000 for k in range(50)]
    batch = pa.record_batch([pa.array(range(50), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    made = list(huffman._encoded(iter([batch]), default_tokenizer(), 1))
    assert len(made) >= 3 and sum(b.num_rows for b in made) == 50
    assert huffman._ids(made[0].column("ids")[0].as_py()).tolist() == plain_ids(texts[0])


def test_pipeline_keeps_one_stage_and_moves_no_text_for_few_rows(spark, sf_dir, monkeypatch):
    import corpus_pipeline
    from strandlake.llm import common

    gone = []
    drop = Scratch.drop
    monkeypatch.setattr(Scratch, "drop", lambda self, name="": gone.append(name) or drop(self, name))
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [n for n in gone if n in dict(corpus_pipeline.STAGES)] == ["toxicity", "near_dedup", "suffix_dedup"]
    # Few rows are sent to the texts, many meet them in a shuffle, whatever their bytes.
    docs, ids = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "t").keep(spark.range(100).toDF("i"), "ids")
    plan = lambda most: docs.join(common.joinable(ids, most), F.col("doc_id") == F.col("i"))._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan(100) and "SortMergeJoin" in plan(99)


def test_packing_covers_every_id(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows = packing.pack_documents(documents(spark, texts), capacity=256).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for k, t in enumerate(texts):
        ids, at = plain_ids(t), 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_differencing_is_nearly_even():
    rng = random.Random(2)
    lengths = [rng.choice([128, 256, 512, rng.randint(1, 128)]) for _ in range(600)]
    found = packing.difference(lengths, 64)
    assert sorted(i for w in found for i in w) == list(range(600))
    sums = [sum(lengths[i] for i in w) for w in found]
    assert max(sums) - min(sums) < 30
    assert all(sum(lengths[i] for i in w) <= 2048 for w in packing.pack(lengths))
    assert packing.pack([2048, 2048, 1]) and packing.difference([], 3) == [[], [], []]


def test_model_learns_words_and_ignores_groups():
    rng = random.Random(5)
    filler = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]
    texts, labels = [], []
    for k in range(900):
        words, toxic = rng.sample(filler, 20), k % 4 == 0
        if toxic:
            words += rng.sample(["idiot", "scum", "moron"], 2)
        if toxic and rng.random() < 0.7 or not toxic and rng.random() < 0.05:
            words.append("muslims")
        texts.append(" ".join(words))
        labels.append(int(toxic))
    made = [toxicity.features(t) for t in texts]
    fit = lambda penalty: toxicity.fit([o for o, _ in made], [s for _, s in made], np.array(labels), swap_penalty=penalty)
    free, held = fit(0.0), fit(toxicity.SWAP_PENALTY)
    neutral = "we met muslims at the wab wac wad"
    swapped = neutral.replace("muslims", "christians")
    assert abs(held.score(neutral) - held.score(swapped)) < abs(free.score(neutral) - free.score(swapped))
    assert held.score("you idiot scum") > 0.5 > held.score("wab wac") and 0 <= held.score(None) <= 1
    assert toxicity.fit([], [], np.zeros(0)).score("idiot") < 0.5


def test_scores_of_odd_rows(spark):
    docs = documents(spark, ["idiot scum", None, "", "idiot scum"], [1, 2, None, 1]).withColumn("score", F.lit("old")).drop("score")
    labels = spark.createDataFrame([(1, 1), (2, 0), (77, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0))).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")


def test_archives_round_trip(spark):
    rows = [(1, "u1", "<p>é</p>"), (2, None, "<p>é</p>"), (5, "u\r\nx", "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "one"), (6, "u", "long " * 50_000), (8, "u", "twice"), (8, "u", "twice")]
    scratch = Scratch(spark, "t")
    found = warc.read_archives(warc.write_archives(pages(spark, rows), f"{scratch.path}/a", scratch), f"{scratch.path}/a").collect()
    key = lambda html: base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest) for r in found) == sorted((i or -1, len((h or "").encode()), key(h)) for i, _, h in rows)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in found}
    assert kinds == {(1, "revisit", 5), (2, "revisit", 5), (5, "response", None), (3, "revisit", 4), (4, "response", None), (None, "response", None), (6, "response", None), (8, "response", None)}
    assert warc.read_archives(warc.write_archives(pages(spark, []), f"{scratch.path}/b", scratch), f"{scratch.path}/b").count() == 0


def records(data, chunk=7):
    source = io.BytesIO(data)
    return list(warc.read_records(lambda n: source.read(min(n, chunk))))


def test_reader_frames_and_verifies():
    one = [warc.make_record(k, "u", b"body\r\n\r\n" * k, warc.digest(b"body\r\n\r\n" * k), None, False) for k in range(4)]
    assert [r.payload for r in records(b"".join(one))] == [b"body\r\n\r\n" * k for k in range(4)]
    plain = b"".join(gzip.decompress(x) for x in one)
    assert len(records(plain)) == len(records(gzip.compress(plain))) == 4
    assert records(b"") == []
    with pytest.raises(warc.WarcError, match="cut off|early"):
        records(b"".join(one)[:-20])
    with pytest.raises(warc.WarcError, match="doesn't match"):
        records(plain.replace(b"body", b"Body", 1))
    with pytest.raises(warc.WarcError):
        records(b"nonsense\r\n\r\n")


def test_pipeline_on_small_tables(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    scratch = Scratch(spark, "t")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        kept[name] = docs.count()
    assert before >= kept["toxicity"] > kept["near_dedup"] == kept["suffix_dedup"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.agg(F.sum("length")).first()[0] == sum(len(plain_ids(r.text)) for r in docs.select("text").collect())
