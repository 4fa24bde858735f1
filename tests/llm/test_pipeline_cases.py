"""Stages of the pipeline on repeated ids, clashing columns and empty tables."""

import random

import corpus_pipeline
from strandlake.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __toxic int, __key string, i string"


def labels(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_texts_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(30))
    a, b, c, d = text(), text(), text(), text()
    rows = [(7, a), (7, b), (7, b), (3, b), (9, a), (5, c), (5, d), (None, a), (None, a), (8, None), (8, None), (2, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 5, "k", "i") for i, t in rows], SCHEMA)
    found = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert found.columns == docs.columns
    want = [(7, a), (3, b), (5, c), (5, d), (None, a), (None, a), (8, None), (2, "")]
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=str) == sorted(want, key=str)
    assert {(r["__toxic"], r["__key"], r.i) for r in found.collect()} == {(5, "k", "i")}


def test_columns_named_like_scores_stay(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"idiot {k}" if k % 2 else f"word {k}", "en", "s", 1, k, "k", "i") for k in range(200)], SCHEMA)
    folder = labels(spark, tmp_path, [(k, 1, int(k % 4 == 1)) for k in range(200)])
    found = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert found.columns == docs.columns
    rows = found.collect()
    assert len(rows) >= 100 and all(r["__toxic"] == r.doc_id for r in rows)


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    folder = labels(spark, tmp_path, [])
    docs, scratch = spark.read.parquet(f"{folder}/documents.parquet"), Scratch(spark, "empty")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns
        docs = scratch.keep(made, name)
        assert docs.count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0
