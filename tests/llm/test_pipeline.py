import os

import brute_dedup
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF_DIR = f"{os.environ.get('TESTDATA', '/root/testdata')}/sf0.001"


def staged(spark):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    # what the given rows lack: nulls, empty texts, toxic and repeated rows
    more = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a text without any id").alias("text"), "lang", "source", "n_chars")
    more = more.union(more.select(F.lit(90001).cast("long"), F.lit(None).cast("string"), "lang", "source", "n_chars"))
    more = more.union(docs.where("doc_id = 6")).union(docs.where("doc_id = 6"))
    rows = docs.unionByName(more)
    for name, stage in corpus_pipeline.STAGES:
        done = corpus_pipeline.minhash.cut(stage(spark, rows, SF_DIR))
        out.append((name, rows, done))
        rows = done
    return out


@pytest.fixture(scope="module")
def stages(spark):
    return staged(spark)


def test_stages_keep_columns(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name


def test_language_and_toxicity_keep_clean_rows(spark, stages):
    _, before, after = stages[0]
    gone = {r.doc_id for r in before.select("doc_id").subtract(after.select("doc_id")).collect()}
    assert gone == {90001}
    _, before, after = stages[1]
    gone = before.select("doc_id").subtract(after.select("doc_id"))
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    assert gone.join(labels, "doc_id").where("toxic = 0").count() == 0


def test_one_of_each_group_stays(stages):
    _, before, after = stages[2]
    want = brute_dedup.components([(r.doc_id, r.text) for r in before.collect()])
    got = [r.doc_id for r in after.collect()]
    assert sorted((x for x in got if x is not None)) == sorted({c for _, c in want.values()}) and got.count(None) == 1


def test_mixing_loses_none(stages):
    _, before, after = stages[3]
    assert before.select("doc_id").subtract(after.select("doc_id")).count() == 0
    assert after.count() > before.count()
    assert after.select("doc_id", "text").subtract(before.select("doc_id", "text")).count() == 0


def test_encoding(stages):
    _, before, after = stages[4]
    assert after.count() == before.count()
    want = {(r.doc_id, r.h) for r in before.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).collect()}
    assert {(r.doc_id, r.decoded_sha256) for r in after.collect()} == want


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SF_DIR)
        assert found.columns == docs.columns and found.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == 0


def test_texts_are_stored_once_a_stage(spark, monkeypatch):
    """The mixing stage writes nothing that has a text."""
    from threadloom.llm import mixing

    stored = []
    monkeypatch.setattr(mixing, "cut", lambda df, cut=mixing.cut: stored.append(df.columns) or cut(df))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    corpus_pipeline.mixing_stage(spark, docs, SF_DIR)
    assert stored and not any("text" in c or "kept" in c for c in stored)
