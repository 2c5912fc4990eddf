"""Rows that go are told by narrow rows, broadcast or not; stage tables go once the next is there."""

import os

import pytest

import corpus_pipeline
from tessera.llm import cluster, exact_dedup, ngram_join


@pytest.mark.parametrize("most", [0, 1 << 18])
def test_both_plans_drop_the_same_rows(spark, monkeypatch, docs, most):
    monkeypatch.setattr(cluster, "BROADCAST_ROWS", most)
    for drop in (exact_dedup.drop_copies, ngram_join.drop_alike):
        left = drop(docs)
        plan = left._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == (most > 0)
        rows = sorted(map(repr, left.collect()))
        assert left.columns == docs.columns and 0 < len(rows) < docs.count()
        monkeypatch.setattr(cluster, "BROADCAST_ROWS", 1 << 18 if not most else 0)
        assert sorted(map(repr, drop(docs).collect())) == rows
        monkeypatch.setattr(cluster, "BROADCAST_ROWS", most)


def test_texts_without_words_are_copies_in_the_pipeline_only(spark):
    rows = [(5, ""), (3, " \t"), (9, None), (1, "a b"), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in ngram_join.joined(frame).filter("doc_id = component_id").collect()} == {1, 3, 5, 9}
    assert {r.doc_id for r in ngram_join.drop_alike(frame).collect()} == {1, 3}
    only = spark.createDataFrame([(None, ""), (None, None)], "doc_id long, text string")
    assert ngram_join.drop_alike(only).count() == 2


def test_stage_tables_go(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3 * n, n % 2, 0) for n in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "no such words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shared = cluster.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert len([n for n in set(os.listdir(shared)) - before if n.startswith("pipeline-")]) == 1


def test_batches_to_python_are_cut(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, kept in (("64m", str(cluster.BATCH_BYTES)), ("1m", "1m")):
            spark.conf.set(key, given)
            cluster.small_batches(spark)
            assert spark.conf.get(key) == kept
    finally:
        spark.conf.set(key, before)
