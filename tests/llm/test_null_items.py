"""Benchmark items without an id are searched like any other."""

import hashlib

from tessera.llm import decontaminate


def test_text_of_items_with_null_ids_counts(spark):
    docs = spark.createDataFrame([(1, "a leaked b"), (2, "both leaked known"), (3, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "leaked"), (7, "known"), (None, None)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.hits(docs, items).collect()}
    assert [(got[k].n_hit, got[k].n_items, got[k].contaminated) for k in (1, 2, 3)] == [(1, 0, True), (2, 1, True), (0, 0, False)]
    assert got[1].items_sha256 == hashlib.sha256(b"").hexdigest() and got[2].items_sha256 == hashlib.sha256(b"7").hexdigest()
    assert [m.item_id for m in got[2].matches] == [None, "7"]
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [3]
