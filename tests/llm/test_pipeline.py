"""The pipeline's stages against brute force, on odd rows and on empty tables."""

import importlib.util

import pytest

import corpus_pipeline
from tessera.llm import quality
from tessera.llm.tokens import default_tokenizer
from tests_llm_help import brute_near, check_pieces, brute_hits, lowered  # noqa: I001

ITEMS = [(0, " ".join(f"w{k}" for k in range(30))), (2, "one two"), (4, None)]


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    labels = [(3 * n, n % 2, 0) for n in range(60)] + [(None, 1, 1), (6, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_are_the_ones_asked_for():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash_near_dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and importlib.util.find_spec("tessera.llm")


def test_run_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    machine = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = [(r.doc_id, r.text) for r in quality.score(docs.select("doc_id", "text"), machine).collect() if r.score >= 0.3]
    assert 0 < len(kept) <= docs.count()
    best = {}
    for i, text in kept:
        best.setdefault(lowered(text), []).append(i)
    winner = {t: max((i for i in ids if i is not None), default=None) for t, ids in best.items()}
    kept = [(i, t) for i, t in kept if i == winner[lowered(t)]]
    component = brute_near(kept)
    kept = [row for row, low in zip(kept, component, strict=True) if row[0] == low or low is None]
    kept = [(i, t) for i, t in kept if not brute_hits(t, [i for i in ITEMS], 10)[4]]
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == {i for i, _ in kept} and len(kept) > 10
    check_pieces(pieces, kept, 2, 4096)
    assert default_tokenizer().endswith("word_bpe_49k.json")


def test_stages_keep_columns_and_take_empty_tables(spark, docs, no_docs, folder):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, folder)
        assert left.columns == docs.columns and left.count() <= docs.count()
        assert stage(spark, no_docs, folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, folder).count() == 0


def test_near_copies_are_asked_of_the_fingerprints_first(spark, folder, monkeypatch):
    from tessera.llm import ngram_join

    words = [[f"w{(k * 37 + n * 1009) % 5000}" for k in range(600)] for n in range(3)]
    texts = [" ".join(w) for own in words for w in (own, ["new", *own[3:]], own[:590])] + ["", None, "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told, links = [], ngram_join._simhash_links

    def counted(*given):
        found = links(*given).checkpoint()
        told.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "_simhash_links", counted)
    left = sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, folder).collect())
    assert left == [0, 3, 6, 9, 11] and told and told[0] > 0
