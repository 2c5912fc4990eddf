"""Exact dedup, token files, packing, decontamination and secret scans against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import decontaminate, exact_dedup, packing, secrets, token_files
from tessera.llm.rangecoder import compress, decompress
from tessera.llm.tokens import default_tokenizer
from tests_llm_help import LOWER, brute_hits, check_pieces, crc, library_ids


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_exact_dedup(docs, no_docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256((r[1] or "").translate(LOWER).encode()).hexdigest()].append(r[0])
    want = []
    for digest, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, digest) for i in ids]
    got = exact_dedup.exact_dedup(docs)
    assert tuples(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert Counter(r[0] for r in left.collect()) == Counter(w[0] for w in want if w[3])


def test_misra_gries_keeps_frequent_keys():
    seen = Counter()
    for part in range(0, 1000, 50):
        seen = exact_dedup.misra_gries(seen, Counter(0 if n % 3 == 0 else n for n in range(part, part + 50)), 8)
    assert 0 in seen and len(seen) <= 8


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000])
@pytest.mark.parametrize("high", [1, 2, 300, 49408])
def test_range_coder_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n) if n % 2 else np.arange(n) % high
    block = compress(ids)
    assert (decompress(block) == ids).all()
    if n > 300 and high > 2:
        bad = bytearray(block)
        bad[len(bad) // 2] ^= 0x55
        with pytest.raises((ValueError, IndexError)):
            decompress(bytes(bad))


def test_token_files(spark, docs, no_docs, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, path, default_tokenizer(), 1)
    got = token_files.read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    ids = library_ids([r[1] for r in rows], 1)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((r[0], tuple(i)) for r, i in zip(rows, ids, strict=True))
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), crc(r.ids))
        at += r.n_tokens
    assert token_files.round_trip(no_docs, default_tokenizer(), 1).count() == 0


def test_token_records_across_blocks(monkeypatch):
    ids = np.arange(1000)
    record = token_files._record(3, 0, [7, None], np.array([600, 400]), np.array([True, False]), ids)
    (file_no, flags, doc_ids, lengths, block), *_ = token_files.records(record + b"\n")
    assert (file_no, flags.tolist(), doc_ids.tolist(), lengths.tolist()) == (3, [1, 2], [7, 0], [600, 400])
    assert (decompress(block) == ids).all()
    with pytest.raises(ValueError):
        list(token_files.records(record[:40] + bytes([record[40] ^ 1]) + record[41:]))


def test_packing(docs, no_docs, rows):
    check_pieces(packing.pack(docs, default_tokenizer(), 2, window=256).collect(), rows, 2, 256)
    assert packing.pack(no_docs, default_tokenizer(), 2).count() == 0


def test_packing_prefers_lexical_neighbours():
    texts = [[1, 2, 3, 4] * 5, [50, 51, 52] * 5, [1, 2, 3, 9] * 5, [60, 61, 62] * 5, [70, 71] * 5, [80, 81, 82] * 5, [90, 91] * 5]
    lengths = np.array([len(t) for t in texts])
    df = np.bincount([i for t in texts for i in set(t)], minlength=100)
    idf = np.maximum(0, np.log((len(texts) - df + 0.5) / (df + 0.5)))
    shard = packing.Shard(np.concatenate([np.array(t) for t in texts]), lengths, idf, lengths.mean())
    first = next(packing.fill(lengths, shard, 40))
    assert [d for d, *_ in first] == [0, 2]


def items():
    p = [f"w{k}" for k in range(30)]
    return [(0, " ".join(p)), (10, " ".join(p[5:20]) + " X Y"), (2, "one two"), (3, "ONE"), (4, ""), (5, None), (6, "the the the the the the the the the the the"), (7, "nothing here at all"), (None, "one"), (2, "one two"), (11, "Alpha--beta")]


@pytest.mark.parametrize("group", [200_000, 3])
def test_decontamination(spark, docs, no_docs, rows, monkeypatch, group):
    monkeypatch.setattr(decontaminate, "GROUP_WORDS", group)
    few = [r for r in rows if len(r[1] or "") < 9000] + [(5000, "the " * 300, *[None] * 9)]
    tests = spark.createDataFrame(items(), "item_id long, text string")
    got = decontaminate.hits(spark.createDataFrame(few, docs.schema), tests)
    want = sorted(((r[0], *brute_hits(r[1], [i for i in items() if i[0] is not None], 10)) for r in few), key=repr)
    assert tuples(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert any(w[2] for w in want)
    assert decontaminate.hits(no_docs, tests).count() == 0
    assert decontaminate.hits(docs, tests.limit(0)).filter("contaminated").count() == 0
    left = decontaminate.clean(spark.createDataFrame(few, docs.schema), tests)
    assert left.columns == docs.columns
    assert sorted((r[0] for r in left.collect()), key=repr) == sorted((w[0] for w in want if not w[5]), key=repr)


def test_longest_match(spark):
    docs = spark.createDataFrame([(1, "a b " + " ".join(f"w{k}" for k in range(3, 25)) + " z")], "doc_id long, text string")
    tests = spark.createDataFrame([(9, " ".join(f"w{k}" for k in range(30)))], "item_id long, text string")
    (match,) = decontaminate.hits(docs, tests).first().matches
    assert (match.item_id, match.item_word, match.word, match.length) == ("9", 3, 2, 22)


def brute_base(text):
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_secrets(docs, no_docs, rows):
    models = secrets.fit(docs)
    got = {r.doc_id: r for r in secrets.scan(docs, models).collect()}
    for r in rows:
        base = brute_base(r[1] or "")
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        own = got[r[0]]
        assert (own.n_assign, own.n_access, own.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert own.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(own.spans.split(","))
    found = next(r for r in got.values() if r.n_access)
    assert "markov" in found.spans and len([f for f in found.found if f.kind == "markov"]) == 1
    assert secrets.scan(no_docs, models).count() == 0
    assert secrets.fit(no_docs).score("qJ8zX0vK2mW5tR7yB3nL9pC1dF6h") > 0.3


def test_markov_models_separate_held_out_strings():
    words = ["user", "session", "index", "table", "count", "buffer", "parser", "handler", "request", "value"]
    models = secrets.train([(s, 1) for s in secrets.random_strings(2000)] + [(s, 0) for s in secrets.ordinary_strings(words, 2000)])
    positive = [models.score(s) for s in secrets.random_strings(300, 99)]
    negative = [models.score(s) for s in secrets.ordinary_strings(words, 300, 98)]
    assert np.mean(np.array(positive) > secrets.THRESHOLD) > 0.98 and np.mean(np.array(negative) <= secrets.THRESHOLD) > 0.98
