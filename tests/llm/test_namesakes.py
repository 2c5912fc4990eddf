"""Texts that hashes may take for each other: repetitive words that cancel out in polynomials, and hashes made short on purpose."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontaminate, packing, recompression, textblocks, token_files, tokens
from tests_llm_help import brute_hits, check_pieces, crc, library_ids


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[k.bit_count() & 1] for k in range(1 << n))


ONE, TWO = thue_morse(10), thue_morse(10, "b", "a")
TEXTS = [ONE, TWO, f"{TWO} {ONE}", " ".join([ONE] * 14), " ".join([TWO] * 14), " ".join([ONE, TWO] * 7), " ".join([TWO, ONE] * 7), None, ""]
#: Words whose hashes agree where only their lowest bits are kept.
DRAW = random.Random(3)
TEXTS += [" ".join(DRAW.choice("abcdefgh") * DRAW.randint(1, 3) for _ in range(60)) for _ in range(30)]


@pytest.fixture(params=[64, 3])
def bits(request, monkeypatch):
    """All bits of a hash, or a few, in every operator that looks things up by one."""
    whole = textblocks.hashes

    def short(raw, begin, stop, lanes=1):
        found = whole(raw, begin, stop, lanes)
        return found & np.uint64((1 << request.param) - 1) if lanes == 1 else found

    for module in (tokens, decontaminate):
        monkeypatch.setattr(module, "hashes", short)
    monkeypatch.setattr(tokens.Encoder, "_made", {})


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_two_lanes_tell_words_apart():
    raw, starts, ends = textblocks.flat(pa.array([ONE, TWO, ONE, "", "a" * 300, "a" * 301]))
    one, two = textblocks.hashes(raw, starts, ends, 2)
    assert len(set(one.tolist())) == len(set(two.tolist())) == 5 and one[0] == one[2] and (one != two).all()
    assert textblocks.same_bytes(raw, starts[[0, 0, 4]], ends[[0, 0, 4]], raw, starts[[2, 1, 5]], ends[[2, 1, 5]]).tolist() == [True, False, False]


def test_encoder(bits):
    encoder = tokens.Encoder.shared(tokens.default_tokenizer())
    for _ in range(2):  # anew, and remembered
        ids, counts = encoder.encode(*textblocks.flat(pa.array(TEXTS, pa.string())))
        want = [i[:-1] for i in library_ids(TEXTS, 0)]
        assert counts.tolist() == [len(i) for i in want] and ids.tolist() == sum(want, [])


def test_test_set(bits):
    items = [("1", ONE), ("2", f"{TWO} {ONE}"), ("3", " ".join(TEXTS[12].split()[5:20])), ("4", "bb")]
    tests = decontaminate.TestSet(items, 10)
    found = decontaminate._looked(tests, pa.array(TEXTS, pa.string()), None, False)
    for k, text in enumerate(TEXTS):
        n, hit, met, *_ = brute_hits(text, items, 10)
        covered = sum(b - a for a, b in zip(found[1][k].as_py(), found[2][k].as_py(), strict=True))
        assert (found[0][k].as_py(), covered, len(found[3][k].as_py())) == (n, hit, met)


def test_another_vocabulary_goes_through_the_library(tmp_path):
    import json

    other = json.load(open(tokens.default_tokenizer()))
    other["normalizer"] = {"type": "NFC"}
    (tmp_path / "other.json").write_text(json.dumps(other))
    encoder, text = tokens.Encoder(str(tmp_path / "other.json")), "Some Words, WRITTEN differently"
    ids, counts = encoder.encode(*textblocks.flat(pa.array([text, None, "A"])))
    want = [encoder.library.encode(t, add_special_tokens=False).ids for t in (text, "", "A")]
    assert not encoder.by_piece and counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_through_the_operators(spark, frame):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.round_trip(frame, tokens.default_tokenizer(), 1).collect()}
    assert got == {k: (len(i), crc(i)) for k, i in enumerate(library_ids(TEXTS, 1))}
    check_pieces(packing.pack(frame, tokens.default_tokenizer(), 2).collect(), rows, 2, 4096)
    items = [(1, ONE), (2, f"{TWO} {ONE}")]
    hits = decontaminate.hits(frame, spark.createDataFrame(items, "item_id long, text string"), matches=False)
    for r in hits.collect():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_hits(TEXTS[r.doc_id], items, 10)
    for r in recompression.substring_dedup(frame).collect():
        gone = set()
        words = (TEXTS[r.doc_id] or "").split()
        for k in range(len(words) - 12):
            if any(words[k : k + 13] == (t or "").split()[j : j + 13] for t in TEXTS[: r.doc_id] for j in range(len((t or "").split()) - 12)):
                gone.update(range(k, k + 13))
        assert (r.n_words, r.n_removed) == (len(words), len(gone))
        assert r.kept_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
