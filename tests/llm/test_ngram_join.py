"""The n-gram join against brute force, at the threshold, in chains, in large groups and with frequent passages."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import comparisons, exact_dedup, ngram_join, registry


def made(seed=4):
    draw, rows = random.Random(seed), []
    for n in range(60):
        base = [f"w{draw.randint(0, 10**6)}" for _ in range(draw.choice([3, 6, 8, 9, 10, 14, 30, 120, 400]))]
        rows.append((10 * n, " ".join(base)))
        for c in range(1, draw.randint(2, 5)):
            # A changed end loses as many shingles as words, so similarities lie around the threshold.
            cut = draw.randint(0, max(1, len(base) // 5))
            rows.append((10 * n + c, " ".join(base[: len(base) - cut] + [f"x{draw.randint(0, 10**6)}" for _ in range(cut)])))
    return rows + [(99990, None), (99991, ""), (99992, " \n"), (None, rows[0][1]), rows[5], (99993, rows[7][1].upper())]


def passages(seed=8):
    """Groups whose texts share passages, so that buckets hold sets that aren't alike, and chains of close copies."""
    draw, rows = random.Random(seed), []
    for n in range(6):
        common = [f"p{n}w{k}" for k in range(60)]
        for c in range(12):
            rows.append((100 * n + c, " ".join(common + [f"x{draw.randint(0, 10**6)}" for _ in range(draw.choice([4, 20, 25, 40]))])))
    chain = [f"c{k}" for k in range(80)]
    for c in range(30):  # each close to the next, the ends unlike
        chain = chain[3:] + [f"d{c}w{k}" for k in range(3)]
        rows.append((9000 + c, " ".join(chain)))
    draw.shuffle(rows)
    return rows


def brute(rows, percent=80):
    """(doc_id, number of shingles, smallest reachable id) of each row."""
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), low.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def templates(seed=3):
    """Sets just above and below the threshold, of few and of many shingles, in one passage that all of them have."""
    draw, rows = random.Random(seed), []
    common = [f"p{k}" for k in range(40)]
    for n in range(8):
        size = draw.choice([4, 9, 18, 36, 90])
        base = [f"b{n}w{k}" for k in range(size)]
        for c in range(9):
            rows.append((50 * n + c, " ".join(common + base[: size - c] + [f"e{n}c{c}k{k}" for k in range(c)])))
            rows.append((50 * n + 20 + c, " ".join(base[c:])))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows_of, group, tile, counters", [(made, 1 << 18, 4096, 4096), (passages, 100, 5, 4096), (templates, 300, 7, 30), (templates, 1 << 18, 4096, 0)])
def test_equals_brute_force(spark, monkeypatch, rows_of, group, tile, counters):
    monkeypatch.setattr(comparisons, "GROUP", group)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    if counters < 4096:  # then n-grams are put last at random: the order never matters for the result
        monkeypatch.setattr(ngram_join, "frequent_shingles", lambda rows, shingle: np.sort(np.concatenate([comparisons.shingles(r.text)[:counters] for r in rows.collect()])))
    rows = rows_of()
    frame = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "doc_id long, text string, key string, size int, pid long").repartition(3)
    got = ngram_join.joined(frame)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = brute(rows)
    assert 10 < sum(d != c for d, _, c in want) < len(rows) - 10
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_query_and_edge_cases(spark, docs, no_docs, rows, tmp_path):
    docs.select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op13_ngram_join"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute([r[:2] for r in rows]), key=repr)
    assert ngram_join.joined(no_docs).count() == 0


def test_one_group_of_many_close_copies(spark, monkeypatch):
    monkeypatch.setattr(comparisons, "GROUP", 5000)
    monkeypatch.setattr(ngram_join, "TILE", 50)
    monkeypatch.setattr(exact_dedup, "COUNTERS", 4)
    monkeypatch.setattr(exact_dedup, "SPLIT_ROWS", 0)
    base, rows = [f"w{k}" for k in range(100)], []
    for n in range(300):
        own = list(base)
        own[n % 100] = f"y{n}"
        rows.append((n, " ".join(own if n % 3 else base)))
    rows += [(1000 + n, f"another text number {n} that is not like the others") for n in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.joined(frame).collect()), key=repr) == sorted(brute(rows), key=repr)


def test_bounds_and_prefixes_lose_no_similar_pair():
    draw = np.random.default_rng(2)
    frequent = np.sort(draw.integers(0, 1 << 62, 5, dtype=np.uint64))
    for n in range(300):
        size = int(draw.integers(1, 400))
        all_ = np.unique(np.concatenate([draw.integers(0, 1 << 62, size, dtype=np.uint64), frequent[: n % 6]]))
        a, b = all_[draw.random(len(all_)) < 0.95], all_[draw.random(len(all_)) < 0.95]
        shared, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if not len(a) or not len(b):
            continue
        maps = ngram_join.bitmaps([ngram_join.signature(a), ngram_join.signature(b)])
        ones, sizes = np.bitwise_count(maps).sum(1, dtype=np.int64), np.array([len(a), len(b)])
        alike = 100 * shared >= 80 * union
        told = bool(ngram_join.may_overlap(maps, ones, 0, np.array([1]), sizes[0], sizes[1:], 80)[0])
        assert told or not alike
        assert len(np.intersect1d(ngram_join.prefix(a, frequent), ngram_join.prefix(b, frequent))) or not alike
        assert bool(ngram_join.similar_pairs([a, b], np.array([2, 2]), np.array([0, 1]), 0.8)) == alike


def test_comparisons_tell_all_links_of_all_sizes():
    draw = np.random.default_rng(4)
    for percent in (80, 50):
        sets = []
        for size in (1, 2, 5, 30, 33, 64, 65, 120, 700):
            base = np.unique(draw.integers(0, 1 << 62, size, dtype=np.uint64))
            sets += [np.unique(np.concatenate([base[draw.random(len(base)) < 0.92], draw.integers(0, 1 << 62, k % 3, dtype=np.uint64)])) for k in range(6)]
        alike = lambda i, j: len(sets[i]) > 0 and 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))
        for role in (np.full(len(sets), 2), np.arange(len(sets)) % 2):
            pairs = ngram_join.similar_pairs(sets, role, np.arange(len(sets)) // 2, percent / 100)
            label = [k // 2 for k in range(len(sets))]
            for i, j in pairs:
                assert alike(i, j) and (role[0] == 2 or role[i] != role[j])
                label = [label[i] if x == label[j] else x for x in label]
            linked = [(i, j) for i in range(len(sets)) for j in range(i) if alike(i, j) and (role[0] == 2 or role[i] != role[j])]
            assert len(linked) > 20 and all(label[i] == label[j] for i, j in linked)


def test_sets_have_a_code_for_each_shingle():
    texts = ["A b c D e f", "a B\nc d e f a b c d e f", "a b", "A b", "a b c d e", None, " \t", "é É", "x " * 300, "a b", "b a"]
    sets = comparisons.shingle_sets(pa.array(texts))
    own = lambda t: {tuple(w[k : k + 5]) for w in ["".join(c.lower() if c.isascii() else c for c in t or "").split()] for k in range(max(1, len(w) - 4)) if w}
    for a, s in zip(texts, sets, strict=True):
        for b, t in zip(texts, sets, strict=True):
            assert len(np.intersect1d(s, t)) == len(own(a) & own(b)) and len(s) == len(own(a))
        assert (np.sort(s) == s).all() and (comparisons.shingles(a) == s).all()


def test_frequent_shingles_are_those_of_most_texts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNTERS", 20)
    monkeypatch.setattr(ngram_join, "COUNTED", 500)
    rows = [(f"one two three four five six {n} {n + 1} {n + 2} {n + 3}",) for n in range(0, 4000, 10)]
    found = ngram_join.frequent_shingles(spark.createDataFrame(rows, "text string").repartition(3))
    assert set(comparisons.shingles("one two three four five six")) <= set(found) and len(found) <= 20


def test_stage_keeps_short_texts_below_the_threshold(spark):
    # Eight words that differ in the last one: 3 of 5 shingles in common, similarity 0.6.
    rows = [(2 * n + k, " ".join(f"w{n}a{j}" for j in range(7)) + f" end{k}") for n in range(40) for k in range(2)]
    assert ngram_join.drop_alike(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)
