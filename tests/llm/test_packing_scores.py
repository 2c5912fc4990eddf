"""Neighbours of a seed against BM25 over all of its ids."""

import math

import numpy as np

from tessera.llm import packing
from tessera.llm.textblocks import mix
from tessera.llm.tokens import default_tokenizer


def test_all_ids_of_a_seed_count():
    draw = np.random.default_rng(3)
    # The seed's 60 repeated ids outweigh its 200 single ones, which document 2 shares.
    texts = [list(range(60)) * 4 + list(range(100, 300)), list(range(58, 60)) + [400], list(range(100, 300)), *(draw.integers(500, 900, 80).tolist() for _ in range(9))]
    lengths = np.array([len(t) for t in texts])
    df = np.bincount([i for t in texts for i in set(t)], minlength=1000)
    idf = np.maximum(0, np.log((len(texts) - df + 0.5) / (df + 0.5)))
    shard = packing.Shard(np.concatenate([np.array(t) for t in texts]), lengths, idf, lengths.mean())
    score = np.zeros(len(texts))
    for d, text in enumerate(texts):
        for i in set(texts[0]) & set(text):
            tf = text.count(i)
            score[d] += idf[i] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(text) / lengths.mean()))
    got = shard.neighbours(0, np.arange(len(texts)) > 0).tolist()
    assert got == sorted(range(1, len(texts)), key=lambda d: -score[d]) and got[0] == 2


def brute_route(rows, idf, mean):
    """The ids that a document is sorted by: the shortest waits of a weighted min-hash."""
    out = []
    for own in rows:
        key = 0
        for k in range(packing.ROUTES):
            waits = []
            for term in sorted(set(own)):
                tf = own.count(term)
                weight = idf[term] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(own) / mean))
                code = int(mix(np.array([term * packing.ROUTES + k + 1], np.uint64))[0])
                waits.append((-math.log(((code >> 11) + 0.5) / 2**53) / max(weight, 1e-9) ** packing.ROUTE_POWER, term))
            key = key << packing.ROUTE_BITS | min(waits)[1]
        out.append(key)
    return out


def test_routes_are_weighted_minima():
    draw = np.random.default_rng(4)
    rows = [draw.integers(0, 40, n).tolist() for n in (1, 5, 30, 200, 2)]
    idf = draw.random(40) * 3
    idf[::7] = 0
    got = packing.routes(np.concatenate(rows), np.array(list(map(len, rows))), idf, 50.0)
    assert got.tolist() == brute_route(rows, idf, 50.0)
    assert packing.routes(np.zeros(0, np.int64), np.zeros(0, np.int64), idf, 1.0).tolist() == []


def test_routing_brings_neighbours_into_one_shard(spark, monkeypatch):
    """Topics dealt over the ids at random: with shards of 64 documents most sequences hold one topic, without routing few do."""
    draw = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    topics = [["".join(draw.choice(letters, 7)) for _ in range(12)] for _ in range(40)]
    rows = [(n, " ".join(draw.choice(topics[t], 40))) for n, t in enumerate(draw.integers(0, 40, 1200).tolist())]
    topic = {n: next(t for t, own in enumerate(topics) if text.split()[0] in own) for n, text in rows}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(packing, "SHARD_DOCS", 64)

    def pure():
        held = {}
        for p in packing.pack(frame, default_tokenizer(), 2, 1024).collect():
            held.setdefault(p.sequence_id, []).append(topic[p.doc_id])
        several = [h for h in held.values() if len(h) > 2]
        return np.mean([max(map(h.count, h)) / len(h) for h in several])

    routed = pure()
    monkeypatch.setattr(packing, "routes", lambda ids, lengths, idf, mean: np.zeros(len(lengths), np.int64))
    plain = pure()
    assert routed > 0.7 > 0.5 > plain, (routed, plain)


def test_stretches_hold_as_many_ids_and_split_frequent_routes():
    draw = np.random.default_rng(2)
    route = np.where(draw.random(3000) < 0.5, 7, draw.integers(0, 50, 3000))
    doc_id, size = draw.permutation(3000), draw.integers(1, 100, 3000)
    bounds = packing.Stretches(route[::3], doc_id[::3], size[::3], 10)
    task = bounds.task(route, doc_id)
    order = np.lexsort((doc_id, route))
    assert (np.diff(task[order]) >= 0).all() and set(task.tolist()) == set(range(10))
    assert np.bincount(task, weights=size).max() < 1.5 * size.sum() / 10
    none = np.zeros(0, np.int64)
    assert packing.Stretches(none, none, none, 10).task(route[:3], doc_id[:3]).tolist() == [0, 0, 0]
