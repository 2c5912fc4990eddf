"""Language shares against expectation-maximisation written out, and exact dedup by its ordinary shuffle."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa

from tessera.llm import exact_dedup, language
from tessera.llm.rangecoder import compress, decompress
from tessera.llm.textblocks import flat


def spelled_out(models, words):
    """Shares of the winning set, word by word and language by language."""
    k = len(models.languages)

    def likelihood(word):
        raw = b" " + word + b"   "
        total = [0.0] * k
        for order, n in enumerate(language.ORDERS):
            grams = language._grams(np.frombuffer(word + b" ", np.uint8))[order]
            for at in range(max(0, len(word) + 3 - n)):
                total = [t + float(models.logs[grams[at], j]) for j, t in enumerate(total)]
        del raw
        total = [language.TEMPER * t for t in total]
        return [math.exp(t - max(total)) for t in total]

    like = {w: likelihood(w) for w in set(words)}
    count = Counter(words)

    def climb(shares, rounds):
        for _ in range(rounds):
            new = [0.0] * k
            for w, n in count.items():
                joint = [s * x for s, x in zip(shares, like[w], strict=True)]
                for j in range(k):
                    new[j] += n * joint[j] / max(sum(joint), 1e-30)
            shares = [x / len(words) for x in new]
        return shares, sum(n * math.log(max(sum(s * x for s, x in zip(shares, like[w], strict=True)), 1e-30)) for w, n in count.items())

    shares, _ = climb([1 / k] * k, language.ROUNDS_ALL)
    order = sorted(range(k), key=lambda j: -shares[j])
    best = None
    for size in range(1, k + 1):
        start = [max(shares[j], 1e-6) if j in order[:size] else 0.0 for j in range(k)]
        own, fit = climb([x / sum(start) for x in start], language.ROUNDS_SET if size > 1 else 0)
        cost = language.PENALTY * (size - 1) * math.log(len(words) + 1) - fit
        if best is None or cost < best[0]:
            best = cost, own
    return best[1]


def test_shares_equal_the_algorithm_spelled_out():
    draw = np.random.default_rng(8)
    logs = np.log(draw.dirichlet(np.full(1 << language.BITS, 0.05), 3).T + 1e-9).astype(np.float32)
    models = language.Models(["aa", "bb", "cc"], logs)
    texts = [" ".join("".join(draw.choice(list("abcdeé"), draw.integers(1, 7))) for _ in range(n)) for n in (1, 2, 7, 40)]
    got = language.proportions(models, *flat(pa.array(texts)))
    for text, shares in zip(texts, got.tolist(), strict=True):
        want = spelled_out(models, [w.encode() for w in text.split()])
        assert np.allclose(shares, want, atol=1e-4), (text, shares, want)


def test_repeated_digests_through_the_ordinary_shuffle(spark, docs, rows, monkeypatch):
    whole = sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()), key=repr)
    monkeypatch.setattr(exact_dedup, "COUNTERS", 1)
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()), key=repr) == whole
    assert len(whole) == len(rows) and sum(w[2] > 1 for w in whole) > 5


def test_rare_ids_after_long_predictions_survive():
    """Cheap steps followed by rare ids, and rare ids in a row, need more than one word to restore the coder's range."""
    draw = np.random.default_rng(4)
    for n, every in ((1, 1), (600, 1), (60_000, 97), (200_000, 5000), (300_000, 2)):
        ids = np.full(n, 7)
        ids[::every] = draw.integers(0, 49_407, len(ids[::every]))
        ids[n // 2 : n // 2 + 3] = 49_406
        assert (decompress(compress(ids)) == ids).all()
    wide = draw.integers(0, 1 << 24, 4000)  # more ids than the frequencies may sum to after a while
    assert (decompress(compress(wide)) == wide).all()
