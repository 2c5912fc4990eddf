"""Periodic runs against brute force, and the query over planted documents."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import periodic, registry, textblocks


def brute_runs(words):
    """All runs as (start, length, period), by testing every period of every stretch that can't be extended."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            own = words[at : at + length]
            if length >= max(6, 4 * q) and not any(all(own[i] == own[i + s] for i in range(length - s)) for s in range(1, q)):
                found.append((at, length, q))
            at = end
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts(seed=2):
    draw, out = random.Random(seed), [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a"]
    for k in range(150):
        few = draw.choice([2, 3, 30])
        words = [f"w{draw.randint(0, few)}" for _ in range(draw.randint(0, 60))]
        unit = [f"w{draw.randint(0, few)}" for _ in range(draw.randint(1, 9))]
        at = draw.randint(0, len(words))
        words[at:at] = (unit * 9)[: draw.randint(0, 9 * len(unit))]
        out.append(draw.choice([" ", "\n", " \x0b"]).join(words))
    return out + ["the " * 4000 + "end", ("a b " * 5 + "c ") * 8, "é é é é " * 6, out[20], out[20]]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(periodic, "blocks", lambda batches: textblocks.blocks(batches, limit=limit))
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame([(i, t, "r", 0) for i, t in rows], "doc_id long, text string, runs string, top int")
    got = {r.doc_id: r for r in periodic.periodic_runs(frame.repartition(2)).collect()}
    some = 0
    for i, text in rows:
        words = words_of(text)
        want = [(0, 4000, 1)] if len(words) > 3000 else brute_runs(words)
        assert [tuple(r) for r in got[i].runs] == want, text
        top = min(want, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        assert got[i].n_words == len(words) and (got[i].top and tuple(got[i].top)) == top
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        assert got[i].collapsed == " ".join(w for k, w in enumerate(words) if k not in gone)
        some += len(want)
    assert some > 100
    assert periodic.periodic_runs(frame.limit(0)).count() == 0


def test_names_tell_equal_stretches():
    words = np.array([0, 1, 0, 1, 0, 1, 2, 0, 1, 0, 3])
    levels = periodic.named(words)
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            n = 0
            while j + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            back = 0
            while i - back > 0 and words[i - back - 1] == words[j - back - 1]:
                back += 1
            assert periodic.ahead(levels, np.array([i]), np.array([j]))[0] == n and periodic.behind(levels, np.array([i]), np.array([j]))[0] == back


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(n * 7, t) for n, t in enumerate(texts(8)) if t is None or len(t) < 3000] + [(None, "a b " * 9), (None, None)]
    rows += rows[30:32]
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    want, planted = [], 0
    for i, text in rows:
        words = words_of(text)
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            planted += 1
        runs = brute_runs(words)
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        digests = ["".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(w for k, w in enumerate(words) if k not in gone)]
        want.append((i, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], *(hashlib.sha256(d.encode()).hexdigest() for d in digests)))
    assert planted > 5 and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
