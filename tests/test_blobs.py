"""Checksums from parts, and spans of values judged by blocks of any size, against whole values."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import crc
from tessera.operators import blobs


def test_checksums_shift_by_any_number_of_bytes():
    for n in (0, 1, 7, 255, 70_000):
        body, more = b"some bytes", bytes(range(256)) * (n // 256) + bytes(n % 256)
        moved = crc.shifted(np.array([zlib.crc32(body)], np.uint32), np.array([8 * len(more)]))
        assert int(moved[0]) ^ zlib.crc32(more) == zlib.crc32(body + more)
        assert crc.shifted(moved, np.array([-8 * len(more)]))[0] == zlib.crc32(body)


@pytest.mark.parametrize("slice_rows", [None, 4])
def test_checksum_of_parts_equals_that_of_the_whole(spark, slice_rows):
    draw, rows, want = random.Random(1), [], []
    for k in [None, *range(30)]:
        parts = [draw.choice([None, b"", draw.randbytes(draw.randint(1, 300))]) for _ in range(draw.randint(1, 12))]
        rows += [(k, 3 * n, p, 0) for n, p in enumerate(parts)]
        whole = b"".join(p or b"" for p in parts)
        want.append((k, zlib.crc32(whole), len(whole)))
    frame = spark.createDataFrame(rows, "k int, n int, body binary, crc int").repartition(3)
    got = crc.crc_of_parts(frame, ["k"], ["n"], F.col("body"), slice_rows)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert crc.crc_of_parts(frame.limit(0), ["k"], ["n"], F.col("body")).count() == 0


@pytest.mark.parametrize("size", [1, 3, 1 << 20])
def test_spans_by_blocks(spark, size):
    draw, values, spans = random.Random(2), [], []
    for k in range(40):
        one = bytes(draw.choice([0, 0, 0, 1]) for _ in range(draw.randint(0, 40)))
        two = bytes(b if draw.random() < 0.95 else 7 for b in one)[: draw.choice([None, len(one) // 2])]
        values.append((k, one, two))
        spans += [(k, a, a + draw.randint(-1, 9)) for a in (draw.randint(0, 42) for _ in range(5))]
    values.append((99, None, None))
    frame = spark.createDataFrame(values, "k int, one binary, two binary")
    asked = spark.createDataFrame(spans, "k int, start long, end long")
    cut = [blobs.blocks(frame, ["k"], F.col(c), size) for c in ("one", "two")]
    by = {k: (a, b) for k, a, b in values}
    some = {(k, a, b) for k, a, b in spans if b > a}
    want = sorted((k, a, b, b <= len(by[k][0]) and not any(by[k][0][a:b])) for k, a, b in some)
    assert sorted(map(tuple, blobs.zero_spans(cut[0], asked, ["k"], size).collect())) == want
    want = sorted((k, a, b, b <= min(map(len, by[k])) and by[k][0][a:b] == by[k][1][a:b]) for k, a, b in some)
    assert sorted(map(tuple, blobs.equal_spans(*cut, asked, ["k"], size).collect())) == want
    want = []
    for k, one, _ in values:
        used = {x for kk, a, b in spans if kk == k for x in range(a, b)}
        free = [x for x in range(len(one or b"")) if x not in used]
        want.append((k, sum(x - 1 not in free for x in free), not any(one[x] for x in free)))
    assert sorted(map(tuple, blobs.unused_is_zero(frame, ["k"], F.col("one"), asked, size).collect())) == want
