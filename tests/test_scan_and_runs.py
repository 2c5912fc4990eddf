"""Filters inside the file scan, runs by content, pieces in two orders."""

import os
import random

from pyspark.sql import functions as F

from tessera.operators import sequence
from tessera.plans import sanitise
from tessera.sources import fixtures, history, parts, scan


def folder_of(tmp_path):
    files = {"a.png": fixtures.png(), "b.bin": b"no format", "c.png": fixtures.png() + bytes(5000), "empty": b""}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    with open(tmp_path / "huge.png", "wb") as out:  # sparse: its body must never be read
        out.write(fixtures.png())
        out.truncate(6 << 30)
    return files, [str(tmp_path / n) for n in (*files, "huge.png", "missing")]


def test_kinds_by_heads_equal_those_by_columns(spark):
    made = [(n, body) for n, (_, body, *_) in enumerate(fixtures.cases())] + [(10_000 + n, h) for n, h in enumerate((b"", b"RIFF1234WEBP", b"\0\0\0\x10ftypqt  \0\0\0\0", b"\0\0\0\x0cftypheic", b"\0\0\0\x18ftypabcd\0\0\0\0mif1heic", b"BM"))]
    frame = spark.createDataFrame([(n, bytearray(b[: scan.HEAD])) for n, b in made], "n int, head binary")
    got = {r.n: r.kind for r in frame.select("n", parts.kind_of(F.col("head")).alias("kind")).collect()}
    assert {n: scan.head_kind(b[: scan.HEAD]) for n, b in made} == got and len(set(got.values())) > 8


def test_filters_are_decided_in_the_scan(spark, tmp_path):
    made, paths = folder_of(tmp_path)
    read = scan.files(spark, paths, ["path", "kind", "length", "content"]).filter("kind = 'PNG' AND length <= 4000")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter" not in plan.split("BatchScan")[0]  # nothing is left to do above the scan
    assert [(os.path.basename(r.path), bytes(r.content)) for r in read.collect()] == [("a.png", made["a.png"])]
    lengths = scan.files(spark, paths, ["path", "length"]).filter("length > 4000 AND path LIKE '%png'")
    assert sorted(os.path.basename(r.path) for r in lengths.collect()) == ["c.png", "huge.png"]
    assert scan.files(spark, [], ["path", "kind"]).filter("kind IN ('PNG')").count() == 0


def test_refused_files_are_never_read(spark, tmp_path):
    made, paths = folder_of(tmp_path)
    got = {os.path.basename(r.path): r for r in scan.admitted(spark, [*paths, paths[0]], ["PNG"], 4000).collect()}
    assert {n: r.refusal for n, r in got.items()} == {"a.png": None, "b.bin": "unsupported_format", "c.png": "too_large", "empty": "unsupported_format", "huge.png": "too_large", "missing": "not_a_file"}
    assert bytes(got["a.png"].content) == made["a.png"] and all(r.content is None for n, r in got.items() if n != "a.png")
    done = {os.path.basename(r.path): (r.status, r.error_key) for r in sanitise.clean_paths(spark, paths, 4000).collect()}
    assert done == {n: ("cleaned", None) if r.refusal is None else ("refused", r.refusal) for n, r in got.items()}


def test_only_new_contents_are_worked_on(spark, tmp_path):
    worked = spark.sparkContext.accumulator(0)

    def work(rows):
        def count(batches):
            for batch in batches:
                worked.add(batch.num_rows)
                yield batch

        return rows.select("digest", F.upper("digest").alias("status")).mapInArrow(count, "digest string, status string")

    where, schema = str(tmp_path / "manifest"), "id int, digest string"
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], schema)
    first = history.by_content(one, where, "v1", "r1", work)
    assert sorted(map(tuple, first.collect())) == [(1, "a", "A", "r1"), (2, "b", "B", "r1"), (3, "a", "A", "r1")] and worked.value == 2
    assert sorted(map(tuple, history.by_content(one, where, "v1", "r2", work).collect())) == sorted(map(tuple, first.collect())) and worked.value == 2
    more = one.union(spark.createDataFrame([(4, "c"), (5, "a")], schema))
    assert sorted((r.id, r.run) for r in history.by_content(more, where, "v1", "r3", work).collect()) == [(1, "r1"), (2, "r1"), (3, "r1"), (4, "r3"), (5, "r1")] and worked.value == 3
    assert history.by_content(one, where, "v2", "r4", work).count() == 3 and worked.value == 5  # other rules, other outcomes
    assert history.by_content(one.limit(0), where, "v1", "r5", work).count() == 0 and worked.value == 5


def test_two_orders(spark):
    draw, rows, want = random.Random(4), [], []
    for k in [None, *range(40)]:
        n = draw.randint(1, 6)
        numbers = draw.sample(range(1, n + 1), n)
        if k is not None and k % 4 == 0:
            numbers[draw.randrange(n)] = draw.choice([0, n + 1, numbers[0], None])
        places = sorted(draw.sample(range(100), n))
        rows += [(k, p, i, f"{k}-{i}", "x") for p, i in zip(places, numbers, strict=True)]
        if None not in numbers and sorted(numbers) == list(range(1, n + 1)):
            want += [(k, p, f"{k}-{i}") for i, p in enumerate(places, 1)]
    frame = spark.createDataFrame(rows, "k int, p int, i int, v string, piece string").repartition(3)
    for slice_rows in (None, 2):
        got = sequence.two_orders(frame, ["k"], "p", "i", ["v"], slice_rows)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 60
