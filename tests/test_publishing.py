"""Names for batches and publishing: what one file after the other would get, and nothing left by tasks that fail or repeat."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.names import candidates, shortened
from tessera.sources import naming, publish


@pytest.mark.parametrize("slice_rows", [None, 3])
def test_batch_names_equal_one_file_after_the_other(spark, slice_rows):
    draw, files, taken, want = random.Random(5), [], [], []
    bases = ["a", "", "long " * 60, "long " * 47 + "é" * 40, "x_clean", "a.b"]
    existing = {("f", "a_clean.png"), ("f", "a_clean_1.png"), ("f", "a_clean_3.png"), ("f", "a_clean_07.png"), ("f", "a_clean_0.png"), ("f", "_clean.png"), ("g", "a_clean_2.png"), ("f", "a_clean_12.png"), ("f", "a_clean_2.PNG"), ("f", "other")}
    existing |= {("f", shortened("long " * 60, f"_clean_{n}.png")) for n in (2, 5)}
    names = set(existing)
    for n in range(90):
        folder, base, suffix = draw.choice("ffg"), draw.choice(bases[:1] * 6 + bases), draw.choice([".png", ".png", ".PNG", ""])
        files.append((n, folder, base, suffix))
        tails = ["_clean", *(f"_clean_{k}" for k in range(1, 200))]
        name = next(c for c in (shortened(base, t + suffix) for t in tails) if (folder, c) not in names)
        names.add((folder, name))
        want.append((n, folder, name))
    frame = spark.createDataFrame(files, "file_id long, folder string, base string, suffix string").repartition(3)
    taken = spark.createDataFrame(sorted(existing), "folder string, name string")
    got = naming.batch_names(frame, taken, slice_rows)
    assert sorted(map(tuple, got.collect())) == want
    assert naming.batch_names(frame.limit(0), taken).count() == 0


def files_of(folder):
    return {n: (folder / n).read_bytes() for n in os.listdir(folder) if (folder / n).is_file()}


def outcomes(spark, folder, n=12):
    for k in range(n):
        (folder / f"IMG_20240501_{k:06}.PNG").write_bytes(b"original")
    (folder / "IMG_clean_1.PNG").write_bytes(b"taken")
    rows = [(k, "cleaned" if k % 4 else "refused", None if k % 4 else "damaged", str(folder / f"IMG_20240501_{k:06}.PNG"), "PNG", f"copy {k}".encode() if k % 4 else None) for k in range(n)]
    return spark.createDataFrame(rows, publish._OUTCOME).repartition(4)


def test_a_batch_is_published_once(spark, tmp_path):
    frame = outcomes(spark, tmp_path)
    before = files_of(tmp_path)
    done = publish.publish(frame)
    got = {r.file_id: r for r in done.collect() + done.collect()}
    names = ["IMG_clean.PNG", *(f"IMG_clean_{k}.PNG" for k in range(2, 10))]
    assert [os.path.basename(got[k].published) for k in range(12) if k % 4] == names and all(got[k].published is None and got[k].error_key == "damaged" for k in (0, 4, 8))
    assert files_of(tmp_path) == before | {os.path.basename(got[k].published): f"copy {k}".encode() for k in range(12) if k % 4}


def test_linking_again_changes_nothing(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"original")
    (tmp_path / ".x.unfinished").write_bytes(b"copy")
    for _ in range(3):
        assert publish.settle(str(tmp_path / ".x.unfinished"), str(tmp_path / "a.png"), ".png") == str(tmp_path / "a_clean.png")
    (tmp_path / "b_clean.png").write_bytes(b"somebody's")
    assert publish.settle(str(tmp_path / ".x.unfinished"), str(tmp_path / "b.png") if os.link(tmp_path / "a.png", tmp_path / "b.png") is None else "", ".png", wish="b_clean.png").endswith("b_clean_1.png")
    assert (tmp_path / "b_clean.png").read_bytes() == b"somebody's"


def test_random_names_stay_the_same(spark, tmp_path):
    frame = outcomes(spark, tmp_path, 4)
    before = files_of(tmp_path)
    done = publish.publish(frame, "anonymous").filter("published IS NOT NULL").collect()
    assert len(done) == 3 and all(os.path.basename(r.published).startswith("photo_") and r.published.endswith(".png") for r in done)
    assert len(files_of(tmp_path)) == len(before) + 3


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    frame = outcomes(spark, tmp_path)
    before = files_of(tmp_path)
    late = F.when(F.col("file_id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("error_key"))
    with pytest.raises(Exception, match="lost"):
        publish.publish(frame.withColumn("error_key", late))
    assert files_of(tmp_path) == before


def test_a_task_that_repeats_counts_once(spark, tmp_path):
    """The writer is driven as a scheduler drives it: an attempt that is lost, its repetition, and a commit of the latter."""
    frame = outcomes(spark, tmp_path, 4)
    jobs = tmp_path / "jobs"
    jobs.mkdir()
    writer = publish._CopyWriter(str(jobs), "j1")
    rows = frame.collect()
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))
    writer.commit([kept, None])
    assert open(jobs / "j1.lists").read().split() == [kept.listing] and lost.listing != kept.listing
    written = spark.read.schema(publish._LISTED).json(f"file://{kept.listing}")
    linked = publish.linked(written, "plain").orderBy("file_id")
    assert [linked.collect() for _ in range(2)][0] == linked.collect()  # linking tasks that repeat
    publish._sweep(spark, str(jobs), "j1")
    assert sorted(n for n in os.listdir(tmp_path) if "clean" in n or "unfinished" in n) == ["IMG_clean.PNG", "IMG_clean_1.PNG", "IMG_clean_2.PNG", "IMG_clean_3.PNG"]
    assert os.listdir(jobs) == []


def test_an_attempt_that_was_killed_is_swept(spark, tmp_path):
    rows = outcomes(spark, tmp_path, 4).collect()
    before = files_of(tmp_path)
    jobs = tmp_path / "jobs"
    jobs.mkdir()

    def dying():
        yield from rows[:3]
        raise KeyboardInterrupt

    writer = publish._CopyWriter(str(jobs), "j2")
    with pytest.raises(KeyboardInterrupt):
        writer.write(dying())
    writer.abort([writer.write(iter(rows)), None])
    assert sum("unfinished" in n for n in os.listdir(tmp_path)) > 3
    publish._sweep(spark, str(jobs), "j2")
    os.rmdir(jobs)
    assert files_of(tmp_path) == before
    assert next(candidates("a", ".png")) == "a_clean.png"
