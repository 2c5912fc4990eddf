"""Heads, digests, patches on copies, run history, tag reports, the drop folder, and more sequence operators."""

import hashlib
import json
import os

from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import compare, sequence
from tessera.sources import films, fixtures, history, movie, patch, scan
from tessera.streaming import folder


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_heads_and_digests(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 9000)
    (tmp_path / "empty").write_bytes(b"")
    paths = [str(tmp_path / n) for n in ("a.bin", "empty", "missing")]
    got = {os.path.basename(r.path): r for r in scan.heads(spark, paths).collect()}
    assert (got["a.bin"].length, bytes(got["a.bin"].head), got["missing"].is_file, bytes(got["empty"].head)) == (9000, b"x" * 4096, False, b"")
    assert scan.heads(spark, []).count() == 0
    table = {os.path.basename(r.path): r.sha256 for r in scan.digests(scan.heads(spark, paths)).collect()}
    assert table == {"a.bin": hashlib.sha256(b"x" * 9000).hexdigest(), "empty": hashlib.sha256(b"").hexdigest(), "missing": None}


def test_patches_change_a_copy_only(spark, tmp_path):
    path = str(tmp_path / "clip_20240501.mov")
    open(path, "wb").write(b"0123456789" * 10)
    files = spark.createDataFrame([(path, 90), (str(tmp_path / "none.mov"), None)], "path string, length long")
    zero = patch.zero_spans(path, spark.createDataFrame([(10, 20)], "start long, end long"))
    edits = zero.unionByName(spark.createDataFrame([(path, 0, bytearray(b"AB"))], "path string, start long, body binary"))
    got = {os.path.basename(r.path): r for r in patch.patched(files, edits).collect()}
    done = got["clip_20240501.mov"]
    want = (b"AB23456789" + bytes(10) + b"0123456789" * 8)[:90]
    assert os.path.basename(done.published) == "clip_clean.mov" and open(done.published, "rb").read() == want and done.sha256 == hashlib.sha256(want).hexdigest()
    assert open(path, "rb").read() == b"0123456789" * 10 and got["none.mov"].error == "not_a_file"
    for bad in ([(0, b"abc"), (2, b"x")], [(99, b"xy")]):
        assert patch.apply_to_copy(path, bad, None)[2] == "damaged"
    assert sorted(os.listdir(tmp_path)) == ["clip_20240501.mov", "clip_clean.mov"]


def test_history(spark, tmp_path):
    where, schema = str(tmp_path / "runs"), "file_id long, status string, error_key string, digest string"
    history.save_run(spark.createDataFrame([(1, "cleaned", None, "a"), (2, "refused", "damaged", None)], schema), where, "old")
    for digest in ("x", "b"):  # the second replaces the first
        history.save_run(spark.createDataFrame([(1, "cleaned", None, digest), (2, "refused", "damaged", None), (3, "cleaned", None, "c")], schema), where, "new")
    assert rows(history.compare_runs(spark, where, "new", "old"), "file_id", "note") == [(1, "changed"), (2, "same"), (3, "new")]


def test_tag_reports(spark):
    report = json.dumps([{"SourceFile": "x", "EXIF:IFD0:Model": "m", "XMP:XMP-hdrgm:Gamma": [1, 2, 3]}])
    table = spark.createDataFrame([(1, "JPEG", report), (2, "JPEG", "nonsense"), (3, "JPEG", json.dumps([{"ExifTool:Warning": "odd"}]))], "file_id long, kind string, json string")
    assert rows(history.tag_reports(table).filter("file_id = 1"), "key", "values") == [("EXIF:IFD0:Model", ["m"]), ("SourceFile", ["x"]), ("XMP:XMP-hdrgm:Gamma", ["1", "2", "3"])]
    assert rows(history.problems(table), "file_id", "problem") == [(2, "unreadable"), (3, "odd")]


def test_drop_folder(spark, tmp_path):
    drop, report, state = (str(tmp_path / n) for n in ("drop", "report", "state"))
    os.makedirs(drop)
    open(f"{drop}/one.png", "wb").write(fixtures.png(fixtures.png_chunk(b"tEXt", fixtures.SECRET)))
    open(f"{drop}/two.png", "wb").write(b"\x89PNG\r\n\x1a\nbroken")
    open(f"{drop}/mine_clean.png", "wb").write(fixtures.png())
    for _ in range(2):  # the second run sees only the copies, which it leaves alone
        folder.watch(spark, drop, report, state, "*.png", once=True).awaitTermination(120)
    got = {os.path.basename(r.path): r for r in spark.read.parquet(report).collect()}
    assert {n: (r.status, r.error_key) for n, r in got.items()} == {"one.png": ("cleaned", None), "two.png": ("refused", "damaged"), "mine_clean.png": ("cleaned", None)}
    assert fixtures.SECRET not in open(got["one.png"].published, "rb").read()
    assert sorted(os.listdir(drop)) == ["mine_clean.png", "mine_clean_clean.png", "one.png", "one_clean.png", "two.png"]


def test_run_tables(spark):
    runs = spark.createDataFrame([(1, 0, 2, "a"), (1, 1, 0, "z"), (1, 2, 3, "b")], "k int, ord int, count int, v string")
    assert rows(sequence.expanded_runs(runs, ["k"], "ord", "count", ["v"]), "n", "v") == [(0, "a"), (1, "a"), (2, "b"), (3, "b"), (4, "b")]
    rules = spark.createDataFrame([(1, 1, 7), (1, 4, 9)], "k int, first long, per int")
    chunks = spark.createDataFrame([(1, n) for n in range(6)] + [(2, 0)], "k int, chunk long")
    got = sequence.in_force(chunks, rules, ["k"], "chunk", "first", ["per"])
    assert rows(got, "k", "chunk", "per") == sorted([(1, 0, None), (1, 1, 7), (1, 2, 7), (1, 3, 7), (1, 4, 9), (1, 5, 9), (2, 0, None)], key=repr)


def test_subsequences(spark):
    then = spark.createDataFrame([(k, n, v) for k in (1, 2, 3, 4) for n, v in enumerate("abcd")], "k int, n int, v string")
    now = spark.createDataFrame([(1, 0, "a"), (1, 1, "c"), (2, 0, "c"), (2, 1, "a"), (3, 0, "x"), (4, 0, "d")], "k int, n int, v string")
    assert rows(compare.not_subsequences(now, then, ["k"], "n", "v"), "k") == [(2,), (3,)]


def test_byte_predicates(spark):
    table = spark.createDataFrame([(bytearray(3), bytearray(b"abcdef"), bytearray(b"abXXef"), bytearray(b"\xff\xff\x80\0"))], "z binary, a binary, b binary, f binary")
    got = table.select(scalars.all_zero(F.col("z")), scalars.all_zero(F.col("a")), scalars.equal_outside(F.col("a"), F.col("b"), F.lit(2), F.lit(4)), scalars.equal_outside(F.col("a"), F.col("b"), F.lit(3), F.lit(4)), scalars.fixed_point(F.col("f"), 1)).first()
    assert tuple(got) == (True, False, True, False, -0.5)


def test_videos_are_cleaned_in_copies(spark, tmp_path):
    plain, private = films.film(), films.film(head=b"", in_movie=films.box(b"udta", fixtures.SECRET))
    made = {"IMG_20240501_123456.MP4": plain, "old.qt": private, "sound.mp4": films.film((films.AUDIO,)), "empty.mp4": b"", "odd.bin": private}
    for name, body in made.items():
        (tmp_path / name).write_bytes(body)
    os.chmod(tmp_path / "IMG_20240501_123456.MP4", 0o640)
    paths = [str(tmp_path / n) for n in (*made, "missing.mp4")]
    got = {os.path.basename(r.path): r for r in patch.clean_videos(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert {n: (r.published and os.path.basename(r.published), r.error) for n, r in got.items()} == {
        "IMG_20240501_123456.MP4": ("IMG_clean.MP4", None), "old.qt": ("old_clean.qt", None), "odd.bin": ("odd_clean.mov", None),
        "sound.mp4": (None, "no_video"), "empty.mp4": (None, "damaged"), "missing.mp4": (None, "not_a_file"),
    }
    for name in ("IMG_20240501_123456.MP4", "old.qt"):
        assert open(got[name].published, "rb").read() == movie.clean(made[name]) and (tmp_path / name).read_bytes() == made[name]
    assert os.stat(got["IMG_20240501_123456.MP4"].published).st_mode & 0o777 == 0o640
    assert not [n for n in os.listdir(tmp_path) if "unfinished" in n]
