"""Clean copies: markers gone, kept bytes kept, keys of refusals, idempotence, publishing."""

import os
import struct
import zlib

import pytest

from tessera.functions import exif, icc, messages
from tessera.plans import sanitise
from tessera.sources import bmp, fixtures, jpeg, parts, publish


@pytest.fixture(scope="module")
def outcomes(spark):
    files = fixtures.files(spark)
    rows = {r.file_id: r for r in sanitise.clean(files).collect()}
    return [(case, rows[n]) for n, case in enumerate(fixtures.cases())]


def test_every_case(outcomes):
    wrong = [(name, r.status, r.error_key) for (name, _, status, key, _), r in outcomes if (r.status, r.error_key) != (status, key)]
    assert not wrong
    for (name, _, status, _, keep), r in outcomes:
        if status == "cleaned":
            body = bytes(r.result)
            assert fixtures.SECRET not in body and all(k in body for k in keep), name


def test_cleaning_twice_changes_nothing(spark, outcomes):
    done = [(r.file_id, r.kind, r.result) for _, r in outcomes if r.result]
    again = {r.file_id: r for r in sanitise.clean(spark.createDataFrame(done, "file_id long, kind string, content binary")).collect()}
    assert all(again[i].status == "cleaned" and again[i].result == body for i, _, body in done)


def test_frames_are_numbered_from_zero(outcomes):
    (result,) = (bytes(r.result) for (name, *_), r in outcomes if name == "apng.frames")
    numbers = [int.from_bytes(body[:4], "big") for code, body, *_ in parts.png(result) if code in (b"fcTL", b"fdAT")]
    assert numbers == list(range(5))


def test_dead_coding_tables_are_gone(outcomes):
    (result,) = (bytes(r.result) for (name, *_), r in outcomes if name == "jpeg.dead_tables")
    tables = [b for code, b, *_ in jpeg.jpeg(result) if code in (b"DB", b"C4", b"DRI")]
    assert len(tables) == 4 and not any(bytes([v]) * 64 in result for v in (0x53, 0x45)) and b"\0\7" not in result


def test_tables_of_one_segment_stay_together():
    one, two = fixtures.jpeg_table(0xC4, 0x00, 2)[4:], fixtures.jpeg_table(0xC4, 0x10, 3)[4:]
    n = (5).to_bytes(4, "big")
    assert jpeg.join([(b"C4", n + one), (b"C4", n + two), (b"EOI", b"\xff\xd9")]) == fixtures.jpeg_segment(0xC4, one + two) + b"\xff\xd9"


def test_display_fields_round_trip():
    note = exif.NOTE + b"MM\0\1" + struct.pack(">HHII", 0x21, 10, 1, 32) + bytes(4) + struct.pack(">ii", -7, 5)
    fields = {"turn": 6, "resolution": ((72, 1), (300, 4), 2), "space": 65535, "index": b"R03", "note": note}
    assert exif.display(exif.build(fields)) == fields and exif.display(b"Exif\0\0" + exif.build(fields)) == fields
    for empty in (b"", b"II*\0", b"MM\0*\0\0\0\x08\xff\xff", bytes(40)):
        assert exif.build(exif.display(empty)) == b""
    only = {"turn": None, "resolution": None, "space": None, "index": b"R98", "note": None}
    assert exif.display(exif.build(only)) == only
    for bad in (b"", note[:-1], note.replace(struct.pack(">ii", -7, 5), struct.pack(">ii", 7, 0)), note.replace(b"\0\x21", b"\0\x22"), b"Other" + note):
        assert exif.rendering_note(bad) is None
    long = exif.NOTE + b"II\2\0" + struct.pack("<HHII", 1, 2, 90, 46) + struct.pack("<HHII", 0x21, 10, 1, 136) + bytes(2) + b"S" * 90 + struct.pack("<ii", -7, 5)
    assert exif.rendering_note(long[:136] + struct.pack("<ii", -7, 5)) == note
    assert exif.display(exif.minimal(8))["turn"] == 8 and exif.minimal(1) is None


def test_truncations_never_raise(spark):
    rows = []
    for n, (_, content, *_) in enumerate(fixtures.cases()):
        rows += [(n * 1000 + cut, bytearray(content[:cut])) for cut in range(0, min(len(content), 240), 5)]
    files = spark.createDataFrame(rows, "file_id long, content binary")
    files = files.select("file_id", parts.kind_of(files.content).alias("kind"), "content")
    got = sanitise.clean(files).collect()
    assert len(got) == len(rows) and {r.status for r in got} <= {"cleaned", "refused"}
    assert "verification_failed" not in {r.error_key for r in got}


def test_load_and_publish(spark, tmp_path):
    (tmp_path / "IMG_20240501_123456.PNG").write_bytes(fixtures.png(fixtures.png_chunk(b"tEXt", fixtures.SECRET)))
    (tmp_path / "note.txt").write_bytes(b"hello")
    (tmp_path / "IMG_clean.PNG").write_bytes(b"taken")
    paths = [str(tmp_path / n) for n in ("IMG_20240501_123456.PNG", "note.txt", "missing.png")]
    files = parts.load(spark, paths).cache()
    outcomes = sanitise.clean(files).join(files.select("file_id", "path"), "file_id")
    got = {r.error_key: r for r in publish.publish(outcomes).collect()}
    assert set(got) == {None, "unsupported_format", "not_a_file"}
    assert got[None].published == str(tmp_path / "IMG_clean_1.PNG")
    assert fixtures.SECRET not in (tmp_path / "IMG_clean_1.PNG").read_bytes()
    assert (tmp_path / "IMG_clean.PNG").read_bytes() == b"taken" and os.stat(got[None].published).st_mode == os.stat(tmp_path / "IMG_20240501_123456.PNG").st_mode
    assert not [p for p in os.listdir(tmp_path) if "unfinished" in p]
    assert {(r.status, r.n) for r in publish.summary(outcomes).collect()} == {("cleaned", 1), ("refused", 1)}
    assert sanitise.clean(files.limit(0)).count() == 0


def test_profiles():
    for version in (2, 4):
        own = fixtures.profile(version=version)
        clean = icc.clean_profile(own)
        assert len(clean) == len(own) and fixtures.SECRET not in clean and icc.clean_profile(clean) == clean
        assert {k: v for k, v in icc._tags(clean).items() if k not in icc.ORIGIN} == {k: v for k, v in icc._tags(own).items() if k not in icc.ORIGIN}
        assert clean[48:52] == bytes(4) and clean[80:84] == bytes(4)
    lut = b"mft1" + bytes(4) + b"\x03\x03\x02\0" + bytes(36) + bytes(256 * 3 + 8 * 3 + 256 * 3)
    curve = b"para" + bytes(4) + bytes(4) + b"\0\1\0\0"
    mab = b"mAB " + bytes(4) + b"\x03\x03\0\0" + struct.pack(">5I", 32, 0, 0, 0, 0) + 3 * curve
    for good in ((b"A2B0", lut), (b"A2B0", mab), (b"tech", b"sig " + bytes(4) + b"CRT "), (b"chad", b"sf32" + bytes(40)), (b"cicp", b"cicp" + bytes(8))):
        icc.clean_profile(fixtures.profile(good))
    for bad in ((b"A2B0", lut + b"x"), (b"A2B0", lut[:-1]), (b"A2B0", mab[:-4]), (b"tech", b"sig " + bytes(4) + b"oops"), (b"cicp", b"cicp" + bytes(7) + b"\2"), (b"rTR2", curve), (b"hdgm", b"gmap" + bytes(90))):
        with pytest.raises(icc.BadProfile):
            icc.clean_profile(fixtures.profile(bad))
    with pytest.raises(icc.BadProfile):
        icc.clean_profile(fixtures.profile(room=0)[:-4] + b"")


def test_bitmap_pixels():
    def pixels(data):
        return zlib.decompress(b"".join(body for code, body, *_ in parts.png(bmp.as_png(data)) if code == b"IDAT"))

    rows = bytes(range(9)) + b"..." + bytes(range(9, 18)) + b"..."  # blue, green, red; the lowest row first
    assert pixels(fixtures.bmp(24, rows)) == b"\0" + bytes([11, 10, 9, 14, 13, 12, 17, 16, 15]) + b"\0" + bytes([2, 1, 0, 5, 4, 3, 8, 7, 6])
    assert pixels(fixtures.bmp(1, b"\xa0...\x40...", palette=bytes(8))) == b"\0\0\1\0" + b"\0\1\0\1"
    assert pixels(fixtures.bmp(4, b"\x12\x30..\x01\x20..", palette=bytes(64))) == b"\0\0\1\2" + b"\0\1\2\3"
    runs = b"\2\1\1\0\0\0\0\3\1\0\1\0\0\1"
    assert pixels(fixtures.bmp(8, runs, palette=bytes(8), method=1)) == b"\0\1\0\1" + b"\0\1\1\0"
    assert pixels(fixtures.bmp(16, b"\x00\x7c\xe0\x03\x1f\x00zz" * 2)) == (b"\0" + bytes([255, 0, 0, 0, 255, 0, 0, 0, 255])) * 2


def test_every_refusal_has_a_text(spark, outcomes):
    rows = [(r.kind, r.error_key) for _, r in outcomes]
    table = messages.with_texts(spark.createDataFrame(rows, "kind string, error_key string"))
    assert table.count() == len(rows)
    assert table.filter("(error_key IS NULL) <> (message IS NULL) OR message LIKE '%{%'").isEmpty()


def test_copies_that_show_something_else_are_refused(spark):
    """A serialiser that drops a picture gives a sound file, which cleaning again doesn't change."""
    two = fixtures.gif(fixtures.gif_image())
    three = fixtures.png(animated=3)
    flat = fixtures.jpeg()
    tiff = fixtures.tiff_file(pages=2)
    files = spark.createDataFrame([(1, bytearray(two)), (2, bytearray(three)), (3, bytearray(flat)), (4, bytearray(tiff)), (5, bytearray(fixtures.gif()))], "file_id long, content binary")
    files = files.select("file_id", parts.kind_of(files.content).alias("kind"), "content")

    def one_image(own):
        at = [n for n, (code, _) in enumerate(own) if code == b"image"]
        return sanitise.finish_gif([p for n, p in enumerate(own) if n not in at[1:]])

    def still(own):
        return sanitise.finish_png([p for p in own if p[0] not in (b"acTL", b"fcTL", b"fdAT")])

    def black(own):
        return jpeg.join([(c, b[:-1] + b"\0" if c == b"SOS" else b) for c, b in own])

    def first_page(own):
        return tiff_join([p for p in own if p[0] == b"head" or p[1][:2] == b"\0\0"])

    from tessera.sources.tiff import join as tiff_join

    odd = {**sanitise.FINISH, parts.GIF: one_image, parts.PNG: still, parts.JPEG: black, parts.TIFF: first_page}
    got = {r.file_id: r.error_key for r in sanitise.clean(files, odd).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4), "verification_failed"), 5: None}
    assert {r.error_key for r in sanitise.clean(files).collect()} == {None}
