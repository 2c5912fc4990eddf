"""Boxes and item tables of ISO base media files."""

import struct

import pytest

from tessera.sources import bmff, parts


def box(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def heif(items=((1, b"hvc1"), (2, b"Exif"), (3, b"hvc1")), refs=((b"cdsc", 2, [1]), (b"auxl", 3, [1])), primary=1, spans=None, brand=b"heic"):
    head = box(b"ftyp", brand + bytes(4) + b"mif1")
    spans = spans if spans is not None else {i: (n * 4, 4) for n, (i, _) in enumerate(items)}
    for offset in (0, 500):  # media data at a fixed place
        infe = b"".join(box(b"infe", b"\2\0\0\0" + struct.pack(">HH", i, 0) + kind + b"\0") for i, kind in items)
        iloc = b"\1\0\0\0\x44\0" + struct.pack(">H", len(spans)) + b"".join(struct.pack(">HHHHII", i, 0, 0, 1, offset + a, n) for i, (a, n) in spans.items())
        iref = b"\0\0\0\0" + b"".join(box(k, struct.pack(f">HH{len(t)}H", o, len(t), *t)) for k, o, t in refs)
        meta = box(b"meta", bytes(4) + box(b"pitm", bytes(4) + struct.pack(">H", primary)) + box(b"iinf", bytes(4) + struct.pack(">H", len(items)) + infe) + box(b"iloc", iloc) + box(b"iref", iref))
    pad = box(b"free", bytes(500 - len(head) - len(meta) - 16))
    return head + meta + pad + box(b"mdat", bytes(40))


CASES = [
    (heif(), None), (heif(refs=[(b"dimg", 1, [9])]), "damaged"), (heif(primary=7), "damaged"), (heif(items=((1, b"hvc1"), (1, b"hvc1"))), "damaged"),
    (heif(spans={1: (0, 4), 2: (4, 0), 3: (8, 4)}), None), (heif(spans={1: (0, 0), 2: (4, 4), 3: (8, 4)}), "damaged"), (heif(spans={1: (0, 6), 2: (4, 4), 3: (8, 4)}), "unsupported_part"),
    (heif(spans={1: (0, 4), 2: (4, 4)}), "damaged"), (heif(spans={1: (0, 4), 2: (0, 4), 3: (0, 4)}), None), (heif(spans={1: (0, 9999), 2: (4, 4), 3: (8, 4)}), "damaged"), (heif()[:90], "damaged"),
]


@pytest.fixture(scope="module")
def laid(spark):
    files = spark.createDataFrame([(n, bytearray(c)) for n, (c, _) in enumerate(CASES)], "file_id long, content binary")
    files = files.select("file_id", parts.kind_of(files.content).alias("kind"), "content")
    assert {r.kind for r in files.collect()} == {"HEIC"}
    return bmff.layouts(files).cache()


def test_refusals(laid):
    got = {r.file_id: r.refusal for r in bmff.refusals(laid).collect()}
    assert {n: got.get(n) for n in range(len(CASES))} == {n: want for n, (_, want) in enumerate(CASES)}


def test_built_from(laid):
    got = {(r.file_id, r.item_id) for r in bmff.built_from(laid.filter("file_id = 0")).collect()}
    assert got == {(0, 1), (0, 2), (0, 3)}


def test_boxes(spark):
    movie = box(b"ftyp", b"isom" + bytes(4)) + box(b"moov", box(b"mvhd", bytes(8)) + box(b"trak", box(b"tkhd", bytes(4)))) + struct.pack(">I4sQ", 1, b"mdat", 20) + bytes(4) + struct.pack(">I4s", 0, b"free") + bytes(3)
    table = spark.createDataFrame([(1, bytearray(movie)), (2, bytearray(movie[:-30])), (3, bytearray()), (4, None)], "file_id long, content binary")
    rows = bmff.boxes(table).orderBy("file_id", "ord").collect()
    assert [(r.box, r.parent, r.depth) for r in rows if r.file_id == 1] == [("ftyp", None, 0), ("moov", None, 0), ("mvhd", 1, 1), ("trak", 1, 1), ("tkhd", 3, 2), ("mdat", None, 0), ("free", None, 0)]
    assert [r.error for r in rows if r.file_id == 2][-1] == "damaged" and not [r for r in rows if r.file_id > 2]
    changed = bmff.box_changes(bmff.boxes(table.filter("file_id = 1")), bmff.boxes(table.filter("file_id = 1")).filter("box <> 'free'"))
    assert [(r.box, r.change, r.n) for r in changed.collect()] == [("free", "added", 1)]
