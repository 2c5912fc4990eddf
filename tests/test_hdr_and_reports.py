"""Rendering values, the tag report and damaged files in numbers."""

import struct

import pytest
from pyspark.sql import functions as F

from tessera.functions import hdr
from tessera.operators import tag_report
from tessera.plans import sanitise
from tessera.sources import fuzz

NUMBERS = [("1.50", "1.5"), ("+007", "7"), ("-0.0", "0.0"), ("1e-7", "0.0000001"), (" 2 ", "2"), (".5", "0.5"), ("1E3", "1000.0")]
ODD = ["", "1_000", "٣", "nan", "1e13", "1e-13", "0x1", "1" * 41, "1,5", "--1"]


def test_numbers(spark):
    for text, want in NUMBERS:
        assert hdr.plain_number(text) and hdr.canonical(text) == want
    assert not any(map(hdr.plain_number, ODD))
    table = spark.createDataFrame([(t,) for t, _ in NUMBERS] + [(t,) for t in ODD], "t string")
    got = {r.t: r.ok for r in table.select("t", F.coalesce(hdr.is_plain_number(F.col("t")), F.lit(False)).alias("ok")).collect()}
    assert got == {**{t: True for t, _ in NUMBERS}, **{t: False for t in ODD}}


def test_rendering_fields():
    text = f"""<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{hdr.RDF}"><rdf:Description xmlns:hdrgm="{hdr.ADOBE}" xmlns:dc="http://purl.org/dc/elements/1.1/"
      hdrgm:Version="1.0" hdrgm:Gamma="2.50" hdrgm:BaseRenditionIsHDR="False" dc:creator="SECRET" hdrgm:GainMapMin="SECRET">
      <hdrgm:GainMapMax><rdf:Seq><rdf:li>1</rdf:li><rdf:li>2.0</rdf:li><rdf:li>3e0</rdf:li></rdf:Seq></hdrgm:GainMapMax><hdrgm:Gamma>9</hdrgm:Gamma></rdf:Description></rdf:RDF></x:xmpmeta>"""
    fields = hdr.rendering_fields(text.encode() + b"\0\n")
    assert {(name, str(value)) for _, name, value in fields} == {("Version", "1.0"), ("Gamma", "2.5"), ("BaseRenditionIsHDR", "False"), ("GainMapMax", "['1', '2.0', '3.0']")}
    again = hdr.packet(fields)
    assert b"SECRET" not in again and sorted(hdr.rendering_fields(again), key=str) == sorted(fields, key=str)
    assert hdr.packet([]) == b"" and hdr.rendering_fields(b"") == []
    for bad in (b"<a", b"<!DOCTYPE a><a/>"):
        with pytest.raises(hdr.BadPacket):
            hdr.rendering_fields(bad)


def test_gain_map_bytes(spark):
    one, zero = struct.pack(">II", 1, 2) * 7, struct.pack(">II", 1, 0) * 7
    cases = [
        (b"\0\0\0\0", 4), (b"\0\1\0\0", None), (b"\0\0", None), (b"\0\0\0\0\0" + one, 61), (b"\0\0\0\0\0" + one + b"more", 61), (b"\0\0\0\0\0" + zero, None),
        (b"\0\0\0\0\0" + one[:-1], None), (b"\0\0\0\0\x80" + struct.pack(">II", 1, 2) * 17, 141), (b"\0\0\0\0\x08" + bytes(3) + b"\1" + bytes(28), 37), (b"\0\0\0\0\x08" + bytes(32), None),
    ]
    table = spark.createDataFrame([(n, bytearray(b)) for n, (b, _) in enumerate(cases)], "n int, b binary")
    got = dict(table.select("n", hdr.gain_map_bytes(F.col("b")), ).collect())
    assert got == {n: want for n, (_, want) in enumerate(cases)}
    assert table.filter("n = 0").select(hdr.gain_map_bytes(F.col("b"), True)).first()[0] is None


def test_tag_report(spark):
    kept = [("EXIF:IFD0:Orientation", ["6"]), ("File:System:FileModifyDate", ["x"]), ("XMP:XMP-hdrgm:Gamma", ["2.5"]), ("XMP:XMP-hdrgm:GainMapMax", ["1", "2", "3"]), ("QuickTime:Track1:CreateDate", ["0000:00:00 00:00:00"]), ("MakerNotes:Apple:HDRGain", ["0.1"]), ("QuickTime:Unknown_edts", ["b"]), ("File:FileType", ["JPEG"]), ("XMP:XMP-hdrgm:BaseRenditionIsHDR", ["True"])]
    private = [("EXIF:IFD0:Model", ["x"]), ("XMP:XMP-dc:Creator", ["x"]), ("XMP:XMP-hdrgm:Gamma", ["secret"]), ("QuickTime:GPSCoordinates", ["1"]), ("PNG:Comment", ["x"]), ("MakerNotes:Canon:Model", ["1"]), ("QuickTime:Unknown_zzzz", ["b"]), ("EXIF:IFD0:ImageWidth", ["3"]), ("RIFF:Foo_0x00ff", ["1"])]
    report = spark.createDataFrame([(1, "JPEG", k, v) for k, v in kept + private] + [(2, "TIFF", "EXIF:IFD0:ImageWidth", ["3"]), (2, "TIFF", "PNG:Comment", None)], "file_id int, kind string, key string, values array<string>")
    got = sorted((r.key, *r["values"]) for r in tag_report.remaining(report, ["Unknown_edts"]).collect())
    assert got == sorted((k, *v) for k, v in private)


def test_damaged_files_never_raise(spark):
    table = fuzz.files(spark, 900, seed=4)  # more kinds of files than before, so more files
    got = sanitise.clean(table).collect()
    assert len(got) == 900 and {r.status for r in got} <= {"cleaned", "refused"}
    assert "verification_failed" not in {r.error_key for r in got}
    assert sum(r.status == "cleaned" for r in got) > 30
    assert fuzz.files(spark, 5, 1).collect() == fuzz.files(spark, 5, 1).collect() != fuzz.files(spark, 5, 2).collect()
