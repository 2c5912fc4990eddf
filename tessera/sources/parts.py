"""Media files as tables of parts.

A parser yields (part, payload, sound, rewritten, refusal): the part's code, its bytes, whether its checksum holds, what
replaces it in a clean copy where that isn't the payload itself, why it can't be rewritten, and maybe a note. A framing error ends a file's rows with one row whose
``error`` is set; the other parts before it are kept, so that the first error in file order decides.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import exif, icc
from tessera.functions.scalars import unsigned
from tessera.sources import bmp, jpeg, movie, tiff
from tessera.sources.heif import AVIF_BRANDS, FILE_TYPE_BYTES, HEIF_BRANDS

PNG, APNG, GIF, WEBP, JPEG, TIFF, BMP = "PNG", "APNG", "GIF", "WEBP", "JPEG", "TIFF", "BMP"
HEIC, AVIF, MP4, MOV = "HEIC", "AVIF", "MP4", "MOV"
Part = tuple[bytes, bytes, bool, bytes | None, str | None]


class Refused(Exception):
    """A file that can't be cleaned, by the key of its message."""

    def __init__(self, key: str):
        self.key = key
        super().__init__(key)


# Signatures of the formats by offset, the first that fits decides.
SIGNATURES = [(1, b"\x89PNG\r\n\x1a\n", PNG), (1, b"GIF87a", GIF), (1, b"GIF89a", GIF), (1, b"\xff\xd8\xff", JPEG), (1, b"II*\0", TIFF), (1, b"MM\0*", TIFF), (1, b"II+\0", TIFF), (1, b"MM\0+", TIFF), (1, b"BM", BMP)]


def kind_of(content: Column) -> Column:
    """The format of a file by its first bytes, null if unknown; an APNG is told from a PNG by its parts."""
    head = lambda at, n: F.hex(F.substring(content, at, n))
    riff = (head(1, 4) == b"RIFF".hex().upper()) & (head(9, 4) == b"WEBP".hex().upper())
    kind = F.when(riff, WEBP)
    for at, magic, name in SIGNATURES:
        kind = kind.when(head(at, len(magic)) == magic.hex().upper(), name)
    # The file type box names a major brand, then compatible ones, in its first FILE_TYPE_BYTES bytes.
    size = F.coalesce(unsigned(content, 1, 4), F.lit(0))
    last = F.least(size, F.octet_length(content), F.lit(8 + FILE_TYPE_BYTES)).cast("int") - 3
    others = F.when(last >= 17, F.transform(F.sequence(F.lit(17), F.greatest(last, F.lit(17)), F.lit(4)), lambda at: F.substring(content, at, F.lit(4))))
    major = F.substring(content, 9, 4)
    brands = F.concat(F.array(major), F.coalesce(others, F.array().cast("array<binary>")))
    named = lambda names: F.arrays_overlap(brands, F.array(*(F.lit(n.encode()) for n in names)))
    boxed = (head(5, 4) == b"ftyp".hex().upper()) & (F.octet_length(content) >= 16)
    kind = kind.when(boxed & named(AVIF_BRANDS), AVIF).when(boxed & named(HEIF_BRANDS), HEIC)
    kind = kind.when(head(5, 4).isin(*(a.encode().hex().upper() for a in movie.OLD_ATOMS)) | boxed & (major == F.lit(b"qt  ")), MOV)
    return kind.when(boxed & named((*movie.BRANDS, *movie.MAKERS)), MP4)


def _profile(rewrite: Callable[[], bytes]) -> tuple[bytes | None, str | None]:
    """What ``rewrite`` makes, or the key why it can't."""
    try:
        return rewrite(), None
    except icc.BadProfile:
        return None, "unsupported_profile"
    except Refused as refused:
        return None, refused.key


def _inflated(body: bytes) -> bytes:
    """The profile of an iCCP chunk: a name of 1 to 79 bytes, a zero, method 0, one zlib stream and nothing behind it."""
    name, separator, packed = body.partition(b"\0")
    stream = zlib.decompressobj()
    try:
        profile = stream.decompress(packed[1:], icc.LARGEST + 1)
    except zlib.error:
        raise Refused("damaged") from None
    if not separator or not 1 <= len(name) <= 79 or packed[:1] != b"\0" or len(profile) > icc.LARGEST or not stream.eof or stream.unused_data:
        raise Refused("damaged")
    return profile


def png(data: bytes) -> Iterator[Part]:
    at = 8
    while True:
        size = int.from_bytes(data[at : at + 4], "big")
        code, end = data[at + 4 : at + 8], at + 12 + size
        if at + 12 > len(data) or end > len(data) or not code.isalpha():
            raise Refused("damaged")
        body = data[at + 8 : end - 4]
        rewritten, refusal = exif.minimal(exif.orientation(body)) if code == b"eXIf" else None, None
        if code == b"iCCP":
            rewritten, refusal = _profile(lambda own=body: b"Clean\0\0" + zlib.compress(icc.clean_profile(_inflated(own))))
        yield code, body, zlib.crc32(code + body) == int.from_bytes(data[end - 4 : end], "big"), rewritten, refusal
        if code == b"IEND":
            return
        at = end


def riff(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
    """Chunks of a range; the pad byte of the last one may be missing."""
    while at < end:
        if end - at < 8:
            raise Refused("damaged")
        code, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > end:
            raise Refused("damaged")
        yield code, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def riff_chunk(code: bytes, body: bytes) -> bytes:
    return code + len(body).to_bytes(4, "little") + body + bytes(len(body) % 2)


def shown_image(parts: list[tuple[bytes, bytes]]) -> list[int]:
    """Positions of the first image and of the first alpha data before it; alpha alone if there is no image."""
    image = next((n for n, (code, _) in enumerate(parts) if code in (b"VP8 ", b"VP8L")), len(parts))
    alpha = next((n for n in range(image) if parts[n][0] == b"ALPH"), None)
    return [n for n in (alpha, image) if n is not None and n < len(parts)]


def webp(data: bytes) -> Iterator[Part]:
    if len(data) < 20 or int.from_bytes(data[4:8], "little") + 8 > len(data):
        raise Refused("damaged")
    for code, body in riff(data, 12, 8 + int.from_bytes(data[4:8], "little")):
        rewritten, refusal = None, None
        if code == b"ICCP":
            rewritten, refusal = _profile(lambda own=body: icc.clean_profile(own))
        elif code == b"ANMF":
            if len(body) < 16:
                raise Refused("damaged")
            inner = list(riff(body, 16, len(body)))
            own = [inner[n] for n in shown_image(inner)]
            if not own or own[-1][0] == b"ALPH":
                raise Refused("damaged")
            # Of the last header byte only blending and disposal mean anything.
            rewritten = body[:15] + bytes([body[15] & 3]) + b"".join(riff_chunk(*c) for c in own)
        elif code == b"EXIF":
            rewritten = exif.minimal(exif.orientation(body))
        yield code, body, True, rewritten, refusal


def _colors(flags: int) -> int:
    return 3 * 2 ** (flags % 8 + 1) if flags >> 7 else 0


def _blocks(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Sub-blocks from ``at`` and where they end."""
    out = []
    while True:
        if at >= len(data):
            raise Refused("damaged")
        size = data[at]
        if not size:
            return out, at + 1
        if at + 1 + size > len(data):
            raise Refused("damaged")
        out.append(data[at + 1 : at + 1 + size])
        at += 1 + size


def _cut(body: bytes) -> bytes:
    return b"".join(bytes([len(p)]) + p for p in (body[n : n + 255] for n in range(0, len(body), 255))) + b"\0"


# Applications whose extension holds a loop count, and the one that holds a profile.
LOOPS, PROFILE = (b"NETSCAPE2.0", b"ANIMEXTS1.0"), b"ICCRGBG1012"


def gif(data: bytes) -> Iterator[Part]:
    """Parts: header, image, control, comment and other extensions by label, trailer; application extensions by their name."""
    at = 13 + _colors(data[10]) if len(data) >= 13 else len(data) + 1
    if at > len(data):
        raise Refused("damaged")
    yield b"header", data[:at], True, None, None
    while at < len(data) and data[at] != 0x3B:
        start = at
        if data[at] == 0x2C and at + 10 < len(data):
            code_size = at + 10 + _colors(data[at + 9])
            pieces, at = _blocks(data, code_size + 1)
            flags = data[start + 9] & 0xE7  # without the reserved bits
            yield b"image", data[start:at], True, data[start : start + 9] + bytes([flags]) + data[start + 10 : code_size + 1] + _cut(b"".join(pieces)), None
        elif data[at] == 0x21 and at + 1 < len(data):
            label = data[at + 1]
            pieces, at = _blocks(data, at + 2)
            body = data[start:at]
            if label == 0xF9:
                if [len(p) for p in pieces] != [4]:
                    raise Refused("damaged")
                yield b"control", body, True, body[:3] + bytes([body[3] & 0x1F]) + body[4:], None
            elif label == 0xFF:
                if not pieces or len(pieces[0]) != 11:
                    raise Refused("damaged")
                if pieces[0] == PROFILE:
                    rewritten, refusal = _profile(lambda own=pieces: b"\x21\xff\x0b" + PROFILE + _cut(icc.clean_profile(b"".join(own[1:]))))
                    yield PROFILE, body, True, rewritten, refusal
                    continue
                loop = next((p for p in pieces[1:] if len(p) == 3 and p[0] == 1), None)
                kept = pieces[0] in LOOPS and loop is not None
                yield pieces[0], body, True, b"\x21\xff\x0b" + pieces[0] + b"\x03" + loop + b"\0" if kept else None, None
            else:
                yield b"label%d" % label, body, True, None, None
        else:
            raise Refused("damaged")
    yield b"trailer", b"\x3b", True, None, None


PARSERS: dict[str, Callable[[bytes], Iterator[Part]]] = {PNG: png, GIF: gif, WEBP: webp, JPEG: jpeg.jpeg, TIFF: tiff.tiff}
SCHEMA = "file_id long, kind string, ord int, part binary, payload binary, sound boolean, rewritten binary, rewriting string, note string, error string"


def parts(files: DataFrame) -> DataFrame:
    """A row per part of each file (``file_id, kind, content``) whose kind has a parser, in Arrow batches.

    A file without any part is damaged: every such file has a row, and outcomes rest on that.
    """

    def walk(batches):
        for batch in batches:
            for file_id, kind, content in zip(*(batch.column(c) for c in ("file_id", "kind", "content")), strict=True):
                rows, kind, data = [], kind.as_py(), content.as_py()
                try:
                    if kind == BMP:  # saved as a PNG, which is then cleaned
                        kind, data = PNG, bmp.as_png(data)
                    for n, part in enumerate(PARSERS[kind](data)):
                        rows.append((n, *part, *[None] * (7 - len(part))))
                    if not rows:
                        raise Refused("damaged")
                except (Refused, jpeg.Broken) as refused:
                    rows.append((len(rows), b"", b"", False, None, None, None, refused.key))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.binary(), pa.string(), pa.string(), pa.string()]
                head = [pa.array([file_id.as_py()] * len(rows), pa.int64()), pa.array([kind] * len(rows), pa.string())]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [f.split()[0] for f in SCHEMA.split(", ")])

    own = files.filter(F.col("kind").isin(BMP, *PARSERS) & F.col("content").isNotNull())
    return own.select("file_id", "kind", "content").mapInArrow(walk, SCHEMA)


def load(spark, paths: list[str]) -> DataFrame:
    """``file_id, path, length, kind, content`` of files, and rows without content for paths that are no file.

    ``file_id`` is a hash of the path; the result can be joined to the list it came from.
    """
    import os

    wanted = spark.createDataFrame([(os.path.abspath(os.path.expanduser(p)),) for p in paths], "path string").distinct()
    found = [p for p in {os.path.abspath(os.path.expanduser(p)) for p in paths} if os.path.isfile(p)]
    if found:
        read = spark.read.format("binaryFile").load(found).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "length", "content")
    else:
        read = spark.createDataFrame([], "path string, length long, content binary")
    files = wanted.join(read, "path", "left")
    return files.select(F.xxhash64("path").alias("file_id"), "path", "length", kind_of(F.col("content")).alias("kind"), "content")
