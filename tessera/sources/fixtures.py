"""Small media files made from scratch, each with what a clean copy must lose and keep."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import exif

SECRET = b"SECRET-7f3a"


def png_chunk(code: bytes, body: bytes, sound: bool = True) -> bytes:
    return len(body).to_bytes(4, "big") + code + body + ((zlib.crc32(code + body) + (not sound)) & 0xFFFFFFFF).to_bytes(4, "big")


def png(*extra: bytes, after: tuple[bytes, ...] = (), color: int = 2, size: tuple[int, int] = (3, 2), lines: bytes | None = None, animated: int = 0, tail: bytes = b"") -> bytes:
    """A PNG with chunks before and after its image data."""
    width, height = size
    samples = {0: 1, 2: 3, 3: 1, 6: 4}[color]
    plain = lines if lines is not None else b"".join(b"\0" + bytes(width * samples) for _ in range(height))
    body = zlib.compress(plain)
    frames = b""
    for n in range(animated):
        control = struct.pack(">IIIIIHHBB", 7 * n + 5, width, height, 0, 0, 1, 10, 0, 0)
        frames += png_chunk(b"fcTL", control) + (png_chunk(b"fdAT", b"\0\0\0\x63" + body) if n else png_chunk(b"IDAT", body[:5]) + png_chunk(b"IDAT", body[5:]))
    image = frames or png_chunk(b"IDAT", body[:4]) + png_chunk(b"IDAT", body[4:])
    header = png_chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0))
    head = png_chunk(b"acTL", struct.pack(">II", animated, 0)) if animated else b""
    return b"\x89PNG\r\n\x1a\n" + header + head + b"".join(extra) + image + b"".join(after) + png_chunk(b"IEND", b"") + tail


def tiff(turn: int) -> bytes:
    """An EXIF block with an orientation, a description and its text."""
    return struct.pack("<2sHIH", b"II", 42, 8, 2) + struct.pack("<HHII", 0x0112, 3, 1, turn) + struct.pack("<HHII", 0x010E, 2, len(SECRET), 38) + bytes(4) + SECRET


def gif(*blocks: bytes, trailer: bytes = b"\x3b") -> bytes:
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80, 0, 0) + bytes(6)
    return head + b"".join(blocks) + gif_image() + trailer


def gif_image(reserved: int = 0x18, pieces: tuple[bytes, ...] = (b"\x84", b"\x51\x01")) -> bytes:
    return b"\x2c" + struct.pack("<HHHHB", 0, 0, 2, 2, reserved) + b"\x02" + b"".join(bytes([len(p)]) + p for p in pieces) + b"\0"


def gif_extension(label: int, *pieces: bytes) -> bytes:
    return bytes([0x21, label]) + b"".join(bytes([len(p)]) + p for p in pieces) + b"\0"


def webp(*chunks: tuple[bytes, bytes], tail: bytes = b"") -> bytes:
    body = b"WEBP" + b"".join(c + len(b).to_bytes(4, "little") + b + bytes(len(b) % 2) for c, b in chunks)
    return b"RIFF" + len(body).to_bytes(4, "little") + body + tail


def vp8x(flags: int, width: int = 2, height: int = 2) -> tuple[bytes, bytes]:
    return b"VP8X", bytes([flags, 0xFF, 0, 0]) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")


def profile(*extra: tuple[bytes, bytes], version: int = 4, room: int = 200, maker: bytes = SECRET[:4]) -> bytes:
    """A small RGB display profile with a description that must go."""
    xyz, curve = b"XYZ " + bytes(4) + bytes(12), b"curv" + bytes(4) + (1).to_bytes(4, "big") + b"\x02\x33" + bytes(2)
    tags = [(b"desc", b"desc" + bytes(4) + SECRET), (b"rXYZ", xyz), (b"gXYZ", xyz), (b"bXYZ", xyz), (b"rTRC", curve), (b"gTRC", curve), (b"bTRC", curve), *extra]
    at, table, body = 132 + 12 * len(tags), b"", b""
    places: dict[bytes, int] = {}
    for name, own in tags:
        if own not in places:
            places[own] = at + len(body)
            body += own + bytes(-len(own) % 4)
        table += struct.pack(">4sII", name, places[own], len(own))
    head = bytearray(128)
    head[8], head[12:24], head[36:40], head[48:52], head[80:84] = version, b"mntrRGB XYZ ", b"acsp", maker, maker
    struct.pack_into(">3i", head, 68, 0xF6D6, 0x10000, 0xD32D)
    whole = bytes(head) + len(tags).to_bytes(4, "big") + table + body + bytes(room)
    return len(whole).to_bytes(4, "big") + whole[4:]


def iccp(own: bytes) -> bytes:
    return png_chunk(b"iCCP", SECRET + b"\0\0" + zlib.compress(own))


def jpeg_segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def jpeg_table(marker: int, slot: int, fill: int) -> bytes:
    """A quantisation table of one value, or a Huffman table of one code."""
    return jpeg_segment(marker, bytes([slot]) + (bytes([fill]) * 64 if marker == 0xDB else b"\1" + bytes(15) + bytes([fill])))


def jpeg(*head: bytes, middle: tuple[bytes, ...] = (), scan: bytes = b"\x12\xff\0\x34", frame: int = 0xC0, height: int = 8, tail: bytes = b"", scan_tail: bytes = b"\0\x3f\0") -> bytes:
    """A gray JPEG with segments before its frame and between its tables and its scan."""
    coding = jpeg_table(0xDB, 0, 1) + jpeg_segment(frame, b"\x08" + height.to_bytes(2, "big") + b"\0\x08\1\1\x11\0") + jpeg_table(0xC4, 0x00, 2) + jpeg_table(0xC4, 0x10, 3)
    return b"\xff\xd8" + b"".join(head) + coding + b"".join(middle) + jpeg_segment(0xDA, b"\1\1\0" + scan_tail) + scan + tail + b"\xff\xd9"


def tiff_file(*extra: tuple[int, int, bytes], order: str = "<", pages: int = 1, block: bytes = bytes(6), strips: int = 1, tail: bytes = b"", loop: bool = False) -> bytes:
    """Gray pages of 3 by 2 pixels in strips, with more tags of (number, type, value)."""
    out, link = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), 4
    first = None
    for _ in range(pages):
        at = len(out)
        out += block + bytes(len(block) % 2)
        h = lambda v: struct.pack(order + "H", v)
        tags = {256: (3, h(3)), 257: (3, h(2)), 258: (3, h(8)), 259: (3, h(1)), 262: (3, h(1)), 277: (3, h(1)), 278: (3, h(2 // strips))}
        tags[273] = (4, struct.pack(f"{order}{strips}I", *(at + n * (len(block) // strips) for n in range(strips))))
        tags[279] = (4, struct.pack(f"{order}{strips}I", *[len(block) // strips] * strips))
        tags |= {n: (kind, body) for n, kind, body in extra}
        struct.pack_into(order + "I", out, link, len(out))
        first = first or len(out)
        link = len(out) + 2 + 12 * len(tags)
        table, behind = h(len(tags)), b""
        sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1}
        for n, (kind, body) in sorted(tags.items()):
            table += struct.pack(order + "HHI", n, kind, len(body) // sizes[kind])
            table += struct.pack(order + "I", link + 4 + len(behind)) if len(body) > 4 else body.ljust(4, b"\0")
            behind += body if len(body) > 4 else b""
        out += table + bytes(4) + behind + bytes(len(behind) % 2)
    if loop:
        struct.pack_into(order + "I", out, link, first)
    return bytes(out) + tail


def bmp(depth: int, rows: bytes, palette: bytes = b"", method: int = 0, width: int = 3, height: int = 2, header: int = 40, more: bytes = b"", tail: bytes = SECRET) -> bytes:
    """A BMP whose rows are given as stored."""
    info = struct.pack("<IiiHHIIiiII", header, width, height, 1, depth, method, len(rows), 2835, 2835, len(palette) // 4, 0) + more
    offset = 14 + len(info) + len(palette)
    return b"BM" + struct.pack("<IHHI", offset + len(rows), 0x5345, 0x4352, offset) + info + palette + rows + tail


def pictures(*others: tuple[int, bytes], head: tuple[bytes, ...] = (), flags: int = 0x20030000, dependent: int = 2, tail: bytes = b"") -> bytes:
    """A multi-picture file: a first image whose index lists images of these types behind it."""
    n = len(others) + 1
    fields = struct.pack(">HHI4s", 0xB000, 7, 4, b"0100") + struct.pack(">HHII", 0xB001, 4, 1, n) + struct.pack(">HHII", 0xB002, 7, 16 * n, 50)
    first = jpeg(jpeg_segment(0xE2, b"MPF\0MM\0*\0\0\0\x08\0\3" + fields + bytes(4 + 16 * n)), *head)
    at, rows = len(first), struct.pack(">IIIHH", flags, len(first), 0, dependent, 0)
    for kind, image in others:
        rows += struct.pack(">IIIHH", kind, len(image), at - 10, 0, 0)
        at += len(image)
    return first.replace(bytes(4 + 16 * n), bytes(4) + rows, 1) + b"".join(image for _, image in others) + tail


XMP = b'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:hdrgm="http://ns.adobe.com/hdr-gain-map/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" dc:creator="%s" hdrgm:Gamma="2.50"/></rdf:RDF></x:xmpmeta>' % SECRET


GAIN_MAP = b"urn:iso:std:iso:ts:21496:-1\0" + struct.pack(">HHB", 0, 0, 0x40) + b"".join(struct.pack(">II", n, 1_000_000) for n in range(7))


def extended() -> list[bytes]:
    """Segments of a packet that names an extended one, and of that one in two pieces."""
    guid, more = b"0123456789ABCDEF0123456789abcdef", XMP.replace(b'hdrgm:Gamma="2.50"', b'hdrgm:Gamma="9" hdrgm:GainMapMax="3.0"')
    main = XMP.replace(b"<rdf:Description ", b'<rdf:Description xmlns:n="http://ns.adobe.com/xmp/note/" n:HasExtendedXMP="' + guid + b'" ')
    piece = lambda a, b: jpeg_segment(0xE1, b"http://ns.adobe.com/xmp/extension/\0" + guid + struct.pack(">II", len(more), a) + more[a:b])
    return [jpeg_segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + main), piece(0, 100), piece(100, len(more))]


def _note() -> bytes:
    """A maker note with a headroom and a text."""
    return exif.NOTE + b"MM\0\2" + struct.pack(">HHII", 1, 2, len(SECRET), 52) + struct.pack(">HHII", 0x21, 10, 1, 44) + bytes(4) + struct.pack(">ii", 7, 5) + SECRET


def cases() -> list[tuple[str, bytes, str, str | None, list[bytes]]]:
    """(name, content, expected status, expected key, byte strings that must survive)."""
    from tessera.sources import boxed, films  # which build on this module

    text, private, gama = png_chunk(b"tEXt", b"Comment\0" + SECRET), png_chunk(b"prVt", SECRET), png_chunk(b"gAMA", b"\0\0\xb1\x8f")
    control, loop = gif_extension(0xF9, b"\xe5\x0a\0\0"), gif_extension(0xFF, b"NETSCAPE2.0", b"\x01\0\0", SECRET)
    image, frame = (b"VP8L", b"\x2f" + b"pixels"), struct.pack("<HBHBHBHBHBB", *[0] * 10, 0xFF)
    inner = b"".join(c + len(b).to_bytes(4, "little") + b + bytes(len(b) % 2) for c, b in [image, (b"junk", SECRET)])
    return [
        ("png.plain", png(), "cleaned", None, []),
        ("png.text_and_private", png(text, private, gama, after=(text,), tail=SECRET), "cleaned", None, [gama]),
        ("png.late_and_repeated", png(gama, gama, after=(gama, png_chunk(b"pHYs", bytes(8) + b"\x07"))), "cleaned", None, [gama]),
        ("png.orientation", png(png_chunk(b"eXIf", tiff(6))), "cleaned", None, [b"eXIf"]),
        ("png.upright", png(png_chunk(b"eXIf", tiff(1))), "cleaned", None, []),
        ("png.dropped_chunk_corrupt", png(png_chunk(b"tEXt", SECRET, sound=False)), "cleaned", None, []),
        ("png.kept_chunk_corrupt", png(png_chunk(b"gAMA", bytes(4), sound=False)), "refused", "damaged", []),
        ("png.unknown_critical", png(png_chunk(b"CrIT", SECRET)), "refused", "unsupported_part", []),
        ("png.hidden_in_image_data", png(lines=bytes(20) + SECRET), "refused", "extra_image_data", []),
        ("png.short_image_data", png(lines=bytes(19)), "refused", "damaged", []),
        ("png.wrong_size", png(png_chunk(b"gAMA", SECRET)), "refused", "damaged", []),
        ("png.palette_suggestion", png(png_chunk(b"PLTE", SECRET + b"x")), "cleaned", None, []),
        ("png.palette", png(png_chunk(b"PLTE", bytes(6)), png_chunk(b"tRNS", b"\x01"), color=3), "cleaned", None, [b"PLTE", b"tRNS"]),
        ("png.no_palette", png(color=3), "refused", "damaged", []),
        ("png.truncated", png()[:-8], "refused", "damaged", []),
        ("png.huge", png(size=(20000, 20000), lines=b""), "refused", "too_large", []),
        ("png.profile", png(png_chunk(b"iCCP", b"x\0\0" + zlib.compress(SECRET))), "refused", "unsupported_profile", []),
        ("png.clean_profile", png(iccp(profile())), "cleaned", None, [b"iCCP"]),
        ("png.profile_v2", png(iccp(profile(version=2))), "cleaned", None, [b"iCCP"]),
        ("png.profile_unknown_tag", png(iccp(profile((b"zzzz", b"text" + bytes(4) + SECRET)))), "refused", "unsupported_profile", []),
        ("png.profile_hidden_in_curve", png(iccp(profile((b"kTRC", b"curv" + bytes(8) + SECRET)))), "refused", "unsupported_profile", []),
        ("png.profile_not_packed", png(png_chunk(b"iCCP", SECRET)), "refused", "damaged", []),
        ("png.second_profile_broken", png(iccp(profile()), png_chunk(b"iCCP", SECRET)), "cleaned", None, [b"iCCP"]),
        ("gif.profile", gif(gif_extension(0xFF, b"ICCRGBG1012", *(profile()[n : n + 255] for n in range(0, len(profile()), 255)))), "cleaned", None, [b"ICCRGBG1012"]),
        ("webp.profile", webp(vp8x(0x2C), (b"ICCP", profile()), image, (b"ICCP", SECRET)), "cleaned", None, [b"ICCP", image[1]]),
        ("apng.frames", png(text, animated=3), "cleaned", None, [b"acTL", b"fdAT"]),
        ("apng.stray_frames", png(after=(png_chunk(b"fdAT", SECRET),)), "cleaned", None, []),
        ("gif.plain", gif(), "cleaned", None, []),
        ("gif.comments", gif(gif_extension(0xFE, SECRET), gif_extension(0x01, bytes(12), SECRET), gif_extension(0xFF, b"XMP DataXMP", SECRET)), "cleaned", None, []),
        ("gif.controls", gif(gif_extension(0xF9, b"\x00\x63\0\0"), control, loop, loop), "cleaned", None, [gif_extension(0xF9, b"\x05\x0a\0\0"), b"NETSCAPE2.0\x03\x01\0\0\0"]),
        ("gif.no_trailer", gif(trailer=b""), "cleaned", None, []),
        ("gif.after_trailer", gif(trailer=b"\x3b" + SECRET), "cleaned", None, []),
        ("gif.odd_control", gif(gif_extension(0xF9, SECRET)), "refused", "damaged", []),
        ("gif.many_comments", gif(*[gif_extension(0xFE, b"x")] * 1100), "refused", "unsupported_part", []),
        ("gif.truncated", gif()[:-3], "refused", "damaged", []),
        ("webp.simple", webp(image, (b"EXIF", tiff(6)), (b"junk", SECRET), tail=SECRET), "cleaned", None, [image[1]]),
        ("webp.extended", webp(vp8x(0xFF), (b"ALPH", b"alpha"), image, (b"VP8L", SECRET), (b"XMP ", SECRET), (b"EXIF", tiff(8))), "cleaned", None, [b"alpha", image[1], b"EXIF"]),
        ("webp.header_not_needed", webp(vp8x(0x0C), image, (b"XMP ", SECRET), (b"EXIF", tiff(1))), "cleaned", None, [image[1]]),
        ("webp.animation", webp(vp8x(0x02), (b"ANIM", bytes(6)), (b"ANIM", SECRET), (b"ANMF", frame + inner)), "cleaned", None, [b"ANIM", b"ANMF", image[1]]),
        ("webp.no_image", webp(vp8x(0), (b"XMP ", SECRET)), "refused", "damaged", []),
        ("webp.huge_animation", webp(vp8x(2, 9000, 9000), (b"ANIM", bytes(6)), (b"ANMF", frame + inner)), "refused", "too_large", []),
        ("jpeg.plain", jpeg(), "cleaned", None, []),
        ("jpeg.private_segments", jpeg(jpeg_segment(0xE0, b"JFIF\0\1\2\1\0\x48\0\x48\1\1" + SECRET[:3]), jpeg_segment(0xED, SECRET), jpeg_segment(0xFE, SECRET), jpeg_segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0<a>" + SECRET + b"</a>"), jpeg_segment(0xEE, b"Adobe\0\x64\0\0\0\0\0")) + SECRET, "cleaned", None, [b"JFIF\0\1\2\1\0\x48\0\x48\0\0", b"Adobe\0\x64"]),
        ("jpeg.orientation", jpeg(jpeg_segment(0xE1, b"Exif\0\0" + tiff(6)), jpeg_segment(0xE1, b"Exif\0\0" + tiff(3))), "cleaned", None, [b"Exif\0\0MM\0*"]),
        ("jpeg.rendering_fields", jpeg(jpeg_segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + XMP), jpeg_segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + XMP.replace(b"2.50", b"3.0"))), "cleaned", None, [b'hdrgm:Gamma="2.5"']),
        ("jpeg.dead_tables", jpeg(jpeg_table(0xDB, 0, 0x53), jpeg_table(0xDB, 1, 0x45), middle=(jpeg_segment(0xDD, b"\0\7"), jpeg_segment(0xDD, b"\0\5"), jpeg_table(0xC4, 0x13, 0x46))), "cleaned", None, [jpeg_table(0xDB, 0, 1), jpeg_segment(0xDD, b"\0\5"), jpeg_table(0xC4, 0x10, 3)]),
        ("jpeg.fill_bytes", jpeg(b"\xff" * 9, scan=b"\1\xff\xff\xd0\2", scan_tail=SECRET[:3]), "cleaned", None, [b"\1\xff\xd0\2", b"\1\1\0\0\x3f\0"]),
        ("jpeg.profile", jpeg(jpeg_segment(0xE2, b"ICC_PROFILE\0\2\2" + profile()[300:]), jpeg_segment(0xE2, b"ICC_PROFILE\0\1\2" + profile()[:300])), "cleaned", None, [b"ICC_PROFILE\0\1\2"]),
        ("jpeg.profile_incomplete", jpeg(jpeg_segment(0xE2, b"ICC_PROFILE\0\1\2" + profile())), "refused", "damaged", []),
        ("jpeg.progressive", jpeg(frame=0xC2, scan_tail=b"\0\0\0"), "cleaned", None, []),
        ("jpeg.line_count", jpeg(height=0, tail=jpeg_segment(0xDC, b"\0\x08") + jpeg_segment(0xDC, SECRET)), "cleaned", None, [jpeg_segment(0xDC, b"\0\x08")]),
        ("jpeg.unneeded_line_count", jpeg(tail=jpeg_segment(0xDC, SECRET)), "cleaned", None, []),
        ("jpeg.previews", pictures((0x010001, jpeg(jpeg_segment(0xFE, SECRET)))), "cleaned", None, []),
        ("jpeg.several_pictures", pictures((0, jpeg())), "refused", "unsupported_part", []),
        ("jpeg.gain_map", pictures((0x010002, jpeg(jpeg_segment(0xFE, SECRET))), (0, jpeg(jpeg_segment(0xFE, SECRET), jpeg_segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + XMP), jpeg_table(0xDB, 0, 0x53))), dependent=3, tail=SECRET), "cleaned", None, [b"MPF\0MM", b'hdrgm:Gamma="2.5"', struct.pack(">IIIHH", 0, 0, 0, 0, 0)[:0]]),
        ("jpeg.gain_map_metadata", pictures((0, jpeg(jpeg_segment(0xE2, GAIN_MAP + SECRET))), head=(jpeg_segment(0xE2, GAIN_MAP[:32] + SECRET[:0]),)), "cleaned", None, [b"MPF\0MM", GAIN_MAP]),
        ("jpeg.gain_map_shape", pictures((0, jpeg(jpeg_segment(0xE2, GAIN_MAP), height=4))), "refused", "unsupported_part", []),
        ("jpeg.gain_map_version", jpeg(jpeg_segment(0xE2, GAIN_MAP.replace(b"21496:-1\0\0\0", b"21496:-1\0\0\1"))), "refused", "unsupported_part", []),
        ("jpeg.gain_curve", jpeg(jpeg_segment(0xEA, b"AROT\0\0\0\0\0\2" + bytes(8) + bytes(3)), jpeg_segment(0xE2, b"AROT\0\0\0\0\0\1abcd")), "cleaned", None, [b"AROT\0\0\0\0\0\2"]),
        ("jpeg.gain_curve_tail", jpeg(jpeg_segment(0xEA, b"AROT\0\0\0\0\0\1abcd" + SECRET)), "refused", "unsupported_part", []),
        ("jpeg.overlapping_pictures", pictures((0, jpeg())).replace(struct.pack(">II", 0, len(jpeg())), struct.pack(">II", 0, 10**6)), "refused", "damaged", []),
        ("jpeg.extended_packet", jpeg(*extended()), "cleaned", None, [b'hdrgm:Gamma="2.5"', b'hdrgm:GainMapMax="3.0"']),
        ("jpeg.extended_packet_short", jpeg(*extended()[:2]), "cleaned", None, [b'hdrgm:Gamma="2.5"']),
        ("jpeg.rendering_note", jpeg(jpeg_segment(0xE1, b"Exif\0\0" + exif.build({"turn": 6, "resolution": None, "space": None, "index": None, "note": _note()}))), "cleaned", None, [exif.NOTE, struct.pack(">ii", 7, 5)]),
        ("jpeg.unreadable_packet", jpeg(jpeg_segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + SECRET)), "refused", "unsupported_part", []),
        ("jpeg.broken_index", jpeg(jpeg_segment(0xE2, b"MPF\0" + SECRET)), "refused", "damaged", []),
        ("jpeg.unknown_marker", jpeg(jpeg_segment(0xF3, SECRET)), "refused", "unsupported_part", []),
        ("jpeg.no_end", jpeg()[:-2], "refused", "damaged", []),
        ("jpeg.much_fill", jpeg(b"\xff" * 2000), "refused", "damaged", []),
        ("tiff.plain", tiff_file(), "cleaned", None, []),
        ("tiff.big_endian_pages", tiff_file(order=">", pages=3, tail=SECRET), "cleaned", None, []),
        ("tiff.private_tags", tiff_file((270, 2, SECRET), (305, 2, SECRET), (65000, 7, SECRET), (274, 3, b"\6\0"), (320, 3, SECRET + b"xx"), (347, 7, SECRET)), "refused", "damaged", []),
        ("tiff.texts", tiff_file((270, 2, SECRET), (305, 2, SECRET), (65000, 7, SECRET), (274, 3, b"\6\0"), (347, 7, SECRET)), "cleaned", None, []),
        ("tiff.strips", tiff_file(strips=2), "cleaned", None, []),
        ("tiff.extra_data", tiff_file(block=bytes(6) + SECRET), "refused", "extra_image_data", []),
        ("tiff.short_data", tiff_file(block=bytes(5)), "refused", "damaged", []),
        ("tiff.profile", tiff_file((34675, 7, profile())), "cleaned", None, []),
        ("tiff.profile_broken", tiff_file((34675, 7, SECRET)), "refused", "unsupported_profile", []),
        ("tiff.raw", tiff_file((50706, 1, b"\1\4\0\0")), "refused", "raw_photo", []),
        ("tiff.old_jpeg", tiff_file((259, 3, b"\6\0")), "refused", "unsupported_variant", []),
        ("tiff.wrong_count", tiff_file((274, 3, b"\6\0\6\0")), "refused", "damaged", []),
        ("tiff.loop", tiff_file(loop=True), "refused", "damaged", []),
        ("tiff.big", b"II+\0" + bytes(30), "refused", "unsupported_variant", []),
        ("tiff.truncated", tiff_file()[:-9], "refused", "damaged", []),
        ("bmp.rgb", bmp(24, bytes(range(9)) + b"abc" + bytes(range(9)) + b"xyz"), "cleaned", None, [b"pHYs"]),
        ("bmp.palette", bmp(8, b"\0\1\1z\1\0\0z", palette=bytes(range(8))), "cleaned", None, [b"\2\1\0\6\5\4"]),
        ("bmp.run_lengths", bmp(8, b"\2\1\1\0\0\0\0\3\1\0\1\0\0\1", palette=bytes(range(8)), method=1), "cleaned", None, [b"PLTE"]),
        ("bmp.fields", bmp(32, bytes(24), method=3, more=struct.pack("<III", 0xFF0000, 0xFF00, 0xFF) + bytes(4)), "cleaned", None, []),
        ("bmp.four_bit_runs", bmp(4, bytes(8), palette=bytes(64), method=2), "refused", "unsupported_variant", []),
        ("bmp.index_out_of_range", bmp(8, b"\0\7\1z\1\0\0z", palette=bytes(8)), "refused", "damaged", []),
        ("bmp.truncated", bmp(24, bytes(12), tail=b""), "refused", "damaged", []),
        ("other.text", SECRET * 3, "refused", "unsupported_format", []),
        *boxed.cases(), *films.cases(),
    ]


def files(spark: SparkSession, copies: int = 1) -> DataFrame:
    """``file_id, name, kind, content`` of all cases, each as often as asked."""
    from pyspark.sql import functions as F

    from tessera.sources.parts import kind_of

    made = cases()
    table = spark.createDataFrame([(n, name, bytearray(content)) for n, (name, content, *_) in enumerate(made)], "case long, name string, content binary")
    spread = table.crossJoin(spark.range(copies)) if copies > 1 else table.withColumn("id", F.lit(0).cast("long"))
    return spread.select((F.col("id") * len(made) + F.col("case")).alias("file_id"), "name", kind_of(F.col("content")).alias("kind"), "content")
