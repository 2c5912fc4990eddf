"""TIFF files as parts: the byte order, then for each page its tags and its image blocks.

Parts are ``head`` (the byte order), ``tag<number>`` and ``block``. A tag's payload is its page, its type and its value;
a block's is its page and its bytes. A tag's note names the condition under which it means anything.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from math import ceil

from tessera.functions import icc
from tessera.functions.exif import SIZES
from tessera.sources import jpeg
from tessera.sources.jpeg import Broken

# Tags that a page is decoded and shown by, with the number of values they have.
ONE = [254, 255, 256, 257, 259, 262, 263, 266, 274, 277, 278, 282, 283, 284, 290, 292, 293, 296, 317, 322, 323, 332, 334, 531]
COUNTS = {**dict.fromkeys(ONE, 1), 297: 2, 318: 2, 319: 6, 321: 2, 342: 6, 529: 3, 530: 2, 532: 6}
PER_SAMPLE = [258, 280, 281, 339, 340, 341]
ANY = [273, 279, 291, 301, 320, 324, 325, 336, 338, 347, 34675]
KEPT = sorted([*COUNTS, *PER_SAMPLE, *ANY])
# Field types by name, and the tags whose values aren't whole numbers.
BYTE, SHORT, LONG, RATIONAL, UNDEFINED = 1, 3, 4, 5, 7
WHOLE = {BYTE: "B", SHORT: "H", LONG: "I"}
TYPES = {**dict.fromkeys([282, 283, 318, 319, 529], [RATIONAL]), 532: [*WHOLE, RATIONAL], **dict.fromkeys([340, 341], [1, 3, 4, 5, 6, 8, 9, 10, 11, 12]), **dict.fromkeys([347, 34675], [BYTE, UNDEFINED])}
BITS, COMPRESSION, PHOTOMETRIC, STRIPS, TILES, PROFILE, JPEG_TABLES, COLORS = 258, 259, 262, 273, 324, 34675, 347, 320
MOST_PAGES, MOST_SAMPLES, MOST_BITS = 4096, 4096, 64


def _need(truth: bool, key: str = "damaged") -> None:
    if not truth:
        raise Broken(key)


def _read(data: bytes, code: str, at: int) -> tuple:
    _need(0 <= at and at + struct.calcsize(code) <= len(data))
    return struct.unpack_from(code, data, at)


class _Page:
    """One directory: tags as number to (type, value), image blocks, and the spans of both."""

    def __init__(self, data: bytes, at: int, order: str, budget: dict):
        self.order, self.tags, self.image = order, {}, []
        (n,) = _read(data, order + "H", at)
        (self.next,) = _read(data, order + "I", at + 2 + 12 * n)
        for k in range(n):
            tag, kind, count = _read(data, order + "HHI", at + 2 + 12 * k)
            size, field = SIZES.get(kind, 0) * count, at + 10 + 12 * k
            if size:
                self.tags[tag] = (kind, self._take(data, field if size <= 4 else _read(data, order + "I", field)[0], size, budget))
        _need(not (50706 in self.tags or 330 in self.tags and self.first(254, 0) & 1), "raw_photo")
        _need(self.first(COMPRESSION, 1) != 6, "unsupported_variant")
        self._counts()
        offsets, sizes = (TILES, 325) if TILES in self.tags else (STRIPS, 279)
        _need(offsets in self.tags and sizes in self.tags)
        where, how_much = self.whole(offsets), self.whole(sizes)
        _need(len(where) == len(how_much))
        self._fits(len(where), None)
        _need(all(at >= 8 for at, size in zip(where, how_much, strict=True) if size))
        self.blocks = [self._take(data, at, size, budget) for at, size in zip(where, how_much, strict=True)]
        self.image = [(at, at + size) for at, size in zip(where, how_much, strict=True) if size]
        self._fits(len(where), [len(b) for b in self.blocks])
        if self.first(COMPRESSION, 1) == 7:
            for block in [*self.blocks, self.tags.get(JPEG_TABLES, (0, b""))[1]]:
                if block:
                    self._only_coding(block)

    @staticmethod
    def _take(data: bytes, at: int, size: int, budget: dict) -> bytes:
        """Bytes of a range; all ranges together hold no more than the file."""
        _need(at + size <= len(data))
        if (at, size) not in budget:
            budget["left"] -= size
            _need(budget["left"] >= 0)
            budget[at, size] = data[at : at + size]
        return budget[at, size]

    @staticmethod
    def _only_coding(block: bytes) -> None:
        for marker, body, _ in jpeg.segments(block if block.endswith(b"\xff\xd9") else block + b"\xff\xd9"):
            adobe = marker == 0xEE and body.startswith(b"Adobe") and len(body) == 12
            _need(adobe or not (0xE0 <= marker <= 0xEF or marker == jpeg.COM), "unsupported_part")

    def whole(self, tag: int) -> list[int]:
        kind, body = self.tags[tag]
        _need(kind in WHOLE)
        return list(struct.unpack(f"{self.order}{len(body) // SIZES[kind]}{WHOLE[kind]}", body))

    def first(self, tag: int, default: int) -> int:
        return self.whole(tag)[0] if tag in self.tags else default

    def _counts(self) -> None:
        """Kept tags hold as many values of the types as the format gives them."""
        samples, bits = self.first(277, 1), max(self.whole(BITS)) if BITS in self.tags else 1
        _need(samples <= MOST_SAMPLES and bits <= MOST_BITS)
        allowed = {336: [2, 2 * samples], 338: range(samples + 1), 291: [1 << bits], 301: [1 << bits, 3 << bits], COLORS: [3 << bits]}
        allowed |= dict.fromkeys(PER_SAMPLE, [1, samples]) | {tag: [n] for tag, n in COUNTS.items()}
        for tag in self.tags.keys() & set(KEPT):
            kind, body = self.tags[tag]
            _need(kind in TYPES.get(tag, WHOLE))
            _need(tag not in allowed or len(body) // SIZES[kind] in allowed[tag])

    def _fits(self, n: int, sizes: list[int] | None) -> None:
        """As many blocks as the image needs; uncompressed ones hold exactly their pixels."""
        width, height, samples = self.first(256, 0), self.first(257, 0), self.first(277, 1)
        bits = self.whole(BITS) if BITS in self.tags else [1]
        _need(width > 0 and height > 0 and len(bits) in (1, samples))
        bits = bits * samples if len(bits) == 1 else bits
        planes = [sum(bits)] if self.first(284, 1) == 1 else bits
        if TILES in self.tags:
            across, down = self.first(322, 0), self.first(323, 0)
            _need(across > 0 and down > 0)
            each = ceil(width / across) * ceil(height / down)
            lines = None if sizes is None else [down] * each
        else:
            across, rows = width, min(self.first(278, height) or height, height)
            each = ceil(height / rows)
            lines = None if sizes is None else [min(rows, height - k * rows) for k in range(each)]
        _need(n == each * len(planes))
        if sizes is not None and self.first(COMPRESSION, 1) == 1 and self.first(PHOTOMETRIC, 0) != 6:
            wanted = [k * ceil(across * plane / 8) for plane in planes for k in lines]
            _need(all(a <= b for a, b in zip(sizes, wanted, strict=True)), "extra_image_data")
            _need(sizes == wanted)


def tiff(data: bytes) -> Iterator[tuple]:
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    _need(len(data) >= 8 and data[8:10] != b"CR", "damaged" if len(data) < 8 else "raw_photo")
    magic, at = _read(data, order + "HI", 2)
    _need(magic != 43, "unsupported_variant")
    _need(magic == 42)
    pages, seen, budget = [], set(), {"left": len(data)}
    while at:
        _need(at not in seen and len(pages) <= MOST_PAGES)
        seen.add(at)
        pages.append(_Page(data, at, order, budget))
        at = pages[-1].next
    _need(bool(pages))
    used = sorted(span for page in pages for span in page.image)
    _need(all(a[1] <= b[0] for a, b in zip(used, used[1:], strict=False)))
    yield b"head", data[:2], True, None, None
    for number, page in enumerate(pages):
        head = number.to_bytes(2, "big")
        for tag, (kind, body) in sorted(page.tags.items()):
            rewritten, refusal = None, None
            note = "unused" if tag == JPEG_TABLES and page.first(COMPRESSION, 1) != 7 or tag == COLORS and page.first(PHOTOMETRIC, 0) != 3 else None
            if tag == PROFILE:
                try:
                    rewritten = head + UNDEFINED.to_bytes(2, "big") + icc.clean_profile(body)
                except icc.BadProfile:
                    refusal = "unsupported_profile"
            yield b"tag%d" % tag, head + kind.to_bytes(2, "big") + body, True, rewritten, refusal, note
        for block in page.blocks:
            yield b"block", head + block, True, None, None


def join(parts: list[tuple[bytes, bytes]]) -> bytes:
    """A file of the kept tags and blocks in the same byte order, offsets written anew."""
    mark, order = parts[0][1], "<" if parts[0][1] == b"II" else ">"
    pages: dict[int, tuple[dict, list]] = {}
    for code, body in parts[1:]:
        tags, blocks = pages.setdefault(int.from_bytes(body[:2], "big"), ({}, []))
        if code == b"block":
            blocks.append(body[2:])
        else:
            tags[int(code[3:])] = (int.from_bytes(body[2:4], "big"), body[4:])
    out, link = bytearray(mark + struct.pack(order + "HI", 42, 0)), 4
    for tags, blocks in pages.values():
        places = []
        for block in blocks:
            out += bytes(len(out) % 2)
            places.append(len(out) if block else 0)
            out += block
        out += bytes(len(out) % 2)
        tags[TILES if TILES in tags else STRIPS] = (LONG, struct.pack(f"{order}{len(places)}I", *places))
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + 2 + 12 * len(tags)
        table, behind = struct.pack(order + "H", len(tags)), b""
        for tag in sorted(tags):
            kind, body = tags[tag]
            place = struct.pack(order + "I", link + 4 + len(behind)) if len(body) > 4 else body.ljust(4, b"\0")
            table += struct.pack(order + "HHI", tag, kind, len(body) // SIZES[kind]) + place
            behind += body + bytes(len(body) % 2) if len(body) > 4 else b""
        out += table + bytes(4) + behind
    return bytes(out)
