"""Decoder configurations of ISO base media files, read to where they end.

Each layout is a list of steps over a cursor; a configuration counts only if its steps end where its box ends.
"""

from __future__ import annotations

from collections.abc import Callable

from tessera.sources.jpeg import Broken

#: Parts of a list in one configuration.
MOST_PARTS = 256


class Cursor:
    """Bytes of a range, read in order; what isn't there is a part that can't be judged."""

    def __init__(self, data: bytes, at: int, end: int, key: str = "unsupported_part"):
        self.data, self.at, self.end, self.key, self.parts = data, at, end, key, 0

    def skip(self, size: int) -> bytes:
        if self.at + size > self.end:
            raise Broken(self.key)
        self.at += size
        return bytes(self.data[self.at - size : self.at])

    def number(self, size: int) -> int:
        return int.from_bytes(self.skip(size), "big")

    def part(self) -> None:
        self.parts += 1
        if self.parts > MOST_PARTS:
            raise Broken("unsupported_part")

    @property
    def left(self) -> int:
        return self.end - self.at


Step = Callable[[Cursor], None]


def fixed(size: int) -> Step:
    """So many bytes."""
    return lambda c: c.skip(size) and None


def sized(width: int) -> Step:
    """A length, and so many bytes."""
    return lambda c: c.skip(c.number(width)) and None


def zeros(size: int) -> Step:
    def step(c: Cursor) -> None:
        if any(c.skip(size)):
            raise Broken("unsupported_part")

    return step


def several(width: int, steps: list[Step], mask: int = 0xFFFF) -> Step:
    """A count, and the steps so many times."""

    def step(c: Cursor) -> None:
        for _ in range(c.number(width) & mask):
            c.part()
            run(steps, c)

    return step


def run(steps: list[Step], c: Cursor) -> None:
    for step in steps:
        step(c)


_PARAMETER_SETS = [sized(2)]


def _avc(c: Cursor) -> None:
    c.skip(1)
    profile = c.number(1)
    run([fixed(3), several(1, _PARAMETER_SETS, 0x1F), several(1, _PARAMETER_SETS)], c)
    # Profiles that give no chroma format and bit depths.
    if c.left and profile not in (66, 77, 88):
        run([fixed(3), several(1, _PARAMETER_SETS)], c)


def _open_bitstream_units(c: Cursor) -> None:
    while c.left:
        c.part()
        head = c.number(1)
        # A sequence header and metadata; flags for an extension byte and for a size.
        if head & 0x80 or head >> 3 & 0x0F not in (1, 5):
            raise Broken("unsupported_part")
        c.skip(1 if head & 0x04 else 0)
        if not head & 0x02:
            c.skip(c.left)
            return
        size = 0
        for shift in range(0, 63, 7):
            byte = c.number(1)
            size |= (byte & 0x7F) << shift
            if byte < 0x80:
                break
        c.skip(size)


def _vp(c: Cursor) -> None:
    version = c.number(1)
    if version > 1:
        raise Broken("unsupported_part")
    run([zeros(3), fixed(6 if version else 4), sized(2)], c)


def _opus(c: Cursor) -> None:
    c.skip(1)
    channels = c.number(1)
    c.skip(8)
    if c.number(1):
        c.skip(2 + channels)


def _flac(c: Cursor) -> None:
    zeros(4)(c)
    for n in range(MOST_PARTS):
        head, size = c.number(1), c.number(3)
        body = c.skip(size)
        # The first block is the stream information of 34 bytes, others are padding.
        if head & 0x7F != (1 if n else 0) or (any(body) if n else size != 34):
            raise Broken("unsupported_part")
        if head & 0x80:
            return
    raise Broken("unsupported_part")


def _eac3(c: Cursor) -> None:
    c.skip(1)
    for _ in range((c.number(1) & 7) + 1):
        c.skip(2)
        c.skip(1 if c.number(1) >> 1 & 0x0F else 0)
    c.skip(2 if c.left == 2 else 0)


def _descriptor(c: Cursor, tag: int) -> Cursor:
    """The body of the next descriptor, which must have that tag; the cursor moves behind it."""
    if c.number(1) != tag:
        raise Broken("unsupported_part")
    size = 0
    for _ in range(4):
        byte = c.number(1)
        size = size << 7 | byte & 0x7F
        if byte < 0x80:
            break
    begin = c.at
    c.skip(size)
    return Cursor(c.data, begin, c.at)


def _elementary_stream(c: Cursor) -> None:
    # Tags of the stream, its decoder, the decoder's own data and the sync layer; flags of the stream.
    zeros(4)(c)
    stream = _descriptor(c, 3)
    stream.skip(2)
    flags = stream.number(1)
    if flags & 0x40:
        raise Broken("unsupported_part")
    stream.skip((2 if flags & 0x80 else 0) + (2 if flags & 0x20 else 0))
    decoder = _descriptor(stream, 4)
    decoder.skip(13)
    if decoder.left:
        _descriptor(decoder, 5)
    sync = _descriptor(stream, 6)
    sync.skip(1)
    if stream.left or decoder.left or sync.left:
        raise Broken("unsupported_part")


_HEVC_ARRAYS = several(1, [fixed(1), several(2, _PARAMETER_SETS)])
#: Steps by box; configurations of other boxes aren't read.
LAYOUTS: dict[str, list[Step]] = {
    "avcC": [_avc], "hvcC": [fixed(22), _HEVC_ARRAYS], "lhvC": [fixed(5), _HEVC_ARRAYS], "av1C": [fixed(4), _open_bitstream_units],
    "vpcC": [_vp], "dOps": [_opus], "dfLa": [_flac], "dec3": [_eac3], "esds": [_elementary_stream],
}


def check(kind: str, data: bytes, at: int, end: int) -> None:
    """Broken if the box holds more or less than its configuration."""
    cursor = Cursor(data, at, end)
    run(LAYOUTS.get(kind, []), cursor)
    if kind in LAYOUTS and cursor.left:
        raise Broken("unsupported_part")
