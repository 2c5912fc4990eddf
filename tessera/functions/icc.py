"""Colour profiles reduced to what converts colours, at the same length.

A clean profile holds the standard's header bits, neutral texts and the colour tags in order; everything else of the
original length is zero. A kept tag is copied whole, so each of its bytes must belong to a field of its type or be
zero. Unknown tags, types and values refuse the profile. The HDR curve tags (hdgm, HAGC) aren't read yet and refuse it.
"""

from __future__ import annotations

import struct


class BadProfile(ValueError):
    """A profile that can't be reduced safely."""


LARGEST = 64 << 20

# Where the standard puts header fields, which bits of them it defines, and what they may hold.
CLASSES = ("scnr", "mntr", "prtr", "link", "spac", "abst", "nmcl")
SPACES = ["XYZ ", "Lab ", "Luv ", "YCbr", "Yxy ", "RGB ", "GRAY", "HSV ", "HLS ", "CMYK", "CMY ", *(f"{d}CLR" for d in "23456789ABCDEF")]
CONNECTIONS = ["XYZ ", "Lab "]
MASKS = {44: (4, 0x3), 56: (8, 0xF), 64: (4, 0xFFFF)}
ILLUMINANT = (0xF6D6, 0x10000, 0xD32D)
NEUTRAL_DATE = (2000, 1, 1, 0, 0, 0)
# Tags that describe a profile's origin or a display, and go.
ORIGIN = ("desc", "cprt", "dmnd", "dmdd", "dscm", "vued", "calt", "targ", "meta", "pseq", "psid", "mmod", "devs", "scrd", "crdi", "ndin", "vcgt", "vcgp")
# Colour tags with the types they may have.
TYPES = {
    **dict.fromkeys(("rXYZ", "gXYZ", "bXYZ", "wtpt", "bkpt", "lumi"), ["XYZ "]),
    **dict.fromkeys(("rTRC", "gTRC", "bTRC", "kTRC"), ["curv", "para"]),
    **dict.fromkeys(("aarg", "aagg", "aabg"), ["para"]),
    **dict.fromkeys(("tech", "rig0", "rig2", "ciis"), ["sig "]),
    **dict.fromkeys(("A2B0", "A2B1", "A2B2"), ["mft1", "mft2", "mAB "]),
    **dict.fromkeys(("B2A0", "B2A1", "B2A2"), ["mft1", "mft2", "mBA "]),
    **dict.fromkeys(("pre0", "pre1", "pre2", "gamt"), ["mft1", "mft2", "mAB ", "mBA "]),
    "chad": ["sf32"], "chrm": ["chrm"], "cicp": ["cicp"], "view": ["view"], "meas": ["meas"],
}
# Signatures that signature tags may hold.
LISTED = {
    "tech": ["fscn", "dcam", "rscn", "ijet", "twax", "epho", "esta", "dsub", "rpho", "fprn", "vidm", "vidc", "pjtv", "CRT ", "PMD ", "AMD ", "KPCD", "imgs", "grav", "offs", "silk", "flex", "mpfs", "mpfr", "dmpc", "dcpj"],
    "ciis": ("scoe", "sape", "fpce", "rhoc", "rpoc"),
    "rig0": ["prmg"],
    "rig2": ["prmg"],
}
# Bytes of types of one size; parameters of each parametric function.
SIZED = {"XYZ ": 20, "sf32": 44, "cicp": 12, "sig ": 12, "view": 36, "meas": 36}
PARAMETERS = {0: 1, 1: 3, 2: 4, 3: 5, 4: 7}


class _Field:
    """Marks the bytes of a tag that its type defines."""

    def __init__(self, body: bytes):
        self.body, self.defined = body, bytearray(len(body))

    def mark(self, start: int, size: int) -> None:
        if start < 0 or start + size > len(self.body):
            raise BadProfile("a tag ends early")
        self.defined[start : start + size] = b"\1" * size

    def number(self, at: int, size: int) -> int:
        if at + size > len(self.body):
            raise BadProfile("a tag ends early")
        return int.from_bytes(self.body[at : at + size], "big")

    def rest_is_zero(self) -> bool:
        return not any(b for b, known in zip(self.body, self.defined, strict=True) if not known)

    def curve(self, at: int) -> int:
        """Mark a curve at ``at``; where it ends."""
        kind = self.body[at : at + 4]
        if kind == b"curv":
            size = 4 + 2 * self.number(at + 8, 4)
        elif kind == b"para":
            function = self.number(at + 8, 2)
            if function not in PARAMETERS:
                raise BadProfile("an unknown parametric curve")
            self.mark(at + 8, 2)
            self.mark(at + 12, 4 * PARAMETERS[function])
            self.mark(at, 4)
            return at + 12 + 4 * PARAMETERS[function]
        else:
            raise BadProfile("an unknown curve")
        self.mark(at, 4)
        self.mark(at + 8, size)
        return at + 8 + size

    def table(self, wide: bool) -> None:
        """mft1 and mft2: matrix, input tables, grid, output tables."""
        ins, outs, grid = self.body[8:11] if len(self.body) > 10 else (0, 0, 0)
        if not ins or ins > 15 or grid**ins > LARGEST:
            raise BadProfile("a colour table of no use")
        n_in, n_out, head, width = (self.number(48, 2), self.number(50, 2), 52, 2) if wide else (256, 256, 48, 1)
        self.mark(0, 4)
        self.mark(8, 3)
        self.mark(12, head - 12 + width * (n_in * ins + grid**ins * outs + n_out * outs))

    def elements(self, forward: bool) -> None:
        """mAB and mBA: curves, matrix and grid at stated offsets."""
        ins, outs = self.number(8, 1), self.number(9, 1)
        b, matrix, m, grid, a = (self.number(12 + 4 * k, 4) for k in range(5))
        near, far = (outs, ins) if forward else (ins, outs)
        self.mark(0, 4)
        self.mark(8, 2)
        self.mark(12, 20)
        for at, count in ((b, near), (m, near), (a, far)):
            for _ in range(count if at else 0):
                if at % 4:
                    raise BadProfile("a curve out of line")
                at = -(-self.curve(at) // 4) * 4
        if matrix:
            self.mark(matrix, 48)
        if grid:
            sizes, precision = self.body[grid : grid + 16], self.number(grid + 16, 1)
            points = outs * precision
            for n in sizes[:ins]:
                points *= n
                if points > LARGEST:
                    raise BadProfile("a tag ends early")
            if precision not in (1, 2) or not all(sizes[:ins]) or any(sizes[ins:]):
                raise BadProfile("an unknown colour grid")
            self.mark(grid, 17)
            self.mark(grid + 20, points)


def _check(tag: str, body: bytes) -> None:
    """Refuse a tag with bytes outside its type's fields or values that the standard doesn't list."""
    kind, field = body[:4].decode("latin-1"), _Field(body)
    if tag not in TYPES or kind not in TYPES[tag]:
        raise BadProfile(f"an unknown tag {tag!r}")
    if kind in SIZED:
        field.mark(0, 4)
        field.mark(8, SIZED[kind] - 8)
    elif kind in ("curv", "para"):
        if field.curve(0) != len(body) and tag[0] == "a":
            raise BadProfile("a curve with more than its parameters")
    elif kind == "chrm":
        field.mark(0, 4)
        field.mark(8, 4 + 8 * field.number(8, 2))
    elif kind in ("mft1", "mft2"):
        field.table(kind == "mft2")
    else:
        field.elements(kind == "mAB ")
    listed = {
        "sig ": lambda: body[8:12].decode("latin-1") in LISTED[tag],
        "meas": lambda: field.number(8, 4) < 3 and field.number(24, 4) < 3 and field.number(28, 4) <= 0x10000 and field.number(32, 4) < 9,
        "view": lambda: field.number(32, 4) < 9,
        "chrm": lambda: field.number(10, 2) < 5,
        "cicp": lambda: body[11] < 2,
    }
    if not field.rest_is_zero() or not listed.get(kind, lambda: True)():
        raise BadProfile(f"tag {tag!r} holds more than its type defines")


def _tags(profile: bytes) -> dict[str, bytes]:
    """Tags by name; shared data is allowed, partial overlap isn't."""
    if not 132 <= len(profile) <= LARGEST or profile[36:40] != b"acsp" or profile[8] not in (2, 4):
        raise BadProfile("no profile of a known version")
    length, count = int.from_bytes(profile[:4], "big"), int.from_bytes(profile[128:132], "big")
    table = 132 + 12 * count
    if count > 4096 or not table <= length <= len(profile):
        raise BadProfile("a broken tag table")
    rows = [struct.unpack_from(">4sII", profile, 132 + 12 * n) for n in range(count)]
    spans = sorted({(at, at + size) for _, at, size in rows})
    if len({name for name, _, _ in rows}) < count or any(at < table or at % 4 or size < 8 or at + size > length for _, at, size in rows):
        raise BadProfile("a tag out of range")
    if any(one[1] > two[0] for one, two in zip(spans, spans[1:], strict=False)):
        raise BadProfile("tags that overlap")
    return {name.decode("latin-1"): profile[at : at + size] for name, at, size in rows}


def _header(profile: bytes) -> bytes:
    """128 bytes with what the standard defines; the size is left zero."""
    kind, space, connection = (profile[at : at + 4].decode("latin-1") for at in (12, 16, 20))
    version = profile[9]
    illuminant = struct.unpack_from(">3i", profile, 68)
    known = kind in CLASSES and space in SPACES and connection in (SPACES if kind == "link" else CONNECTIONS)
    near = all(round(a / 65536, 4) == round(b / 65536, 4) for a, b in zip(illuminant, ILLUMINANT, strict=True))
    if not known or not near or version >> 4 > 9 or version & 15 > 9 or int.from_bytes(profile[66:68], "big") > 3:
        raise BadProfile("a header value that the standard doesn't define")
    out = bytearray(128)
    out[8:10], out[12:24], out[36:40] = profile[8:10], profile[12:24], b"acsp"
    struct.pack_into(">6H", out, 24, *NEUTRAL_DATE)
    struct.pack_into(">3i", out, 68, *ILLUMINANT)
    for at, (size, mask) in MASKS.items():
        out[at : at + size] = (int.from_bytes(profile[at : at + size], "big") & mask).to_bytes(size, "big")
    return bytes(out)


def _text(words: str, version: int, described: bool) -> bytes:
    if version == 4:
        body = words.encode("utf-16-be")
        return b"mluc" + struct.pack(">III4sII", 0, 1, 12, b"enUS", len(body), 28) + body
    body = words.encode() + b"\0"
    return b"desc" + bytes(4) + len(body).to_bytes(4, "big") + body + bytes(78) if described else b"text" + bytes(4) + body


def clean_profile(profile: bytes) -> bytes:
    """The profile's colour conversion alone, as long as the original; BadProfile if that isn't safe."""
    colours = {name: body for name, body in sorted(_tags(profile).items()) if name not in ORIGIN}
    for name, body in colours.items():
        _check(name, body)
    kept = {"desc": _text("Clean", profile[8], True), "cprt": _text("", profile[8], False), **colours}
    out = bytearray(_header(profile))
    out[:4] = len(profile).to_bytes(4, "big")
    out += len(kept).to_bytes(4, "big")
    at, places, body = 132 + 12 * len(kept), {}, bytearray()
    for name, own in kept.items():
        if own not in places:
            places[own] = at + len(body)
            body += own + bytes(-len(own) % 4)
        out += struct.pack(">4sII", name.encode("latin-1"), places[own], len(own))
    out += body
    if max(place + len(own) for own, place in places.items()) > len(profile):
        raise BadProfile("no room for neutral texts")
    out = bytes(out[: len(profile)].ljust(len(profile), b"\0"))
    again = {name: own for name, own in _tags(out).items() if name not in ORIGIN}
    if again != colours or _header(out) != _header(profile):
        raise BadProfile("colour data changed")
    return out
