"""Small HEIF files made from scratch, each with what a clean copy must lose and keep.

A photo is described by rows: items with the properties that they have and where their data is, and references. The
tables of the file follow from the rows.
"""

from __future__ import annotations

from typing import NamedTuple

from tessera.sources.fixtures import SECRET, XMP, jpeg_segment, profile
from tessera.sources.layout import At, Mark, box, full, nest, u16, u32, written

GAIN = u16(0, 0) + b"\x40" + b"".join(u32(n, 1_000_000) for n in range(7))
SIZE = full(b"ispe", u32(12, 10))


class Item(NamedTuple):
    """An item: its number, type and data, and what its rows in the tables say."""

    number: int
    kind: bytes
    data: bytes = b""
    #: The kind of auxiliary picture that it is.
    role: bytes = b""
    has: tuple[bytes, ...] = ()
    #: Property numbers instead of those that follow from role and ``has``.
    numbers: tuple[int, ...] | None = None
    #: The item whose data it has, and whether its own data is said to begin with it.
    same_as: int | None = None
    starts_with: int | None = None
    name: bytes = b""
    content: bytes = b"application/rdf+xml"
    tail: bytes = b""

    @property
    def is_picture(self) -> bool:
        return self.kind not in (b"Exif", b"mime", b"uri ")

    def entry(self) -> bytes:
        """The item's row of the table of items."""
        typed = {b"mime": self.content + bytes(2), b"uri ": b"tag:secret\0"}.get(self.kind, b"")
        return full(b"infe", u16(self.number, 0) + self.kind + self.name + b"\0" + typed + self.tail, 2)


def _properties(items: tuple[Item, ...]) -> tuple:
    """All properties in order of first use, and the association of each item with their numbers."""
    pool, rows = [], []
    for item in items:
        own = [SIZE, *([full(b"auxC", item.role + b"\0")] if item.role else []), *item.has] if item.is_picture else []
        pool += [p for p in own if p not in pool]
        if numbers := item.numbers or [pool.index(p) + 1 for p in own]:
            rows.append(u32(item.number)[2:] + bytes((len(numbers), *numbers)))
    return nest(b"iprp", box(b"ipco", *pool), full(b"ipma", u32(len(rows)) + b"".join(rows)))


def _references(text: str) -> tuple:
    """``kind origin > target target; ...`` as a box."""
    rows = []
    for row in filter(None, map(str.strip, text.split(";"))):
        left, right = row.split(">")
        kind, origin = left.split()
        targets = [int(t) for t in right.split()]
        rows.append(box(kind.encode(), u16(int(origin), len(targets), *targets)))
    return (full(b"iref", b"".join(rows)),) if rows else ()


def photo(*items: Item, refs: str = "", inside: bool = False, alike: tuple[int, ...] = (), in_meta: tuple = (), before: tuple = (), after: tuple = (), spare: bytes = b"", brand: bytes = b"heic") -> bytes:
    """A file of the items, the first one shown; data lies ``inside`` the tables or in a box of its own.

    ``alike`` items are alternatives; ``spare`` bytes behind the data belong to no item.
    """
    places = []
    for item in items:
        of = next(i for i in items if i.number == item.same_as) if item.same_as else item
        mark = At(item.starts_with or of.number, "inside" if inside else None)
        places += [u16(item.number), u16(1) if inside else b"", u16(0, 1), mark, u32(len(of.data))]
    data = [(Mark(i.number), i.data) for i in items if not i.same_as] + [spare]
    tables = [
        nest(b"iloc", bytes((int(inside), 0, 0, 0, 0x44, 0)), u16(len(items)), places),
        full(b"hdlr", bytes(4) + b"pict" + bytes(12) + SECRET + b"\0"),
        full(b"iinf", u16(len(items)) + b"".join(i.entry() for i in items)),
        _references(refs),
        box(b"grpl", full(b"altr", u32(7001, len(alike), *alike))) if alike else b"",
        _properties(items),
        full(b"pitm", u16(items[0].number)),
    ]
    where = nest(b"idat", Mark("inside"), data) if inside else b""
    outside = () if inside else (nest(b"mdat", data),)
    return written(box(b"ftyp", brand, bytes(4), b"mif1", brand), nest(b"meta", bytes(4), tables, where, in_meta), before, outside, after)


ONE, DEPTH = Item(1, b"hvc1", b"PICTURE-ONE"), Item(2, b"hvc1", b"DEPTH-PICTURE")
_DEPTH, _ALPHA, _GAIN = b"urn:mpeg:hevc:2015:auxid:2", b"urn:mpeg:hevc:2015:auxid:1", b"urn:com:apple:photo:2020:aux:hdrgainmap"


def cases() -> list[tuple[str, bytes, str, str | None, list[bytes]]]:
    """(name, content, expected status, expected key, byte strings that must survive)."""
    depth = DEPTH._replace(role=_DEPTH)
    packet = Item(3, b"mime", XMP)
    described = (ONE, Item(2, b"Exif", b"\0\0\0\6Exif\0\0" + SECRET), packet, Item(4, b"mime", SECRET, content=b"application/c2pa"), Item(5, b"uri ", SECRET))
    many = (ONE, depth, Item(3, b"mime", b"<" + SECRET), Item(4, b"hvc1", b"THUMB-PICTURE"), Item(5, b"hvc1", b"GAIN-PICTURE", _GAIN), Item(6, b"hvc1", b"ALPHA-PICTURE", _ALPHA), Item(8, b"mime", XMP))
    many_refs = "auxl 2 > 1; cdsc 3 > 2; thmb 4 > 1; auxl 5 > 1; auxl 6 > 1; cdsc 8 > 5"
    tiles = (Item(1, b"grid", ONE.data), Item(2, b"grid", b"DEPTH-GRID", _DEPTH), Item(3, b"hvc1", b"SHARED-TILE"), Item(4, b"hvc1", SECRET))
    scan = b"\xff\xda\0\2PIXELS\xff\xd9"
    sources = lambda address: box(b"dinf", full(b"dref", u32(1) + box(b"url ", *address)))
    prop = lambda *p: photo(ONE._replace(has=p))
    numbered = lambda *n, has=(): photo(ONE._replace(has=has, numbers=n))
    jpeg_item = lambda body, *has: photo(Item(1, b"jpeg", body, has=has))
    alpha_sei = bytes.fromhex("0000000c000000084e01a5040001fe40")
    tone = lambda body: photo(ONE, Item(2, b"tmap", body), Item(3, b"hvc1", b"GAIN-PICTURE"), refs="dimg 2 > 1 3", alike=(2, 1))
    bad, ok, broken = ("refused", "unsupported_part", []), ("cleaned", None, [ONE.data]), ("refused", "damaged", [])
    return [
        ("heif.plain", photo(ONE), *ok),
        ("heif.descriptions", photo(*described, refs="cdsc 2 > 1; cdsc 3 > 1; cdsc 4 > 1; cdsc 5 > 1"), "cleaned", None, [ONE.data, b'hdrgm:Gamma="2.5"']),
        ("heif.empty_descriptions", photo(ONE, Item(2, b"Exif"), Item(3, b"mime"), refs="cdsc 2 > 1"), *ok),
        ("heif.auxiliaries", photo(ONE._replace(name=SECRET), *many[1:], refs=many_refs), "cleaned", None, [ONE.data, b"GAIN-PICTURE", b"ALPHA-PICTURE", b'hdrgm:Gamma="2.5"']),
        ("heif.auxiliaries_inside", photo(*many, refs=many_refs, inside=True, spare=SECRET), "cleaned", None, [ONE.data, b"GAIN-PICTURE", b"ALPHA-PICTURE"]),
        ("heif.tiles", photo(*tiles, refs="dimg 1 > 3; dimg 2 > 3 4; auxl 2 > 1"), "cleaned", None, [ONE.data, b"SHARED-TILE"]),
        ("heif.other_boxes", photo(ONE, before=(box(b"uuid", bytes(16), SECRET), box(b"free", SECRET)), after=(box(b"uuid", SECRET), box(b"skip", SECRET)), in_meta=(full(b"xml ", SECRET),), spare=SECRET), *ok),
        ("heif.data_references", photo(ONE, in_meta=(box(b"dinf", full(b"dref", u32(1) + box(b"url ", b"\0\0\0\1")), box(b"abcd", SECRET)),)), *ok),
        ("heif.elsewhere", photo(ONE, in_meta=(sources((bytes(4), b"x")),)), *bad),
        ("heif.depth_is_needed", photo(ONE, depth, refs="dimg 1 > 2"), *bad),
        ("heif.overlap", photo(ONE, depth._replace(starts_with=1), refs="auxl 2 > 1"), *bad),
        ("heif.alternative_goes", photo(ONE, depth, refs="auxl 2 > 1", alike=(1, 2)), *bad),
        ("heif.group_of_nothing", photo(ONE, alike=(1, 77)), *broken),
        ("heif.unknown_role", photo(ONE, DEPTH._replace(role=b"urn:x"), refs="auxl 2 > 1"), *bad),
        ("heif.unknown_reference", photo(ONE, depth, refs="abcd 1 > 2"), *bad),
        ("heif.unknown_item", photo(ONE, Item(2, b"abcd", SECRET)), *bad),
        ("heif.dangling", photo(ONE, depth, refs="auxl 2 > 99"), *broken),
        ("heif.missing_property", numbered(99), *broken), ("heif.property_twice", numbered(1, 1), *broken),
        ("heif.only_a_type", box(b"ftyp", b"heic", bytes(4), b"mif1"), *broken),
        ("heif.describing_properties", prop(full(b"udes", b"en\0" + SECRET + bytes(3)), full(b"crtt", bytes(8), 1), box(b"abcd", SECRET)), *ok),
        ("heif.essential_property", numbered(1, 2 | 0x80, has=(box(b"abcd", SECRET),)), *bad),
        ("heif.long_turn", prop(box(b"irot", b"\0", SECRET)), *bad), ("heif.reserved_turn", prop(box(b"irot", b"S")), *bad),
        ("heif.odd_color", prop(box(b"colr", b"MDTM", SECRET)), *bad), ("heif.short_color", prop(box(b"colr", b"nclx", u16(1, 13, 1))), *ok),
        ("heif.color_code", prop(box(b"colr", b"nclx", u16(1, 999, 1), b"\0")), *bad), ("heif.pixel_bits", prop(full(b"pixi", bytes((3, 8, 8, 99)))), *bad),
        ("heif.layers", prop(box(b"a1lx", bytes(7), SECRET)), *bad), ("heif.volume", prop(box(b"cclv", b"\x20", bytes(24), SECRET)), *bad), ("heif.point", prop(box(b"a1op", b"\x40")), *bad),
        ("heif.alpha_message", prop(full(b"auxC", _ALPHA + b"\0" + alpha_sei)), *ok), ("heif.alpha_tail", prop(full(b"auxC", _ALPHA + b"\0" + alpha_sei + SECRET)), *bad),
        ("heif.configuration", prop(box(b"hvcC", bytes(23))), *ok), ("heif.configuration_tail", prop(box(b"hvcC", bytes(23), SECRET)), *bad),
        ("heif.units", prop(box(b"av1C", b"\x81\0\0\0", b"\x0a\2ab")), *ok), ("heif.unit_kind", prop(box(b"av1C", b"\x81\0\0\0", b"\x12\2ab")), *bad),
        ("heif.unread_codec", prop(box(b"vvcC", bytes(2049))), *bad), ("heif.profile", prop(box(b"colr", b"prof", profile())), *ok), ("heif.profile_broken", prop(box(b"colr", b"prof", SECRET)), "refused", "unsupported_profile", []),
        ("heif.jpeg", jpeg_item(b"\xff\xd8" + jpeg_segment(0xEE, b"Adobe" + bytes(7)) + scan), "cleaned", None, [b"PIXELS"]),
        ("heif.jpeg_comment", jpeg_item(b"\xff\xd8" + jpeg_segment(0xFE, SECRET) + scan), *bad), ("heif.jpeg_tail", jpeg_item(b"\xff\xd8" + scan + SECRET), *bad),
        ("heif.jpeg_behind_fill", jpeg_item(b"\xff\xd8\xff" + jpeg_segment(0xE1, SECRET) + scan), *bad),
        ("heif.jpeg_header", jpeg_item(scan, box(b"jpgC", jpeg_segment(0xDB, bytes(65)))), "cleaned", None, [b"PIXELS"]),
        ("heif.jpeg_thumbnail", photo(ONE, Item(2, b"jpeg", b"\xff\xd8" + jpeg_segment(0xE1, SECRET) + scan), refs="thmb 2 > 1"), *ok),
        ("heif.tone_map", tone(b"\0" + GAIN), "cleaned", None, [GAIN]), ("heif.tone_map_tail", tone(b"\0" + GAIN + SECRET), *bad), ("heif.tone_map_short", tone(b"\0" + GAIN[:-4]), *bad), ("heif.tone_map_version", tone(b"\1" + GAIN), *bad),
        ("heif.no_data", photo(Item(1, b"hvc1")), *broken), ("heif.same_data", photo(ONE, Item(2, b"hvc1", same_as=1)), *ok),
        ("heif.behind_names", photo(ONE._replace(tail=SECRET), Item(2, b"mime", XMP, tail=SECRET)), "cleaned", None, [ONE.data, b'hdrgm:Gamma="2.5"']),
        ("heif.maker_brand", photo(ONE).replace(b"mif1heic", b"mif1SECR", 1), *ok), ("heif.unreadable_packet", photo(ONE, Item(2, b"mime", b"<" + SECRET), refs="cdsc 2 > 1"), *bad),
        ("heif.large_packet", photo(ONE, Item(2, b"mime", XMP.replace(b"</rdf:RDF>", b" " * (1 << 20) + b"</rdf:RDF>"))), *ok),
        ("heif.truncated", photo(ONE)[:-3], *broken), ("avif.plain", photo(Item(1, b"av01", ONE.data), brand=b"avif"), *ok),
    ]
