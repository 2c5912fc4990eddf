"""HEIF and AVIF still images, cleaned in place: media data never moves, so every offset stays valid.

A file is read into the relations that its meta box states: items, extents, references, properties and their uses.
What goes follows from them by set algebra and closure; the result is a list of patches (start, bytes) and a length.
``difference`` reads the original and the result again and states where they disagree with the rules.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

from tessera.functions import hdr, icc
from tessera.sources import configs, jpeg
from tessera.sources.bmff import MOST_BOXES, walk
from tessera.sources.configs import Cursor
from tessera.sources.jpeg import Broken

Span = tuple[int, int]
Box = tuple[str, int, int, int]

# Brands of AVIF, of HEIF, and others that say how to read such files.
AVIF_BRANDS = ("avif", "avis")
HEIF_BRANDS = ("heic", "heix", "heim", "heis", "hevc", "hevx", "hevm", "hevs", "mif1", "msf1")
OTHER_BRANDS = ("miaf", "MiHA", "MiHB", "MiHE", "MiAn", "MiPr", "MiCm", "MA1A", "MA1B", "avio", "tmap", "mif2", "iso8", "unif", "avci", "avcs", "jpeg", "jpgs", "vvic", "vvis", "j2ki", "j2is")
FILE_TYPE_BYTES = 256
# Boxes that stay at the top and in meta; boxes that only fragments or strays have.
TOP, IN_META = ("ftyp", "meta", "mdat"), ("hdlr", "pitm", "iinf", "iloc", "iref", "iprp", "idat", "dinf", "grpl")
NOT_AT_TOP = ("moof", "mfra", "trak", "mvhd")
# Items that are pictures and items that describe; the content type of XMP.
PICTURES = ("hvc1", "av01", "grid", "iden", "iovl", "tmap", "jpeg", "avc1", "hvt1", "unci", "vvc1")
DESCRIPTIONS = ("Exif", "uri ", "mime", "jumb")
XMP_TYPE = b"application/rdf+xml\0"
# Auxiliary pictures that are shown, and those that only editors use.
HEVC_ALPHA = "urn:mpeg:hevc:2015:auxid:1"
SHOWN = (HEVC_ALPHA, "urn:mpeg:mpegB:cicp:systems:auxiliary:alpha", "urn:com:apple:photo:2020:aux:hdrgainmap")
EDITING = (
    "urn:mpeg:hevc:2015:auxid:2", "urn:mpeg:mpegB:cicp:systems:auxiliary:depth", "urn:com:apple:photo:2018:aux:portraiteffectsmatte",
    "tag:apple.com,2023:photo:aux:linearthumbnail", "tag:apple.com,2023:photo:aux:styledeltamap",
    "urn:com:apple:photo:2019:aux:semanticskinmatte", "urn:com:apple:photo:2019:aux:semantichairmatte", "urn:com:apple:photo:2019:aux:semanticteethmatte",
    "urn:com:apple:photo:2020:aux:semanticglassesmatte", "urn:com:apple:photo:2020:aux:semanticskymatte",
)
# Properties that decode and show, with their exact size where they have one; those that only describe.
DISPLAY = ("hvcC", "av1C", "avcC", "vvcC", "jpgC", "j2kH", "uncC", "cmpd", "lhvC", "oinf", "tols", "ispe", "pixi", "clap", "irot", "imir", "pasp", "rloc", "iscl", "a1op", "a1lx", "lsel", "colr", "clli", "mdcv", "cclv", "amve", "auxC")
DESCRIBING = ("udes", "crtt", "mdft", "altt", "cmin", "cmex", "taic", "itai")
SIZES = {"ispe": 12, "irot": 1, "imir": 1, "pasp": 8, "clap": 32, "clli": 4, "mdcv": 24, "a1op": 1, "lsel": 2, "tols": 6, "iscl": 12, "rloc": 12, "amve": 8}
VERSIONED, RESERVED = ("ispe", "pixi", "tols", "iscl", "rloc"), {"irot": 0xFC, "imir": 0xFE, "a1lx": 0xFE, "cclv": 0xC3}
UNREAD, UNREAD_BYTES, UNREAD_TOTAL = ("vvcC", "j2kH", "uncC", "cmpd", "oinf"), 2048, 8192
LAST_COLOR_CODE, LAST_OPERATING_POINT, MOST_CHANNELS, MOST_BITS = 255, 31, 4, 16
# References that may name what goes; sizes of packets, of tone maps, of lists.
LOOSE = ("dimg", "cdsc", "auxl", "thmb")
PACKET_BYTES, PACKETS_TOTAL, TONE_MAP_BYTES, MOST_ENTRIES = 1 << 20, 4 << 20, 256, 1 << 20


def _no(truth: object, key: str = "unsupported_part") -> None:
    """Broken where something holds that mustn't."""
    if truth:
        raise Broken(key)


def box(kind: str, body: bytes) -> bytes:
    return struct.pack(">I4s", len(body) + 8, kind.encode("latin-1")) + body


@dataclass
class Item:
    kind: str
    info: Span  # content of its record
    name: Span
    xmp: bool = False
    extents: list[Span] = field(default_factory=list)
    located: bytes = b""  # its record in the location table
    uses: list[tuple[int, bool]] = field(default_factory=list)  # property and whether it is essential
    role: str | None = None  # of an auxiliary picture


@dataclass
class Tables:
    """What the meta box states."""

    data: bytes
    top: list[Box]
    meta: Box
    children: list[Box]
    primary: int
    items: dict[int, Item]
    order: list[int]  # of the location table
    idat: Span | None
    place_head: bytes
    place_wide: int
    count_wide: int
    refs: list[tuple[str, int, list[int]]]
    props: list[Box]
    owners: list[tuple[Box, list[int]]]  # each association box and its items in order

    def child(self, kind: str) -> Box | None:
        return next((c for c in self.children if c[0] == kind), None)

    def prop(self, number: int) -> Box | None:
        return self.props[number - 1] if number else None

    def bytes_of(self, spans: list[Span]) -> bytes:
        return b"".join(self.data[a:b] for a, b in spans)

    def media(self) -> list[Span]:
        return sorted([(c, e) for k, _, c, e in self.top if k == "mdat"] + ([self.idat] if self.idat else []))


def tops(data: bytes) -> list[Box]:
    found = list(walk(data, 0, len(data)))
    _no(not found or found[0][0] != "ftyp", "damaged")
    return found


def _record(data: bytes, own: Box) -> tuple[int, Item]:
    kind, _, content, end = own
    _no(kind != "infe" or end - content < 13 or data[content] not in (2, 3))
    wide = 2 if data[content] == 2 else 4
    read = Cursor(data, content + 4, end)
    ident, protection = read.number(wide), read.number(2)
    code = read.skip(4).decode("latin-1")
    _no(protection or not read.left)
    stop = data.find(b"\0", read.at, end)
    _no(stop < 0, "damaged")
    return ident, Item(code, (content, end), (read.at, stop), code == "mime" and data.startswith(XMP_TYPE, stop + 1, end))


def _places(data: bytes, own: Box, idat: Span | None, items: dict[int, Item]) -> tuple[bytes, int, list[int]]:
    """Fill in the extents of all items; the table's head, the width of its ids and the ids in order."""
    read = Cursor(data, own[2], own[3], "damaged")
    version, _, sizes = read.number(1), read.number(3), read.number(2)
    _no(version > 2)
    offset, length, base, index = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
    _no({offset, length, base, index} - {0, 4, 8})
    wide, head = 4 if version == 2 else 2, bytes(data[own[2] : read.at])
    count, seen, total = read.number(wide), {}, 0
    _no(count > MOST_BOXES)
    for _ in range(count):
        begin, ident = read.at, read.number(wide)
        method, elsewhere, start = read.number(2) if version else 0, read.number(2), read.number(base)
        n = read.number(2)
        total += n
        _no(total > MOST_ENTRIES)
        item = items.get(ident)
        _no(item is None or ident in seen, "damaged")
        seen[ident] = True
        may_be_empty = item.kind in DESCRIPTIONS
        for _ in range(n):
            other, at, size = read.number(index), read.number(offset), read.number(length)
            _no(method > 1 or elsewhere or other)
            _no(method and idat is None, "damaged")
            low, limit = idat if method else (0, len(data))
            at += start + low
            _no(not size and not may_be_empty or at + size > limit, "damaged")
            item.extents.append((at, at + size))
        _no(not n and not may_be_empty, "damaged")
        item.located = bytes(data[begin : read.at])
    _no(read.left or len(seen) != len(items), "damaged")
    spans = sorted({s for i in items.values() for s in i.extents if s[0] < s[1]})
    _no(any(b[0] < a[1] for a, b in zip(spans, spans[1:], strict=False)))  # the same data or none in common
    return head, wide, list(seen)


def _references(data: bytes, own: Box, items: dict[int, Item]) -> list[tuple[str, int, list[int]]]:
    _no(own[3] - own[2] < 4 or data[own[2]] > 1, "damaged" if own[3] - own[2] < 4 else "unsupported_part")
    wide, out, total = 2 if data[own[2]] == 0 else 4, [], 0
    for kind, _, content, end in walk(data, own[2] + 4, own[3]):
        read = Cursor(data, content, end, "damaged")
        origin, n = read.number(wide), read.number(2)
        _no(read.left != n * wide, "damaged")
        total += 1 + n
        _no(total > MOST_ENTRIES)
        targets = [read.number(wide) for _ in range(n)]
        _no(origin not in items or any(t not in items for t in targets), "damaged")
        out.append((kind, origin, targets))
    return out


def _associations(data: bytes, parts: list[Box], props: list[Box], items: dict[int, Item]) -> list[tuple[Box, list[int]]]:
    owners, seen = [], set()
    for part in parts:
        if part[0] != "ipma":
            continue
        read = Cursor(data, part[2], part[3], "damaged")
        version, flags = read.number(1), read.number(3)
        _no(version > 1 or flags & ~1)
        wide, index_wide = (4 if version else 2), (2 if flags & 1 else 1)
        essential, listed = 1 << 8 * index_wide - 1, []
        for _ in range(read.number(4)):
            ident, n = read.number(wide), read.number(1)
            _no(ident not in items)  # groups of pictures may have properties, too
            _no(ident in seen, "damaged")
            seen.add(ident)
            values = [read.number(index_wide) for _ in range(n)]
            uses = [(v & ~essential, bool(v & essential)) for v in values]
            named = [p for p, _ in uses if p]
            _no(len(set(named)) != len(named) or any(p > len(props) for p in named), "damaged")
            items[ident].uses = uses
            listed.append(ident)
        _no(read.left, "damaged")
        owners.append((part, listed))
    return owners


def tables(data: bytes) -> Tables | None:
    """The relations of a file, None without a meta box."""
    top = tops(data)
    metas = [b for b in top if b[0] == "meta"]
    if not metas:
        return None
    meta = metas[0]
    _no(data[meta[2] : meta[2] + 4] != bytes(4))
    children = list(walk(data, meta[2] + 4, meta[3]))
    own = {kind: b for kind, *b in ((c[0], *c) for c in children)}
    count = defaultdict(int)
    for c in children:
        count[c[0]] += 1
    _no(any(count[k] != 1 for k in ("pitm", "iinf", "iloc")) or any(count[k] > 1 for k in ("idat", "iref", "iprp")))
    read = Cursor(data, own["pitm"][2], own["pitm"][3], "damaged")
    version = read.number(1)
    _no(version > 1 or read.left != (7 if version else 5), "damaged")
    read.skip(3)
    primary = read.number(read.left)
    read = Cursor(data, own["iinf"][2], own["iinf"][3])
    version = read.number(1)
    _no(version > 1)
    read.skip(3)
    count_wide = 4 if version else 2
    n = read.number(count_wide)
    records = list(walk(data, read.at, read.end))
    _no(len(records) != n, "damaged")
    items: dict[int, Item] = {}
    for record in records:
        ident, item = _record(data, record)
        _no(ident in items, "damaged")
        items[ident] = item
    _no(primary not in items, "damaged")
    idat = tuple(own["idat"][2:]) if "idat" in own else None
    head, wide, order = _places(data, own["iloc"], idat, items)
    refs = _references(data, own["iref"], items) if "iref" in own else []
    props, owners = [], []
    if "iprp" in own:
        parts = list(walk(data, own["iprp"][2], own["iprp"][3]))
        kinds = [p[0] for p in parts]
        _no(kinds.count("ipco") != 1 or set(kinds) - {"ipco", "ipma", "free"})
        holder = parts[kinds.index("ipco")]
        props = list(walk(data, holder[2], holder[3]))
        owners = _associations(data, parts, props, items)
    out = Tables(data, top, meta, children, primary, items, order, idat, head, wide, count_wide, refs, props, owners)
    for item in items.values():
        roles = [_role(data, p) for p in (out.prop(n) for n, _ in item.uses) if p and p[0] == "auxC"]
        _no(len(roles) > 1)
        item.role = roles[0] if roles else None
    return out


def _role(data: bytes, prop: Box) -> str:
    stop = data.find(b"\0", prop[2] + 4, prop[3])
    _no(data[prop[2] : prop[2] + 4] != bytes(4) or stop < 0, "damaged")
    return data[prop[2] + 4 : stop].decode("latin-1")


# ------------------------------------------------------------------ decisions


def merged(spans: list[Span]) -> list[Span]:
    """Disjoint spans that cover the same bytes, in order; empty ones go."""
    out: list[list[int]] = []
    for a, b in sorted(s for s in spans if s[0] < s[1]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def gaps(within: list[Span], used: list[Span]) -> Iterator[Span]:
    """The bytes of ``within`` that ``used`` doesn't cover."""
    used, n = merged(used), 0
    for a, b in merged(within):
        while n < len(used) and used[n][1] <= a:
            n += 1
        k = n
        while k < len(used) and used[k][0] < b:
            if a < used[k][0]:
                yield a, used[k][0]
            a, k = max(a, used[k][1]), k + 1
        if a < b:
            yield a, b


def meet(one: list[Span], two: list[Span]) -> bool:
    """Whether two lists of spans have a byte in common."""
    both = sorted([(a, b, 0) for a, b in merged(one)] + [(a, b, 1) for a, b in merged(two)])
    return any(x[2] != y[2] and y[0] < x[1] for x, y in zip(both, both[1:], strict=False))


def reachable(edges: dict[int, list[int]], seeds: set[int]) -> set[int]:
    """The seeds and everything that they are built from."""
    seen, new = set(seeds), set(seeds)
    while new:
        new = {t for origin in new for t in edges.get(origin, ())} - seen
        seen |= new
    return seen


def packets(own: Tables) -> dict[int, bytes | Broken]:
    """For each XMP item its rendering fields in the space that it has, empty without any, or why it can't be reduced."""
    made: dict[tuple, bytes | Broken] = {}
    out, total = {}, 0
    for ident, item in own.items.items():
        if not item.xmp:
            continue
        spans = tuple(item.extents)
        if spans not in made:
            size = sum(b - a for a, b in spans)
            if size > PACKET_BYTES:  # no packet of a photo is that large
                made[spans] = b""
            else:
                total += size
                _no(total > PACKETS_TOTAL)
                made[spans] = _reduced(own.bytes_of(list(spans)))
        out[ident] = made[spans]
    return out


def _reduced(raw: bytes) -> bytes | Broken:
    try:
        small = hdr.packet(hdr.rendering_fields(raw)) if raw else b""
    except hdr.BadPacket:
        return Broken("unsupported_part")
    if len(small) > len(raw):
        return Broken("unsupported_part")
    return small + b" " * (len(raw) - len(small)) if small else b""


def check_items(own: Tables) -> None:
    """Broken where an item can't be judged."""
    describing = {i for i, item in own.items.items() if item.kind in DESCRIPTIONS}
    _no(any(item.kind not in PICTURES + DESCRIPTIONS or item.role not in (None, *SHOWN, *EDITING) for item in own.items.values()))
    for kind, origin, targets in own.refs:
        _no(origin in describing and kind != "cdsc" or not describing.isdisjoint(targets))
    _no(next(gaps([s for item in own.items.values() for s in item.extents], own.media()), None))
    for item in own.items.values():
        if item.kind == "tmap":
            _no(sum(b - a for a, b in item.extents) > TONE_MAP_BYTES)
            body = own.bytes_of(item.extents)
            _no(body[:1] != b"\0" or hdr.gain_map_size(body[1:], full=True) != len(body) - 1)


def removed(own: Tables, reduced: dict[int, bytes | Broken]) -> set[int]:
    """Items that go: descriptions, editing pictures, thumbnails, and what only they are built from."""
    seeds = {i for i, item in own.items.items() if item.kind in DESCRIPTIONS and not item.xmp or item.role in EDITING}
    seeds |= {origin for kind, origin, _ in own.refs if kind == "thmb"} | {i for i, body in reduced.items() if body == b""}
    edges = defaultdict(list)
    for kind, origin, targets in own.refs:
        if kind == "dimg":
            edges[origin] += targets
    candidates = reachable(edges, seeds)
    needed = reachable(edges, set(own.items) - candidates)
    _no(own.primary in candidates or seeds & needed)
    gone = candidates - needed
    for kind, origin, targets in own.refs:
        if kind == "cdsc" and targets and gone.issuperset(targets):  # describes only what goes
            _no(own.items[origin].kind not in DESCRIPTIONS)
            gone.add(origin)
    return gone


def check_streams(own: Tables, live: set[int]) -> None:
    """JPEG items hold what decodes them and nothing else, their header before their data."""
    seen = set()
    for ident in live:
        item = own.items[ident]
        if item.kind != "jpeg":
            continue
        head = b"".join(own.data[p[2] : p[3]] for p in (own.prop(n) for n, _ in item.uses) if p and p[0] == "jpgC")
        if (head, tuple(item.extents)) in seen:
            continue
        seen.add((head, tuple(item.extents)))
        body, soi = own.bytes_of(item.extents), b"\xff\xd8"
        if head and not body.startswith(soi):
            head = head if head.startswith(soi) else soi + head
        _no(not plain_jpeg(head + body))


def plain_jpeg(stream: bytes, with_scan: bool = True) -> bool:
    """Whether a JPEG stream holds only coding segments, JFIF's without thumbnail and Adobe's, up to its very end."""
    coding = {jpeg.EOI, jpeg.DQT, jpeg.DHT, jpeg.DAC, jpeg.DRI, jpeg.DNL, *jpeg.FRAMES, *range(0xD0, 0xD8)}
    if not stream.startswith(b"\xff\xd8") or not stream.endswith(b"\xff\xd9"):
        return False
    try:
        found = list(jpeg.segments(stream))
    except Broken:
        return False
    for marker, body, _ in found:
        jfif = marker == 0xE0 and body.startswith(b"JFIF\0") and len(body) == 14 and not any(body[12:])
        adobe = marker == 0xEE and body.startswith(b"Adobe") and len(body) == 12
        if not (marker in coding or marker == jpeg.SOS and with_scan or jfif or adobe):
            return False
    try:  # without its last two bytes the stream must lack an end
        return len(list(jpeg.segments(stream[:-2]))) < 0
    except Broken:
        return True


def kept_properties(own: Tables, live: set[int]) -> set[int]:
    """Numbers of the properties that live items keep."""
    kept, unread = set(), 0
    for ident in live:
        for number, essential in own.items[ident].uses:
            prop = own.prop(number)
            if prop is None or number in kept:
                continue
            if prop[0] in DISPLAY:
                check_property(own.data, prop)
                unread += prop[3] - prop[2] if prop[0] in UNREAD else 0
                _no(unread > UNREAD_TOTAL)
                kept.add(number)
            else:
                _no(essential and prop[0] not in DESCRIBING)
    return kept


def check_property(data: bytes, prop: Box) -> None:
    """Broken if a property holds more than it should or a value that means nothing."""
    kind, _, content, end = prop
    configs.check(kind, data, content, end)
    body = bytes(data[content:end])
    size, first = len(body), body[0] if body else 0
    _no(kind in VERSIONED and any(body[:4]) or first & RESERVED.get(kind, 0))
    if kind == "pixi":
        _no(size < 5 or not 1 <= body[4] <= MOST_CHANNELS or size != 5 + body[4] or not all(1 <= b <= MOST_BITS for b in body[5:]))
    elif kind == "colr":
        _no(body[:4] not in (b"nclx", b"prof", b"rICC"))
        if body[:4] == b"nclx":
            _no(size not in (10, 11) or max(struct.unpack_from(">HHH", body, 4)) > LAST_COLOR_CODE or size == 11 and body[10] & 0x7F)
    elif kind == "a1lx":
        _no(size != (13 if first & 1 else 7))
    elif kind == "cclv":
        _no(size != 1 + (24 if first & 0x20 else 0) + 4 * (first & 0x1C).bit_count())
    elif kind == "a1op":
        _no(size != 1 or first > LAST_OPERATING_POINT)
    elif kind == "auxC":
        _no(not _plain_role(body))
    elif kind == "jpgC":
        bare = body[2:] if body.startswith(b"\xff\xd8") else body
        _no(not plain_jpeg(b"\xff\xd8" + bare + b"\xff\xd9", with_scan=False))
    elif kind in UNREAD:
        _no(size > UNREAD_BYTES)
    else:
        _no(size != SIZES.get(kind, size))


def _plain_role(body: bytes) -> bool:
    """A role and nothing behind it, but for one message of alpha channel information."""
    role, zero, tail = body[4:].partition(b"\0")
    if not zero or not tail:
        return bool(zero)
    # A prefix SEI unit with one message of type 165, of at most 8 bytes.
    if role.decode("latin-1") != HEVC_ALPHA or len(tail) < 12:
        return False
    total, size = struct.unpack_from(">II", tail)
    unit = tail[8:]
    return total == len(tail) - 4 == 4 + size and unit[:3] == b"\x4e\x01\xa5" and unit[3] <= 8 and size == 4 + unit[3]


def check_groups(own: Tables, gone: set[int]) -> None:
    """Groups of alternatives name items, each once, and lose none."""
    for group in own.children:
        if group[0] != "grpl":
            continue
        for kind, _, content, end in walk(own.data, group[2], group[3]):
            _no(kind != "altr" or own.data[content : content + 4] != bytes(4) or end - content < 12)
            read = Cursor(own.data, content + 4, end, "damaged")
            name, n = read.number(4), read.number(4)
            _no(read.left != 4 * n, "damaged")
            members = [read.number(4) for _ in range(n)]
            _no(name in own.items or any(m not in own.items for m in members) or len(set(members)) != n, "damaged")
            _no(not gone.isdisjoint(members))


# -------------------------------------------------------------------- patches


def _blank(own: Box) -> bytes:
    return box("free", bytes(own[3] - own[1] - 8))


def _information(own: Tables, live: set[int]) -> bytes:
    """The records of live items: names blanked, of the flags only "hidden", behind the name only the type of XMP."""
    head, out = own.child("iinf")[2], []
    for ident, item in own.items.items():
        if ident in live:
            (content, end), (name, stop) = item.info, item.name
            tail = XMP_TYPE if item.xmp else b""
            start = bytes([own.data[content], 0, 0, own.data[content + 3] & 1]) + own.data[content + 4 : name]
            out.append(box("infe", start + b" " * (stop - name) + b"\0" + tail + bytes(end - stop - 1 - len(tail))))
    return box("iinf", own.data[head : head + 4] + len(out).to_bytes(own.count_wide, "big") + b"".join(out))


def _relations(own: Tables, gone: set[int]) -> bytes:
    head, out = own.child("iref")[2], []
    wide = 2 if own.data[head] == 0 else 4
    for kind, origin, targets in own.refs:
        if origin in gone or not gone.isdisjoint(targets):
            _no(kind not in LOOSE)
            if origin in gone:
                continue
            _no(kind == "dimg")
            targets = [t for t in targets if t not in gone]
            if not targets:
                continue
        out.append(box(kind, b"".join(n.to_bytes(w, "big") for n, w in ((origin, wide), (len(targets), 2), *((t, wide) for t in targets)))))
    return box("iref", own.data[head : head + 4] + b"".join(out))


def _property_box(own: Tables, live: set[int], kept: set[int]) -> bytes:
    """Properties keep their numbers: those that go become free boxes, and uses of them number 0."""
    whole, out, listed = own.child("iprp"), [], dict(own.owners)
    for part in walk(own.data, whole[2], whole[3]):
        kind, start, content, _ = part
        if kind == "ipco":
            out.append(box("ipco", b"".join(own.data[p[1] : p[3]] if n in kept else _blank(p) for n, p in enumerate(own.props, 1))))
        elif kind == "ipma":
            wide, index_wide = (4 if own.data[content] else 2), (2 if own.data[content + 3] & 1 else 1)
            essential, rows = 1 << 8 * index_wide - 1, []
            for ident in listed[part]:
                if ident in live:
                    uses = own.items[ident].uses
                    rows.append(ident.to_bytes(wide, "big") + bytes([len(uses)]) + b"".join((n | essential * e if n in kept else 0).to_bytes(index_wide, "big") for n, e in uses))
            out.append(box("ipma", own.data[content : content + 4] + len(rows).to_bytes(4, "big") + b"".join(rows)))
        else:
            out.append(_blank(part))
    return box("iprp", b"".join(out))


def _filled(start: int, end: int, parts: list[bytes]) -> bytes:
    """The parts and a free box over the rest of their space."""
    body = b"".join(parts)
    rest = end - start - len(body)
    _no(rest < 0 or 0 < rest < 8)
    return body + (box("free", bytes(rest - 8)) if rest else b"")


def _unnamed(data: bytes, own: Box) -> bytes:
    """A box of meta that stays as it is, without a handler's name and locations of data."""
    kind, start, content, end = own
    whole = bytearray(data[start:end])
    if kind == "hdlr":
        # Version, flags and types come first; a vendor, flags and the name go.
        _no(end - content < 12)
        whole[content - start + 12 :] = bytes(end - content - 12)
    elif kind == "dinf":
        for part in walk(data, content, end):
            a, b = part[2] - start, part[3] - start
            if part[0] != "dref":
                whole[part[1] - start + 4 : part[1] - start + 8] = b"free"
                whole[a:b] = bytes(b - a)
                continue
            _no(b - a < 8, "damaged")
            for entry in walk(data, part[2] + 8, part[3]):
                # References to the file itself.
                _no(entry[0] not in ("url ", "urn ", "alis") or data[entry[2] : entry[2] + 4] != b"\0\0\0\1")
                whole[entry[2] + 4 - start : entry[3] - start] = bytes(entry[3] - entry[2] - 4)
    return bytes(whole)


def _meta(own: Tables, gone: set[int], live: set[int]) -> Iterator[tuple[int, bytes]]:
    """Patches of the meta box: tables without what goes, everything else blanked; item data stays where it is."""
    records = [own.items[ident].located for ident in own.order if ident in live]
    new = {
        "iinf": lambda: _information(own, live), "iloc": lambda: box("iloc", own.place_head + len(records).to_bytes(own.place_wide, "big") + b"".join(records)),
        "iref": lambda: _relations(own, gone), "iprp": lambda: _property_box(own, live, kept_properties(own, live)),
    }
    check_groups(own, gone)
    begin, parts = own.meta[2] + 4, []
    for child in own.children:
        if child[0] == "idat":
            yield begin, _filled(begin, child[1], parts)
            begin, parts = child[3], []
        else:
            parts.append(new[child[0]]() if child[0] in new else _unnamed(own.data, child) if child[0] in IN_META else _blank(child))
    yield begin, _filled(begin, own.meta[3], parts)


def brand_patches(data: bytes, own: Box) -> Iterator[tuple[int, bytes]]:
    """Compatible brands that say nothing of how to read the file become zeros."""
    known = (*AVIF_BRANDS, *HEIF_BRANDS, *OTHER_BRANDS)
    size, word = own[3] - own[2], lambda at: data[at : at + 4].decode("latin-1")
    _no(size < 8 or size % 4 or size > FILE_TYPE_BYTES or word(own[2]) not in known)
    for at in range(own[2] + 8, own[3], 4):
        if word(at) not in known:
            yield at, bytes(4)


def patches(data: bytes) -> tuple[list[tuple[int, bytes]], int]:
    """(start, bytes) of every change and the length of the clean copy; later patches overrule earlier ones."""
    top = tops(data)
    kinds = [b[0] for b in top]
    _no(set(kinds) & {*NOT_AT_TOP, "moov"})
    _no(kinds.count("meta") > 1, "damaged")
    own = tables(data)
    _no(own is None, "damaged")
    out = list(brand_patches(data, top[0]))
    check_items(own)
    reduced = packets(own)
    gone = removed(own, reduced)
    live = set(own.items) - gone
    check_streams(own, live)
    used = [s for i in live for s in own.items[i].extents]
    _no(meet([s for i in gone for s in own.items[i].extents], used))
    out += [(a, bytes(b - a)) for a, b in gaps(own.media(), used)]
    for ident in live & set(reduced):
        body, at = reduced[ident], 0
        if isinstance(body, Broken):
            raise body
        for a, b in own.items[ident].extents:
            out.append((a, body[at : at + b - a]))
            at += b - a
    out += _meta(own, gone, live)
    last = 0
    for n, (kind, start, content, end) in enumerate(top):
        if kind in TOP and (kind != "ftyp" or not n):
            last = end
        else:
            out += [(start + 4, b"free"), (content, bytes(end - content))]
    return out, last


def _profile_spans(own: Tables, ident: int) -> list[Span]:
    found = [own.prop(n) for n, _ in own.items[ident].uses if n]
    return [(p[2] + 4, p[3]) for p in found if p[0] == "colr" and own.data[p[2] : p[2] + 4] in (b"prof", b"rICC")]


def clean(data: bytes) -> bytes:
    """The clean copy of a file; Broken says why there is none."""
    changes, length = patches(data)
    out = bytearray(data)
    for at, body in changes:
        out[at : at + len(body)] = body
    del out[length:]
    # Profiles are reduced where they now stand.
    own, done = tables(bytes(out)), set()
    for ident in own.items:
        for a, b in _profile_spans(own, ident):
            if (a, b) not in done:
                done.add((a, b))
                out[a:b] = _small_profile(own.data[a:b])
    return bytes(out)


def _small_profile(raw: bytes) -> bytes:
    try:
        small = icc.clean_profile(raw)
    except icc.BadProfile:
        raise Broken("unsupported_profile") from None
    _no(len(small) != len(raw), "unsupported_profile")
    return small


# ---------------------------------------------------------------- verification


def clean_and_prove(data: bytes) -> tuple[bytes, bool]:
    """The clean copy, and whether cleaning it again changes nothing and ``difference`` finds none."""
    result = clean(data)
    try:
        return result, clean(result) == result and difference(data, result) is None
    except Broken:
        return result, False


def difference(original: bytes, result: bytes) -> str | None:
    """What a result holds that it mustn't, or lacks; None if it is a clean copy of the original."""
    try:
        return _difference(original, result)
    except Broken as broken:
        return broken.key


def _difference(original: bytes, result: bytes) -> str | None:
    before, after = tables(original), tables(result)
    if before is None or after is None or before.primary != after.primary or not set(after.items) <= set(before.items):
        return "items"
    for n, (kind, _, content, end) in enumerate(after.top):
        if kind not in TOP and (kind != "free" or any(result[content:end])) or kind == "ftyp" and n:
            return "boxes"
    first, own = before.top[0], after.top[0]
    cleared = dict(brand_patches(original, first))
    if own != first or any(result[k : k + 4] != cleared.get(k, original[k : k + 4]) for k in range(own[1], own[3], 4)):
        return "brands"
    for kind, _, content, end in after.children:
        if kind not in IN_META and (kind != "free" or any(result[content:end])):
            return "tables"
        if kind in ("hdlr", "dinf") and _unnamed(result, (kind, content - 8, content, end)) != result[content - 8 : end]:
            return "names"
    check_items(after)
    check_streams(after, set(after.items))
    if any(kind == "thmb" for kind, _, _ in after.refs):
        return "thumbnails"
    used, packets_seen = [], set()
    for ident, item in after.items.items():
        then = before.items[ident]
        if item.kind in DESCRIPTIONS and not item.xmp or item.role in EDITING or item.kind != then.kind:
            return "items"
        if item.extents != then.extents:
            return "moved"
        used += item.extents
        (content, end), (name, stop) = item.info, item.name
        tail = XMP_TYPE if item.xmp else b""
        if result[name:stop].strip(b" ") or result[stop + 1 : end] != tail + bytes(end - stop - 1 - len(tail)) or any(result[content + 1 : content + 3]) or result[content + 3] > 1:
            return "names"
        if item.xmp:
            if tuple(item.extents) not in packets_seen:
                packets_seen.add(tuple(item.extents))
                body = after.bytes_of(item.extents).rstrip(b" ")
                if not body or hdr.packet(hdr.rendering_fields(body)) != body:
                    return "packet"
        old, new = ([t.data[a:b] for a, b in _profile_spans(t, ident)] for t in (before, after))
        if len(old) != len(new) or any(n != o and n != _small_profile(o) for n, o in zip(new, old, strict=True)):
            return "profile"
        for number, _ in item.uses:
            prop = after.prop(number)
            if prop and prop[0] not in DISPLAY:
                return "properties"
    kept_properties(after, set(after.items))
    pictures = merged([s for item in after.items.values() if not item.xmp for s in item.extents])
    if any(original[a:b] != result[a:b] for a, b in pictures):
        return "pictures"
    if any(any(result[a:b]) for a, b in gaps(after.media(), used)):
        return "unused data"
    return None
