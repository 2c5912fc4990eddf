"""Display fields of EXIF blocks: read leniently, written as a fresh minimal block."""

from __future__ import annotations

import struct

#: Bytes of one value of each TIFF field type.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
_ORIENTATION = 0x0112


def entries(block: bytes, at: int, order: str) -> dict[int, tuple[int, int, memoryview]]:
    """Fields of the directory at ``at`` as tag to (type, count, value); fields out of bounds are left out.

    Values are views: a directory may name one large range any number of times.
    """
    if not 8 <= at <= len(block) - 2:
        return {}
    (n,) = struct.unpack_from(order + "H", block, at)
    if at + 2 + 12 * n > len(block):
        return {}
    out, view = {}, memoryview(block)
    for k in range(n):
        tag, kind, count, value = struct.unpack_from(order + "HHII", block, at + 2 + 12 * k)
        size = SIZES.get(kind, 0) * count
        start = at + 10 + 12 * k if size <= 4 else value
        if size and start + size <= len(block):
            out[tag] = (kind, count, view[start : start + size])
    return out


def orientation(block: bytes) -> int | None:
    """How the pixels are turned, 1 to 8; None if absent or not one short integer."""
    block = block.removeprefix(b"Exif\0\0")
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None or len(block) < 8:
        return None
    magic, first = struct.unpack_from(order + "HI", block, 2)
    kind, count, value = entries(block, first, order).get(_ORIENTATION, (0, 0, b"")) if magic == 42 else (0, 0, b"")
    if (kind, count) != (3, 1):
        return None
    (turn,) = struct.unpack(order + "H", value)
    return turn if 1 <= turn <= 8 else None


# Tags of the fields that change how an image is shown.
_X, _Y, _UNIT, _EXIF, _INTEROP, _SPACE, _INDEX, _MAKER = 0x011A, 0x011B, 0x0128, 0x8769, 0xA005, 0xA001, 0x0001, 0x927C
# What Apple's note begins with, and its numbers for rendering in high dynamic range: headroom and gain.
NOTE, NOTE_TAGS = b"Apple iOS\0\0\x01", (0x0021, 0x0030)


def rendering_note(note: bytes) -> bytes | None:
    """Apple's note with its rendering numbers alone; None if it has none or one can't be read."""
    order = {b"II": "<", b"MM": ">"}.get(note[len(NOTE) : len(NOTE) + 2])
    at = len(NOTE) + 2
    if not note.startswith(NOTE) or order is None or len(note) < at + 2:
        return None
    values = []
    for k in range(struct.unpack_from(order + "H", note, at)[0]):
        if at + 14 + 12 * k > len(note):
            return None
        tag, kind, count, place = struct.unpack_from(order + "HHII", note, at + 2 + 12 * k)
        if tag in NOTE_TAGS and kind == 10 and count == 1:
            if place + 8 > len(note):
                return None
            value = struct.unpack_from(order + "ii", note, place)
            if not value[1]:
                return None
            values.append((tag, value))
    if not values:
        return None
    room = len(NOTE) + 8 + 12 * len(values)
    table = b"".join(struct.pack(">HHII", tag, 10, 1, room + 8 * k) for k, (tag, _) in enumerate(values))
    return NOTE + b"MM" + len(values).to_bytes(2, "big") + table + bytes(4) + b"".join(struct.pack(">ii", *v) for _, v in values)


def display(block: bytes) -> dict:
    """``turn``, ``resolution`` ((x, y) as fractions and a unit), ``space``, ``index`` and ``note``; what can't be read is None."""
    block = block.removeprefix(b"Exif\0\0")
    out: dict = {"turn": orientation(block), "resolution": None, "space": None, "index": None, "note": None}
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None or len(block) < 8 or struct.unpack_from(order + "H", block, 2) != (42,):
        return out

    def value(fields: dict, tag: int, kinds: tuple, code: str):
        kind, count, body = fields.get(tag, (0, 0, b""))
        return struct.unpack(order + code, body) if kind in kinds and count == 1 else None

    def below(fields: dict, tag: int) -> dict:
        at = value(fields, tag, (4, 13), "I")
        return entries(block, at[0], order) if at else {}

    top = entries(block, struct.unpack_from(order + "I", block, 4)[0], order)
    x, y = value(top, _X, (5,), "II"), value(top, _Y, (5,), "II")
    unit = (value(top, _UNIT, (3,), "H") or (2,))[0] or 2
    if x and y and all((*x, *y)) and unit in (1, 2, 3):
        out["resolution"] = (x, y, unit)
    camera = below(top, _EXIF)
    space = value(camera, _SPACE, (3,), "H")
    out["space"] = space[0] if space else None
    kind, _, name = below(camera, _INTEROP).get(_INDEX, (0, 0, b""))
    name = bytes(name[:16]).rstrip(b"\0") if kind == 2 and not any(name[16:]) else b""
    out["index"] = name if name in (b"R98", b"R03") else None
    kind, _, note = camera.get(_MAKER, (0, 0, b""))
    out["note"] = rendering_note(bytes(note)) if kind in (1, 7) else None  # some writers say bytes
    return out


def _directory(fields: list[tuple[int, int, bytes]], at: int) -> bytes:
    """A big-endian directory that starts at ``at``, values of more than four bytes behind it."""
    table, behind = len(fields).to_bytes(2, "big"), b""
    room = at + 6 + 12 * len(fields)
    for tag, kind, body in sorted(fields):
        table += struct.pack(">HHI", tag, kind, len(body) // SIZES[kind])
        if len(body) <= 4:
            table += body.ljust(4, b"\0")
        else:
            table += (room + len(behind)).to_bytes(4, "big")
            behind += body + bytes(len(body) % 2)
    return table + bytes(4) + behind


def build(fields: dict) -> bytes:
    """A big-endian block with the given display fields alone; empty if there are none."""
    levels: list[list[tuple[int, int, bytes]]] = [[], [], []]
    if fields["turn"]:
        levels[0].append((_ORIENTATION, 3, struct.pack(">H", fields["turn"])))
    if fields["resolution"]:
        x, y, unit = fields["resolution"]
        levels[0] += [(_X, 5, struct.pack(">II", *x)), (_Y, 5, struct.pack(">II", *y)), (_UNIT, 3, struct.pack(">H", unit))]
    if fields["space"] is not None:
        levels[1].append((_SPACE, 3, struct.pack(">H", fields["space"])))
    if fields.get("note"):
        levels[1].append((_MAKER, 7, fields["note"]))
    if fields["index"]:
        levels[2].append((_INDEX, 2, fields["index"] + b"\0"))
    while levels and not levels[-1]:
        levels.pop()
    if not levels:
        return b""
    for level, pointer in zip(levels, (_EXIF, _INTEROP), strict=False):
        if level is not levels[-1]:
            level.append((pointer, 4, bytes(4)))
    at, out = 8, b""
    for n, level in enumerate(levels):
        after = at + len(_directory(level, at))
        if n + 1 < len(levels):
            level[-1] = (*level[-1][:2], after.to_bytes(4, "big"))
        out += _directory(level, at)
        at = after
    return struct.pack(">2sHI", b"MM", 42, 8) + out


def minimal(turn: int | None) -> bytes | None:
    """A big-endian block with the orientation alone; None if it says nothing."""
    if turn in (None, 1):
        return None
    return struct.pack(">2sHIHHHIHHI", b"MM", 42, 8, 1, _ORIENTATION, 3, 1, turn, 0, 0)
