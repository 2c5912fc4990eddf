"""Boxed files written from a description: parts in order, with marks, and offsets that name a mark."""

from __future__ import annotations

import struct
from dataclasses import dataclass


@dataclass(frozen=True)
class Mark:
    """A place in the file that offsets can name."""

    name: object


@dataclass(frozen=True)
class At:
    """Four bytes with the place of a mark, counted from another one or from the start."""

    name: object
    base: object = None
    plus: int = 0


@dataclass(frozen=True)
class Nest:
    """A box whose content may hold marks and offsets."""

    kind: bytes
    content: tuple


def nest(kind: bytes, *content) -> Nest:
    return Nest(kind, content)


def written(*parts) -> bytes:
    """The parts one after the other, boxes with their sizes, offsets filled in."""
    out, marks, holes = bytearray(), {None: 0}, []

    def put(part) -> None:
        if isinstance(part, bytes):
            out.extend(part)
        elif isinstance(part, Mark):
            marks[part.name] = len(out)
        elif isinstance(part, At):
            holes.append((len(out), part))
            out.extend(bytes(4))
        elif isinstance(part, Nest):
            start = len(out)
            out.extend(bytes(4) + part.kind)
            put(part.content)
            out[start : start + 4] = (len(out) - start).to_bytes(4, "big")
        else:
            for own in part:
                put(own)

    put(parts)
    for place, hole in holes:
        out[place : place + 4] = (marks[hole.name] - marks[hole.base] + hole.plus).to_bytes(4, "big")
    return bytes(out)


def box(kind: bytes, *content: bytes) -> bytes:
    return written(nest(kind, *content))


def full(kind: bytes, body: bytes, version: int = 0) -> bytes:
    """A box with a version and no flags."""
    return box(kind, bytes((version, 0, 0, 0)), body)


def u16(*numbers: int) -> bytes:
    return struct.pack(f">{len(numbers)}H", *numbers)


def u32(*numbers: int) -> bytes:
    return struct.pack(f">{len(numbers)}I", *numbers)
