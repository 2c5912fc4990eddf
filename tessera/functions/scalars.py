"""Scalar expressions on bytes, names and text, all inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unsigned(value: Column, start: int, size: int, little: bool = False) -> Column:
    """The unsigned integer of up to seven bytes at ``start`` (from 1); null where the bytes are missing."""
    total = F.lit(0).cast("long")
    for k in range(size):
        at = start + (size - 1 - k if little else k)
        total = total * 256 + F.conv(F.hex(F.substring(value, at, 1)), 16, 10).cast("long")
    return F.when(F.octet_length(value) >= start + size - 1, total)


def visible(text: Column) -> Column:
    """Control characters (below 0x20, 0x7F to 0x9F) as \\xNN, everything else unchanged."""
    shown = text
    for code in (*range(0x20), *range(0x7F, 0xA0)):
        shown = F.replace(shown, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return F.when(text.rlike(r"[\x00-\x1F\x7F-\x9F]"), shown).otherwise(text)


def output_suffix(name: Column, allowed: list[str], default: str) -> Column:
    """The name's own suffix if its format allows it in any case, else the default one."""
    own = F.regexp_extract(name, r"(\.[^./]*)$", 1)
    return F.when(F.lower(own).isin(*allowed), own).otherwise(F.lit(default))


def same_proportions(w: Column, h: Column, big_w: Column, big_h: Column) -> Column:
    """Whether two sizes have equal proportions up to rounding and the first fits the second."""
    return (w <= big_w) & (h <= big_h) & (w > 0) & (h > 0) & (F.abs(w * big_h - h * big_w) <= F.greatest(big_w, big_h))


def aligned(size: Column, to: int) -> Column:
    return (F.floor((size + (to - 1)) / to) * to).cast("long")


def scanline_bytes(width: Column, height: Column, bits: Column, interlaced: Column) -> Column:
    """Bytes of an image's filtered scanlines; interlaced images sum over the passes that have pixels."""
    #: Start and step of columns and rows of the seven passes.
    passes = ((0, 8, 0, 8), (4, 8, 0, 8), (0, 4, 4, 8), (2, 4, 0, 4), (0, 2, 2, 4), (1, 2, 0, 2), (0, 1, 1, 2))
    line = lambda n: F.ceil(n * bits / 8) + 1
    total = F.lit(0).cast("long")
    for x, dx, y, dy in passes:
        columns, rows = F.floor((width - x + dx - 1) / dx), F.floor((height - y + dy - 1) / dy)
        total = total + F.when((columns > 0) & (rows > 0), rows * line(columns)).otherwise(0)
    return F.when(interlaced, total).otherwise(height * line(width)).cast("long")


def all_zero(value: Column) -> Column:
    """Whether every byte is zero; an empty value is."""
    return F.translate(F.hex(value), "0", "") == ""


def equal_outside(one: Column, two: Column, start: Column, end: Column) -> Column:
    """Whether two byte strings agree but for the span [start, end)."""
    head = F.substring(one, F.lit(1), start) == F.substring(two, F.lit(1), start)
    rest = F.substring(one, end + 1, F.octet_length(one)) == F.substring(two, end + 1, F.octet_length(two))
    return head & rest & (F.octet_length(one) == F.octet_length(two))


def fixed_point(value: Column, start: int) -> Column:
    """The signed 16.16 fixed-point number at ``start`` as a double."""
    whole = unsigned(value, start, 4)
    return F.when(whole >= 1 << 31, whole - (1 << 32)).otherwise(whole) / 65536
