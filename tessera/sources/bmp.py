"""BMP pictures as PNGs with the same pixels, resolution and profile."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from tessera.sources.jpeg import Broken

# Header sizes and compression methods of the format, and its names for profiles.
CORE, INFO, V5 = 12, 40, 124
PLAIN, RLE8, RLE4, FIELDS, ALPHA_FIELDS = 0, 1, 2, 3, 6
EMBEDDED, LINKED = 0x4D424544, 0x4C494E4B
MOST_PIXELS = 268_000_000


def _need(truth: bool, key: str = "damaged") -> None:
    if not truth:
        raise Broken(key)


def _run_lengths(data: bytes, width: int, height: int) -> np.ndarray:
    """Rows, the lowest first, of 8-bit run-length data."""
    out, x, y, at = np.zeros((height, width), np.uint8), 0, 0, 0
    while at + 1 < len(data):
        n, value = data[at], data[at + 1]
        at += 2
        if n:
            _need(y < height and x + n <= width)
            out[y, x : x + n] = value
            x += n
        elif value == 0:
            x, y = 0, y + 1
        elif value == 1:
            return out
        elif value == 2:
            _need(at + 2 <= len(data))
            x, y, at = x + data[at], y + data[at + 1], at + 2
        else:
            _need(y < height and x + value <= width and at + value <= len(data))
            out[y, x : x + value] = np.frombuffer(data, np.uint8, value, at)
            x, at = x + value, at + value + value % 2
    raise Broken()


def _channel(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The bits of a mask as 8-bit values."""
    if not mask:
        return np.zeros(pixels.shape, np.uint8)
    shift, top = (mask & -mask).bit_length() - 1, mask >> ((mask & -mask).bit_length() - 1)
    return (((pixels & mask) >> shift).astype(np.float64) * 255 / top + 0.5).astype(np.uint8)


def as_png(data: bytes) -> bytes:
    """The picture as a PNG: palette, gray, RGB or RGBA. Four-bit run lengths, linked profiles and odd masks are refused."""
    _need(len(data) >= 26 and data[:2] == b"BM")
    offset, size = int.from_bytes(data[10:14], "little"), int.from_bytes(data[14:18], "little")
    masks, method, used, density = (0, 0, 0, 0), PLAIN, 0, (0, 0)
    if size == CORE:
        width, height, _, depth = struct.unpack_from("<HHHH", data, 18)
    else:
        _need(size >= INFO and len(data) >= 14 + size)
        width, height, _, depth, method, _, across, down, used = struct.unpack_from("<iiHHIIiiI", data, 18)
        density = (across, down)
        if method in (FIELDS, ALPHA_FIELDS):
            _need(len(data) >= 54 + 16)
            masks = struct.unpack_from("<IIII", data, 54)
            masks = masks if size >= 56 or method == ALPHA_FIELDS else (*masks[:3], 0)
    flipped, height = height < 0, abs(height)
    _need(method != RLE4, "unsupported_variant")
    _need(width > 0 and height > 0)
    _need(width * height <= MOST_PIXELS, "too_large")
    _need((depth, method) in {(1, PLAIN), (4, PLAIN), (8, PLAIN), (8, RLE8), (16, PLAIN), (24, PLAIN), (32, PLAIN), (16, FIELDS), (32, FIELDS), (32, ALPHA_FIELDS)}, "unsupported_variant")
    palette = None
    if depth <= 8:
        each, n = (3 if size == CORE else 4), used or 1 << depth
        start = 14 + size + (12 if size == INFO and method == FIELDS else 0)
        _need(n <= 1 << depth and start + each * n <= len(data))
        palette = np.frombuffer(data, np.uint8, each * n, start).reshape(n, each)[:, 2::-1]
    if method == RLE8:
        rows = _run_lengths(data[offset:], width, height)
    else:
        line = (width * depth + 31) // 32 * 4
        _need(offset + line * height <= len(data))
        rows = np.frombuffer(data, np.uint8, line * height, offset).reshape(height, line)
        if depth < 8:
            bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth)
            rows = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)
        elif depth == 8:
            rows = rows[:, :width]
        elif depth == 24 or depth == 32 and method == PLAIN:
            rows = rows[:, : width * depth // 8].reshape(height, width, depth // 8)[:, :, 2::-1]
        else:
            if method == PLAIN:
                masks = (0x7C00, 0x3E0, 0x1F, 0)
            whole = rows[:, : width * depth // 8].copy().view("<u2" if depth == 16 else "<u4").astype(np.int64)
            _need(all(masks[:3]), "unsupported_variant")
            rows = np.stack([_channel(whole, m) for m in masks[: 4 if masks[3] else 3]], axis=2)
    rows = rows if flipped else rows[::-1]
    chunk = lambda code, body: len(body).to_bytes(4, "big") + code + body + zlib.crc32(code + body).to_bytes(4, "big")
    color = 3 if palette is not None else 6 if rows.shape[2] == 4 else 2
    extra = b""
    if size >= V5 and len(data) >= 14 + V5:
        kind, at, n = (int.from_bytes(data[14 + k : 18 + k], "little") for k in (56, 112, 116))
        _need(kind != LINKED, "unsupported_variant")
        if kind == EMBEDDED:
            _need(n > 0 and 14 + at + n <= len(data))
            extra += chunk(b"iCCP", b"x\0\0" + zlib.compress(data[14 + at : 14 + at + n]))
    if min(density) > 0:
        extra += chunk(b"pHYs", struct.pack(">IIB", *density, 1))
    if palette is not None:
        _need(int(rows.max()) < len(palette))
        extra += chunk(b"PLTE", palette.tobytes())
    lines = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(rows).reshape(height, -1)], axis=1)
    header = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + header + extra + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")
