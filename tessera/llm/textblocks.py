"""Arrow text columns as flat byte arrays, and vectorised word spans and hashes over them.

Every function here works on one bounded block of rows (``blocks``), so a task's memory follows the block and
not the partition; a text longer than a block makes a block of its own and is still read whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text in one block; a single longer text is a block by itself.
BLOCK_BYTES = 1 << 20

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Spans beyond so many bytes are hashed one by one.
LONG = 256
#: Lower bytes of a little-endian word of eight.
_LOWER = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Odd multipliers, and starts, of the independent hashes.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_START = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, in order; a row is never split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, starts, ends = flat(batch.column(text))
        total = np.cumsum(ends - starts)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop
        release()


#: What frees the caches that a worker keeps between tasks.
CACHES: list[Callable[[], None]] = []


def forget() -> None:
    """Drop what this worker has kept for tasks of other kinds: a task that needs the memory itself begins so."""
    for drop in CACHES:
        drop()
    release()


def release() -> None:
    """Give memory that the allocators hold for later back to the system: a worker lives through many stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (large or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, large = column.cast(pa.string()), False
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n, (_, offs, data) = len(column), column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    low, high = offsets[0], offsets[-1]
    raw = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
    return raw, offsets[:-1] - low, offsets[1:] - low


def spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes marked in ``inside`` (a table of 256), never across two texts: starts, ends, row of each."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    is_in = inside[raw]
    first = is_in.copy()
    first[1:] &= ~is_in[:-1]
    last = is_in.copy()
    last[:-1] &= ~is_in[1:]
    filled = ends > starts
    edges = starts[filled]
    first[edges] |= is_in[edges]
    edges = ends[filled] - 1
    last[edges] |= is_in[edges]
    begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, stop, np.searchsorted(starts, begin, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, little-endian; zeros beyond the end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))


def hashes(raw: np.ndarray, begin: np.ndarray, stop: np.ndarray, lanes: int = 1):
    """A 64-bit hash of each span of bytes; with two ``lanes`` two independent ones as a list.

    Eight bytes at a time are mixed into a state that depends on all before, so no repetitive texts cancel out.
    Results must still not rest on one lane alone: ``same_bytes`` confirms, or both lanes are asked for.
    """
    size = stop - begin
    out = [mix(_START[k] + size.astype(np.uint64) * _ODD[k]) for k in range(lanes)]
    if len(begin):
        words = _eights(raw)
        usual = size <= LONG
        own = None if usual.all() else np.flatnonzero(usual)
        at, left = (begin, size) if own is None else (begin[own], size[own])
        while len(at):
            piece = words[at] & _LOWER[np.minimum(left, 8)]
            for k in range(lanes):
                if own is None:
                    out[k] = mix(out[k] ^ (piece * _ODD[k]))
                else:
                    out[k][own] = mix(out[k][own] ^ (piece * _ODD[k]))
            more = np.flatnonzero(left > 8)
            own, at, left = (more if own is None else own[more]), at[more] + 8, left[more] - 8
        for n in np.flatnonzero(~usual).tolist():
            import xxhash

            digest = xxhash.xxh3_128_intdigest(raw[begin[n] : stop[n]].tobytes())
            for k in range(lanes):
                out[k][n] = digest >> (64 * k) & 0xFFFFFFFFFFFFFFFF
    return out[0] if lanes == 1 else out


def same_bytes(raw: np.ndarray, begin: np.ndarray, stop: np.ndarray, other: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each span of ``raw`` holds the same bytes as the span [at, end) of ``other`` in its place."""
    size = stop - begin
    same = size == end - at
    one, two = _eights(raw), _eights(other)
    usual = same & (size <= LONG)
    own = np.flatnonzero(usual)
    a, b, left = begin[own], at[own], size[own]
    while len(own):
        differ = ((one[a] ^ two[b]) & _LOWER[np.minimum(left, 8)]) != 0
        same[own[differ]] = False
        more = np.flatnonzero((left > 8) & ~differ)
        own, a, b, left = own[more], a[more] + 8, b[more] + 8, left[more] - 8
    for n in np.flatnonzero(same & ~usual).tolist():
        same[n] = raw[begin[n] : stop[n]].tobytes() == other[at[n] : end[n]].tobytes()
    return same


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, everything else unchanged."""
    return np.where((raw >= 0x41) & (raw <= 0x5A), raw | 0x20, raw).astype(np.uint8)


def gather(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices begin[0], begin[0]+1, ... for each run, one run after the other."""
    length = np.asarray(length, np.int64)
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(np.asarray(begin, np.int64) - (ends - length), length)
