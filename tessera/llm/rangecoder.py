"""Context-mixing range coder for token ids, vectorised over lanes.

A block is cut into lanes of equal length that are coded in lockstep and share one adaptive model. An id's probability
is the sum of three distributions under weights: all on what the order-2 context predicts, all on what the order-1
context predicts, and the order-0 frequencies. The weights adapt by how sure both predictions are and whether they
agree. Each id is coded in one step of the summed distribution. The coder keeps 48 bits of low and range per lane and
moves 16-bit words; carries are settled when the block ends. Every block starts from an untrained model.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Steps of a lane; a block has as many lanes as it needs for that.
STEPS = 192
_SLOTS = 1 << 18
_TOP, _LOW = 48, 32
_STEP = 8
#: Steps between changes of the order-0 frequencies.
_REFRESH = 4
#: Parts of the whole that weights are given in, and bits of the whole at most where a vocabulary has up to 2**18 ids.
_UNITS, _WHOLE_BITS = 64, 25
#: Words that a step moves at most.
_MOST_WORDS = 2
_HEAD = struct.Struct("<III")


class _Model:
    """Predictions, frequencies and weights that coder and decoder change alike."""

    def __init__(self, size: int, lanes: int):
        self.size = size
        #: Sum of the order-0 frequencies at most: they are halved beyond.
        self.most = 1 << max(_WHOLE_BITS - _UNITS.bit_length() + 1, (2 * size).bit_length())
        #: Predictions of order 1 and 2: the id times four plus how sure it is, 0 (no prediction) to 3.
        self.table1, self.table2 = np.zeros(size + 1, np.int64), np.zeros(_SLOTS, np.int64)
        self.seen = np.tile(np.array([2, 2, 8], np.int64), (32, 1))
        self.freq = np.ones(size, np.int64)
        self.waiting: list[np.ndarray] = []
        self.last, self.before = np.full(lanes, size, np.int64), np.full(lanes, size, np.int64)
        self.total()

    def total(self) -> None:
        self.cum = np.zeros(self.size + 1, np.int64)
        np.cumsum(self.freq, out=self.cum[1:])
        self.whole = int(self.cum[-1]) * _UNITS

    def predict(self, k: int) -> None:
        """Predictions and weights for the first ``k`` lanes: ``u0`` of each order-0 count, ``w2`` and ``w1`` of the predictions."""
        self.k, one = k, self.last[:k]
        self.slot = ((self.before[:k] * 0x9E3779B1 + one * 0x85EBCA6B) >> 7) & (_SLOTS - 1)
        self.one, self.v1, self.v2 = one, self.table1[one], self.table2[self.slot]
        self.p1, self.p2, c1, c2 = self.v1 >> 2, self.v2 >> 2, self.v1 & 3, self.v2 & 3
        self.context = c2 * 8 + c1 * 2 + (self.p1 == self.p2)
        units = self.seen[:, :2] * (_UNITS - 3) // self.seen.sum(1, keepdims=True)
        rest = _UNITS - units.sum(1)
        units *= self.whole // _UNITS
        self.u0, self.w2, self.w1 = rest[self.context], units[self.context, 0], units[self.context, 1]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids begin in the summed distribution, and how much of it they have."""
        self.two, self.first = x == self.p2, x == self.p1
        start = self.u0 * self.cum[x] + self.w2 * (x > self.p2) + self.w1 * (x > self.p1)
        return start, self.u0 * self.freq[x] + self.w2 * self.two + self.w1 * self.first

    def at(self, value: np.ndarray) -> np.ndarray:
        """The ids in whose part of the summed distribution the values lie."""
        swap, same = self.p1 < self.p2, self.p1 == self.p2
        low, high = np.where(swap, self.p1, self.p2), np.where(swap, self.p2, self.p1)
        w_low, w_high = np.where(same, self.w1 + self.w2, np.where(swap, self.w1, self.w2)), np.where(same, 0, np.where(swap, self.w2, self.w1))
        start = self.u0 * self.cum[low]
        behind = value >= start + self.u0 * self.freq[low] + w_low
        is_low = (value >= start) & ~behind
        value = value - w_low * behind
        start = self.u0 * self.cum[high]
        beyond = value >= start + self.u0 * self.freq[high] + w_high
        is_high = behind & (value >= start) & ~beyond
        out = np.where(is_high, high, low)
        if len(lane := np.flatnonzero(~(is_low | is_high))):
            wanted = (value[lane] - (w_high * (behind & beyond))[lane]) // self.u0[lane]
            order = np.argsort(wanted)  # a search for rising values stays in cache
            found = np.empty(len(lane), np.int64)
            found[order] = np.searchsorted(self.cum, wanted[order], "right") - 1
            out[lane] = found
        return out

    def update(self, ids: np.ndarray) -> None:
        """Learn the ids that ``place`` was last asked for."""
        way = np.where(self.two, 0, 2 - self.first)
        self.seen += np.bincount(self.context * 3 + way, minlength=96).reshape(32, 3) * 2
        fresh = (ids << 2) + 1
        for table, at, v, hit in ((self.table2, self.slot, self.v2, self.two), (self.table1, self.one, self.v1, self.first)):
            c = v & 3
            table[at] = np.where(c == 0, fresh, v + np.where(hit, c < 3, -1))
        self.waiting.append(ids)
        if len(self.waiting) == _REFRESH:
            self.freq += _STEP * np.bincount(np.concatenate(self.waiting), minlength=self.size)
            self.total()
            while self.cum[-1] > self.most:
                self.freq = (self.freq + 1) >> 1
                self.total()
            self.waiting.clear()
        self.before[: self.k], self.last[: self.k] = self.last[: self.k], ids


def _shape(n: int) -> tuple[int, int]:
    lanes = -(-n // STEPS)
    return lanes, -(-n // lanes)


def compress(ids: np.ndarray) -> bytes:
    """One self-contained block."""
    ids = np.asarray(ids, np.int64)
    n = len(ids)
    size = int(ids.max()) + 1 if n else 0
    check = zlib.crc32(ids.astype("<u4").tobytes())
    if not n:
        return _HEAD.pack(n, size, check)
    lanes, steps = _shape(n)
    padded = np.zeros(lanes * steps, np.int64)
    padded[:n] = ids
    table = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model = _Model(size, lanes)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << _TOP, np.int64)
    words, used = np.zeros((lanes, _MOST_WORDS * steps + 3), np.int32), np.zeros(lanes, np.int64)

    for step in range(steps):
        k = -(-(n - step) // steps)  # lanes that reach this step
        x = table[step, :k]
        model.predict(k)
        start, width = model.place(x)
        r = span[:k] // model.whole
        value, room = low[:k] + r * start, r * width
        # The whole has at most 2**25 parts, or four for each id: two words at most restore the range.
        while len(full := np.flatnonzero(room < 1 << _LOW)):
            words[full, used[full]] = value[full] >> _LOW
            used[full] += 1
            value[full] = (value[full] & 0xFFFFFFFF) << 16
            room[full] <<= 16
        low[:k], span[:k] = value, room
        model.update(x)
    every = np.arange(lanes)
    for shift, mask in ((32, 0x1FFFF), (16, 0xFFFF), (0, 0xFFFF)):
        words[every, used] = (low >> shift) & mask
        used += 1
    while len(np.flatnonzero(over := words >> 16)):
        words &= 0xFFFF
        words[:, :-1] += over[:, 1:]
    body = used.astype("<u2").tobytes() + words[np.arange(words.shape[1]) < used[:, None]].astype("<u2").tobytes()
    return _HEAD.pack(n, size, zlib.crc32(body, check)) + body


def decompress(block: bytes) -> np.ndarray:
    """The ids of a block; ValueError if the checksum over them and the coded bytes differs."""
    n, size, crc = _HEAD.unpack_from(block)
    if not n:
        return np.zeros(0, np.uint32)
    lanes, steps = _shape(n)
    used = np.frombuffer(block, "<u2", lanes, _HEAD.size).astype(np.int64)
    body = np.frombuffer(block, "<u2", int(used.sum()), _HEAD.size + 2 * lanes).astype(np.int64)
    at = np.cumsum(used) - used
    body = np.append(body, [0, 0, 0])
    code = (body[at] << 32) | (body[at + 1] << 16) | body[at + 2]
    at += 3
    span = np.full(lanes, 1 << _TOP, np.int64)
    model = _Model(size, lanes)
    table = np.zeros((steps, lanes), np.int64)

    for step in range(steps):
        k = -(-(n - step) // steps)
        model.predict(k)
        r = span[:k] // model.whole
        x = model.at(np.minimum(code[:k] // r, model.whole - 1))
        start, width = model.place(x)
        value, room = code[:k] - r * start, r * width
        while len(full := np.flatnonzero(room < 1 << _LOW)):
            value[full] = (value[full] << 16) | body[at[full]]
            at[full] += 1
            room[full] <<= 16
        code[:k], span[:k] = value, room
        model.update(x)
        table[step, :k] = x
    ids = np.ascontiguousarray(table.T).reshape(-1)[:n].astype("<u4")
    if zlib.crc32(memoryview(block)[_HEAD.size :], zlib.crc32(ids.tobytes())) != crc:
        raise ValueError("a block of token ids fails its checksum")
    return ids
