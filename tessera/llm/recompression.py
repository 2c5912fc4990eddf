"""Substring dedup by recompression.

Each text is a sequence of word names. Rounds rename it: first runs of one name, then, again and again, pairs whose
left name is of one class and whose right name is of the other (a name's class is a bit of it). A name is a hash of
what it stands for, so equal substrings get equal names everywhere in the corpus without a shuffle, except near their
ends. For every symbol the words that decide it, its own and its neighbours', are known; a window of words that holds
them all holds the symbol in every text it occurs in.

Texts are dealt into shards by ranges of their id. Per shard the distinct high-level symbols go to buckets by hash,
and each bucket answers which of them another document has too. Only windows whose symbols are all shared can repeat;
their digests go to buckets in turn, and each bucket answers which of them a shard of smaller ids has. Both
answers are one bit per symbol or window. A window without a decided symbol counts as shared, so nothing is lost.

Symbols only filter and are named by 64 bits. Windows decide: words have two independent 64-bit names, and a window's
digest mixes each chain of names by itself, 128 bits that no arrangement of words or letters is known to equate.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cluster import input_parts
from tessera.llm.textblocks import SPACE, flat, gather, hashes, mix, release, spans

WINDOW = 13
#: Pair rounds after the round of runs; symbols stand for two and a half words on average then. More rounds make rarer
#: symbols but leave windows of 13 words without one that they decide.
ROUNDS = 3
#: Bytes of input, as stored, that make a shard.
SHARD_BYTES = 4 << 20
_NOT_SPACE = ~SPACE
_LAST = np.iinfo(np.int64).max
#: More words than a shard can hold.
_BEYOND = 1 << 30
_SYMBOL_BYTES = 5


class Symbols:
    """A parse: names, first word and end of each symbol, and the words [low, high) that decide it."""

    def __init__(self, names: np.ndarray, row: np.ndarray):
        n = len(names)
        self.names, self.row = names, row
        self.begin, self.stop = np.arange(n, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
        self.low, self.high = self.begin.copy(), self.stop.copy()

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether a symbol has a left and right neighbour in its text, and the words that decide them (-1, beyond: none)."""
        n = len(self.names)
        left, right = np.zeros(n, bool), np.zeros(n, bool)
        same = self.row[1:] == self.row[:-1]
        left[1:], right[:-1] = same, same
        low, high = np.full(n, -1, np.int32), np.full(n, _BEYOND, np.int32)
        low[1:] = np.where(same, self.low[:-1], -1)
        high[:-1] = np.where(same, self.high[1:], _BEYOND)
        return left, right, low, high

    def _keep(self, head: np.ndarray, last: np.ndarray, names: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.names, self.row = names, self.row[head]
        self.begin, self.stop, self.low, self.high = self.begin[head], self.stop[last], low, high

    def runs(self) -> None:
        """Runs of one name become a symbol; the words beside a run decide where it ends."""
        if not len(self.names):
            return
        new = np.append(True, (self.names[1:] != self.names[:-1]) | (self.row[1:] != self.row[:-1]))
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(new)) - 1
        _, _, low, high = self._neighbours()
        size = (last - head + 1).astype(np.uint64)
        names = np.where(size > 1, mix(self.names[head] * np.uint64(0x9E3779B97F4A7C15) + size), self.names[head])
        self._keep(head, last, names, low[head], high[last])

    def pairs(self, turn: int) -> None:
        """Every left-class name followed by a right-class name becomes one symbol."""
        if not len(self.names):
            return
        is_left = (mix(self.names + np.uint64(turn)) >> np.uint64(63)).astype(bool)
        _, right, low, high = self._neighbours()
        joins = np.zeros(len(self.names), bool)
        joins[:-1] = is_left[:-1] & ~is_left[1:] & right[:-1]
        taken = np.append(False, joins[:-1])
        head = np.flatnonzero(~taken)
        last = head + joins[head]
        one, two = self.names[head], self.names[last]
        names = np.where(joins[head], mix(one * np.uint64(0xD6E8FEB86659FD93) + mix(two + np.uint64(turn))), one)
        # A pair is decided by its halves; a single name by the neighbour that it could have joined.
        alone_low = np.where(is_left[head], self.low[head], np.minimum(self.low[head], low[head]))
        alone_high = np.where(is_left[head], np.maximum(self.high[head], high[head]), self.high[head])
        low_ = np.where(joins[head], self.low[head], alone_low)
        high_ = np.where(joins[head], self.high[last], alone_high)
        self._keep(head, last, names, low_, high_)


def parse(names: np.ndarray, row: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    symbols = Symbols(names, row)
    symbols.runs()
    for turn in range(1, rounds + 1):
        symbols.pairs(turn)
    return symbols


class Shard:
    """The texts of one shard with their words, symbols and windows."""

    def __init__(self, table: pa.Table, window: int):
        ids = table.column("doc_id").combine_chunks().fill_null(_LAST).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.table = table.take(pa.array(order)).combine_chunks()
        self.ids, self.window = ids[order], window
        self.raw, self.starts, self.ends = flat(self.table.column("text"))
        self.begin, self.stop, self.row = (x.astype(np.int32) for x in spans(self.raw, self.starts, self.ends, _NOT_SPACE))
        self.names = hashes(self.raw, self.begin, self.stop)
        #: First words of windows.
        n = len(self.names)
        self.at = np.flatnonzero(self.row[: n - window + 1] == self.row[window - 1 :]) if n >= window else np.zeros(0, np.int64)

    def symbols(self) -> tuple[Symbols, np.ndarray, np.ndarray]:
        """The parse, its distinct names as 40-bit keys in order, and the place of each symbol's key."""
        parsed = parse(self.names, self.row)
        keys, place = np.unique(parsed.names >> np.uint64(64 - 8 * _SYMBOL_BYTES), return_inverse=True)
        return parsed, keys, place.astype(np.int32)

    def candidates(self, parsed: Symbols, place: np.ndarray, keys: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
        """Windows whose decided symbols all occur in another document; ``elsewhere`` says so of other shards."""
        low = np.full(len(keys), len(self.ids), np.int32)
        high = np.full(len(keys), -1, np.int32)
        np.minimum.at(low, place, parsed.row)
        np.maximum.at(high, place, parsed.row)
        alone = ~(elsewhere | (low < high))[place]
        # A window [i, i + w) holds a symbol's deciding words if high - w <= i <= low.
        first, last = np.maximum(parsed.high[alone] - self.window, 0), parsed.low[alone]
        ok = (parsed.high[alone] <= len(self.names)) & (last >= 0) & (first <= last)
        mark = np.zeros(len(self.names) + 2, np.int32)
        np.add.at(mark, first[ok], 1)
        np.add.at(mark, last[ok] + 1, -1)
        return self.at[np.cumsum(mark)[self.at] == 0]

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows among those at ``at`` in order (digests of two numbers) and the place of each window's."""
        out = []
        for lane, start in enumerate((0x452821E638D01377, 0xBE5466CF34E90C6C)):
            names = self.names if not lane else hashes(self.raw, self.begin, self.stop, 2)[1]
            code = np.full(len(at), start, np.uint64)
            for k in range(self.window):
                code = mix(code ^ names[at + k])
            out.append(code)
        one, two = out
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])) if len(order) else np.zeros(0, bool)
        place = np.empty(len(order), np.int32)
        place[order] = np.cumsum(new) - 1
        return one[new], two[new], place


def _packed_symbols(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SYMBOL_BYTES].tobytes()


def _unpacked_symbols(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // _SYMBOL_BYTES, 8), np.uint8)
    out[:, :_SYMBOL_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, _SYMBOL_BYTES)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _cuts(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys of so many bits; buckets are equal ranges of the keys."""
    edges = [min((1 << bits) - 1, (k * (1 << bits) + buckets - 1) // buckets) for k in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]]).astype(np.int64)


_BLOBS = "bucket int, shard int, kind int, blob binary"


def _blobs(shard: int, kind: int, cut: np.ndarray, pack) -> pa.Table:
    rows = [(b, pack(x, y)) for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if y > x]
    columns = [pa.array([b for b, _ in rows], pa.int32()), pa.array([shard] * len(rows), pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())]
    return pa.Table.from_arrays(columns, ["bucket", "shard", "kind", "blob"])


def _answers(answers: pa.Table, kind: int, cut: np.ndarray) -> np.ndarray:
    """The bits that the buckets sent for one shard, put in the order of its keys."""
    out = np.zeros(int(cut[-1]), bool)
    for bucket, own, blob in zip(*(answers.column(c).to_pylist() for c in ("bucket", "kind", "blob")), strict=True):
        if own == kind:
            n = int(cut[bucket + 1] - cut[bucket])
            out[cut[bucket] : cut[bucket + 1]] = np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)
    return out


def substring_dedup(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256, kept_text``.

    Words are runs of bytes that aren't ASCII white space. A word goes if a window of ``window`` consecutive words
    covers it whose words also occur, in order, in a document with a smaller id; windows are judged on the input. A
    null text has no words and keeps none; texts shorter than a window keep all. Rows that repeat an id aren't smaller
    than each other; a null id is larger than any other. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shards = input_parts(docs, SHARD_BYTES)
    buckets = max(4, shards // 2)
    bounds = rows.agg(F.percentile_approx("doc_id", F.array(*(F.lit(k / shards) for k in range(1, shards))), 20 * shards)).first()[0] if shards > 1 else []
    edges = sorted(set(bounds or []))
    number = F.lit(0)
    if edges:
        shared = docs.sparkSession.sparkContext.broadcast(np.array(edges, np.int64))  # one id per shard

        def place(batches):
            for batch in batches:
                ids = batch.column("doc_id").fill_null(_LAST).to_numpy()
                own = np.searchsorted(shared.value, ids, "left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], ["doc_id", "text", "shard"])

        dealt = rows.mapInArrow(place, "doc_id long, text string, shard int")
    else:
        dealt = rows.withColumn("shard", number)

    def send_symbols(table: pa.Table) -> pa.Table:
        shard = Shard(table, window)
        _, keys, _ = shard.symbols()
        return _blobs(table.column("shard")[0].as_py(), 0, _cuts(keys, 8 * _SYMBOL_BYTES, buckets), lambda a, b: _packed_symbols(keys[a:b]))

    def answer_symbols(table: pa.Table) -> pa.Table:
        """For each shard's symbols in this bucket: does another shard have it?"""
        parts = [_unpacked_symbols(b) for b in table.column("blob").to_pylist()]
        every = np.sort(np.concatenate(parts))
        common = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for part in parts:
            at = np.minimum(np.searchsorted(common, part), max(0, len(common) - 1))
            out.append(np.packbits(common[at] == part if len(common) else np.zeros(len(part), bool)).tobytes())
        return table.set_column(table.schema.get_field_index("blob"), "blob", pa.array(out, pa.binary()))

    def send_windows(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _blobs(0, 1, np.zeros(1, np.int64), None)
        shard = Shard(texts, window)
        parsed, keys, place_ = shard.symbols()
        at = shard.candidates(parsed, place_, keys, _answers(answers, 0, _cuts(keys, 8 * _SYMBOL_BYTES, buckets)))
        one, two, _ = shard.windows(at)
        pack = lambda a, b: one[a:b].astype("<u8").tobytes() + two[a:b].astype("<u8").tobytes()
        return _blobs(texts.column("shard")[0].as_py(), 1, _cuts(one, 64, buckets), pack)

    def answer_windows(table: pa.Table) -> pa.Table:
        """For each shard's windows in this bucket: does a shard of smaller ids have it?"""
        blobs = table.column("blob").to_pylist()
        size = np.array([len(b) // 16 for b in blobs])
        one = np.concatenate([np.frombuffer(b, "<u8", n) for b, n in zip(blobs, size.tolist(), strict=True)])
        two = np.concatenate([np.frombuffer(b, "<u8", n, 8 * n) for b, n in zip(blobs, size.tolist(), strict=True)])
        shard = np.repeat(table.column("shard").to_numpy(), size)
        order = np.lexsort((shard, two, one))
        again = np.append(False, (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1]))
        flag = np.empty(len(order), bool)
        flag[order] = again
        ends = np.cumsum(size)
        out = [np.packbits(flag[b - n : b]).tobytes() for b, n in zip(ends.tolist(), size.tolist(), strict=True)]
        return table.set_column(table.schema.get_field_index("blob"), "blob", pa.array(out, pa.binary()))

    def freed(f):
        """``f`` of one group; the memory of a shard goes back before the next one."""

        def run(*tables):
            out = f(*tables)
            release()
            return out

        # Spark counts the parameters: one table or two.
        return (lambda table: run(table)) if f.__code__.co_argcount == 1 else (lambda texts, answers: run(texts, answers))

    result = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"

    def remove(texts: pa.Table, answers: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in result.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        if not texts.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})
        shard = Shard(texts, window)
        parsed, keys, place_ = shard.symbols()
        at = shard.candidates(parsed, place_, keys, _answers(answers, 0, _cuts(keys, 8 * _SYMBOL_BYTES, buckets)))
        one, _, where = shard.windows(at)
        smaller = _answers(answers, 1, _cuts(one, 64, buckets))
        own = shard.ids[shard.row[at]]
        least = np.full(len(one), _LAST)
        np.minimum.at(least, where, own)
        gone = at[smaller[where] | (own > least[where])]
        mark = np.zeros(len(shard.names) + 1, np.int32)
        np.add.at(mark, gone, 1)
        np.add.at(mark, gone + window, -1)
        kept = np.cumsum(mark[:-1]) == 0
        n_rows = len(shard.ids)
        words, left = np.bincount(shard.row, minlength=n_rows), np.bincount(shard.row[kept], minlength=n_rows)
        raw, at_word, text_ = np.append(shard.raw, np.uint8(0x20)), np.concatenate([[0], np.cumsum(left)]), []
        begin, size = shard.begin[kept], (shard.stop - shard.begin)[kept] + 1
        for first in range(0, n_rows, 256):  # so many texts at once
            upto = at_word[first : first + 257]
            own = size[upto[0] : upto[-1]]
            body, ends = raw[gather(begin[upto[0] : upto[-1]], own)], np.concatenate([[0], np.cumsum(own)])
            body[ends[1:] - 1] = 0x20
            edge, body = ends[upto - upto[0]].tolist(), body.tobytes()
            text_ += [body[a : max(a, b - 1)] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        columns = [shard.table.column("doc_id"), pa.array(words), pa.array(words - left), pa.array([hashlib.sha256(t).hexdigest() for t in text_], pa.string()), pa.array([t.decode() for t in text_], pa.string())]
        return pa.Table.from_arrays(columns, names)

    by_shard = dealt.groupBy("shard")
    symbols = by_shard.applyInArrow(freed(send_symbols), _BLOBS).groupBy("bucket").applyInArrow(freed(answer_symbols), _BLOBS)
    windows = by_shard.cogroup(symbols.groupBy("shard")).applyInArrow(freed(send_windows), _BLOBS).groupBy("bucket").applyInArrow(freed(answer_windows), _BLOBS)
    return by_shard.cogroup(symbols.unionByName(windows).groupBy("shard")).applyInArrow(freed(remove), result)
