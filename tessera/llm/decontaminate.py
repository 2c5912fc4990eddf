"""Benchmark decontamination with suffix arrays over the training texts.

Each task sorts the suffixes of a bounded block of training documents (a shard) by their first words and searches all
test suffixes in it by bisection: the range of training suffixes that share the window's words gives every occurrence,
and extending each gives the longest verbatim match and its place. A document lies in one shard, so nothing shuffles.
Suffixes whose first two words are no pair of the test set can't match a window of two or more and aren't sorted.

The test set is cut into groups of bounded size; each group is one broadcast and one pass over the blocks in a chain
without shuffle, so a test set of any size is searched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.cluster import numbered, place_of, renamed
from tessera.llm.textblocks import blocks, flat, hashes, lowered, same_bytes, spans

WINDOW = 10
#: Words of test items in one group; an item is never split.
GROUP_WORDS = 200_000

#: Bytes of words: digits, a-z and everything outside ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Words:
    """Distinct words, numbered from 1 in order of their hashes and told apart by their bytes."""

    def __init__(self, words: set[bytes]):
        listed = sorted(words)
        size = np.fromiter(map(len, listed), np.int64, len(listed))
        body = np.frombuffer(b"".join(listed), np.uint8)
        end = np.cumsum(size)
        key = hashes(body, end - size, end)
        order = np.argsort(key, kind="stable")
        self.body, self.keys, self.at, self.end = body, key[order], (end - size)[order], end[order]
        #: How many words share a hash at most.
        self.twins = int(np.unique(key, return_counts=True)[1].max()) if len(key) else 0

    def __len__(self) -> int:
        return len(self.keys)

    def numbers(self, raw: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The number of each span's word, 0 for words that aren't here."""
        out, key = np.zeros(len(begin), np.int64), hashes(raw, begin, stop)
        if not len(self.keys):
            return out
        place = np.searchsorted(self.keys, key)
        for _ in range(self.twins):
            spot = np.minimum(place, len(self.keys) - 1)
            look = np.flatnonzero((out == 0) & (self.keys[spot] == key))
            own = spot[look]
            same = same_bytes(raw, begin[look], stop[look], self.body, self.at[own], self.end[own])
            out[look[same]] = own[same] + 1
            place += 1
        return out


class TestSet:
    """Windows of a group of test items, as rows of word numbers."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        raw, starts, ends = flat(pa.array([text for _, text in items], pa.string()))
        raw = lowered(raw)
        begin, stop, row = spans(raw, starts, ends, WORD)
        body = raw.tobytes()
        self.words = Words({body[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)})
        self.seq = self.words.numbers(raw, begin, stop)
        self.first = np.searchsorted(row, np.arange(len(items) + 1))
        size = np.diff(self.first)
        pairs = self.seq[:-1] * np.int64(len(self.words) + 1) + self.seq[1:]
        self.pairs = np.unique(pairs)
        #: (length, sorted window keys, for each key its test positions as a slice, positions, their items)
        self.by_length = []
        full = np.flatnonzero(size >= window)
        position = np.concatenate([np.arange(self.first[i], self.first[i + 1] - window + 1) for i in full]) if len(full) else np.zeros(0, np.int64)
        groups = [(window, position, np.repeat(full, size[full] - window + 1))]
        groups += [(n, self.first[at := np.flatnonzero(size == n)], at) for n in range(1, window) if (size == n).any()]
        for n, position, item in groups:
            if len(position):
                key = packed(self.seq, position, n)
                order = np.argsort(key, kind="stable")
                unique, start = np.unique(key[order], return_index=True)
                self.by_length.append((n, unique, np.append(start, len(order)), position[order], item[order]))


def packed(seq: np.ndarray, position: np.ndarray, n: int, last: int | None = None) -> np.ndarray:
    """The ``n`` words from each position as byte strings that sort like the words; beyond ``seq``: zero."""
    padded = np.append(seq, np.zeros(n, seq.dtype))
    window = np.empty((len(position), n + (last is not None)), ">u4")
    for k in range(n):
        window[:, k] = padded[position + k]
    if last is not None:
        window[:, n] = last
    return window.reshape(-1).view(f"S{4 * window.shape[1]}")


def search(tests: TestSet, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Occurrences of test windows in the texts of a block.

    Returns (words of the block's rows: counts, row of each word) and a list of (length of window, training positions,
    rows of ``tests``' sorted windows).
    """
    raw = lowered(raw)
    begin, stop, row = spans(raw, starts, ends, WORD)
    number = tests.words.numbers(raw, begin, stop)
    # Words of two rows must not form a window: a zero, which no test word has, ends each row.
    seq = np.insert(number, ends_at := np.searchsorted(row, np.arange(1, len(starts) + 1)), 0) if len(starts) else number
    place = np.arange(len(number)) + row  # of each word in seq
    found = []
    if len(number):
        base = np.int64(len(tests.words) + 1)
        pair = seq[:-1] * base + seq[1:]
        where = np.minimum(np.searchsorted(tests.pairs, pair), max(0, len(tests.pairs) - 1))
        alive = np.flatnonzero((tests.pairs[where] == pair) & (seq[:-1] > 0)) if len(tests.pairs) else np.zeros(0, np.int64)
        depth = max((n for n, *_ in tests.by_length), default=0)
        if depth > 1:
            suffix = packed(seq, alive, depth)
            order = np.argsort(suffix, kind="stable")
            array, where = suffix[order], alive[order]
        for n, unique, *_ in tests.by_length:
            if n == 1:
                single = np.flatnonzero(seq > 0)
                one = packed(seq, single, 1)
                hit = np.minimum(np.searchsorted(unique, one), len(unique) - 1)
                ok = unique[hit] == one
                found.append((1, single[ok], hit[ok]))
                continue
            words = np.frombuffer(unique.astype(f"S{4 * n}").tobytes(), ">u4").reshape(-1, n).reshape(-1)
            rows = np.arange(len(unique)) * n
            low = np.searchsorted(array, packed(words, rows, n), "left")
            high = np.searchsorted(array, packed(words, rows, n, 0xFFFFFFFF), "right")
            size = high - low
            which = np.repeat(np.arange(len(unique)), size)
            inside = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            found.append((n, where[inside], which))
    counts = np.diff(np.append(0, ends_at)) if len(starts) else np.zeros(0, np.int64)
    return counts, row, place, seq, found


def _grouped(benchmark: DataFrame, item_id: str, text: str):
    """Groups of (item_id as string, text) with about GROUP_WORDS words each; the driver holds one item at a time beside them."""
    group, words = [], 0
    for name, body in benchmark.select(F.col(item_id).cast("string"), F.col(text).cast("string")).toLocalIterator():
        if not body:
            continue
        n = len(body) // 2 + 1  # words have a byte and a separator at least
        if group and words + n > 6 * GROUP_WORDS:
            yield group
            group, words = [], 0
        group.append((name, body))
        words += n
    yield group


#: Columns that ``hits`` adds, and the state that passes from group to group: covered ranges, items met, matches.
_MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("item_word", "word", "length"))]))
_ADDED = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
_STATE = [T.StructField("words", T.LongType()), *(T.StructField(n, T.ArrayType(T.LongType())) for n in ("lows", "highs")), T.StructField("met", T.ArrayType(T.StringType())), T.StructField("matches", _MATCH)]
_ARROW_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("length", pa.int64())]))


def _listed(row: np.ndarray, n: int, values) -> pa.Array:
    """Lists of ``values`` for rows 0 to n - 1; ``row`` says whose each value is, in order."""
    ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _joined(old, new: pa.Array) -> pa.Array:
    """Row by row both lists one after the other; ``old`` is None before the first group."""
    if old is None or not len(new.values):
        return new if old is None else old
    a, b = old.value_lengths().to_numpy(zero_copy_only=False), new.value_lengths().to_numpy(zero_copy_only=False)
    row = np.concatenate([np.repeat(np.arange(len(a)), a), np.repeat(np.arange(len(b)), b)])
    order = np.argsort(row, kind="stable")
    return _listed(row[order], len(a), pa.concat_arrays([old.flatten(), new.flatten()]).take(pa.array(order)))


def _looked(tests: TestSet, text: pa.Array, old: dict | None, with_matches: bool) -> list[pa.Array]:
    """The columns of _STATE after searching one group of items in the texts of a block."""
    rows = len(text)
    counts, _, _, seq, found = search(tests, *flat(text))
    begin = np.cumsum(counts + 1) - (counts + 1)  # of each row in seq
    mark = np.zeros(len(seq) + 1, np.int32)
    met, matches = [np.zeros(0, np.int64)], []
    for n, where, which in found:
        np.add.at(mark, where, 1)
        np.add.at(mark, np.minimum(where + n, len(seq)), -1)
        of = np.searchsorted(begin, where, "right") - 1
        _, start, _, item = next(x[1:] for x in tests.by_length if x[0] == n)
        once = np.unique(of * np.int64(len(start)) + which)
        row, key = once // len(start), once % len(start)
        size = start[key + 1] - start[key]
        met.append(np.unique(np.repeat(row, size) * np.int64(len(tests.names)) + item[np.repeat(start[key] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]))
        if with_matches:
            matches += _maximal(tests, n, where, which, of, begin, seq)
    covered = np.cumsum(mark[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    low, high = edge[::2], edge[1::2]
    of = np.searchsorted(begin, low, "right") - 1
    pair = np.unique(np.concatenate(met))
    pair = pair[[tests.names[i] is not None for i in (pair % len(tests.names)).tolist()]] if len(pair) else pair
    names = pa.array([tests.names[i] for i in (pair % max(1, len(tests.names))).tolist()], pa.string())
    matches.sort(key=lambda m: m[0])
    listed = pa.array([dict(zip(("item_id", "item_word", "word", "length"), m[1:], strict=True)) for m in matches], _ARROW_MATCH.value_type)
    new = [
        _listed(of, rows, pa.array(low - begin[of])), _listed(of, rows, pa.array(high - begin[of])),
        _listed(pair // max(1, len(tests.names)), rows, names), _listed(np.array([m[0] for m in matches], np.int64), rows, listed),
    ]
    return [pa.array(counts), *(_joined(old and old[k], x) for k, x in zip(("lows", "highs", "met", "matches"), new, strict=True))]


def _finished(state: dict[str, pa.Array], with_matches: bool) -> list[pa.Array]:
    """The columns of _ADDED, and ``matches`` if asked for, from those of _STATE."""
    out: list[list] = [[], [], [], []]
    for low, high, met in zip(*(state[k].to_pylist() for k in ("lows", "highs", "met")), strict=True):
        n_hit, upto = 0, 0
        for a, b in sorted(zip(low, high, strict=True)):
            n_hit, upto = n_hit + max(0, b - max(a, upto)), max(b, upto)
        names = sorted(set(met))
        for k, v in zip(out, (n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0), strict=True):
            k.append(v)
    columns = [state["words"], *(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True))]
    if with_matches:
        rank = lambda m: (m["item_id"] is not None, m["item_id"] or "", m["item_word"], m["word"], m["length"])
        columns.append(pa.array([sorted({rank(m): m for m in own}.values(), key=rank) for own in state["matches"].to_pylist()], _ARROW_MATCH))
    return columns


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", matches: bool = True) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, items_sha256, contaminated`` and, unless told otherwise, ``matches``.

    ``matches`` lists (item_id, item_word, word, length): the maximal verbatim runs shared with an item, in words.
    A null text has no words; items whose text is null or without words match nothing; an item with a null id is searched
    like any other, only ``n_items`` and ``items_sha256`` leave it out; repeated items count once per item id;
    columns of ``docs`` keep their values, but one that has the name of a new column gives way to it.
    """
    before, rows = docs.columns, numbered(docs)
    body = f"c{place_of(docs, text)}"
    rows = rows.withColumn(body, F.col(body).cast("string"))
    own_fields = list(rows.schema.fields)
    added = [*_ADDED, *([T.StructField("matches", _MATCH)] if matches else [])]
    groups, first = _grouped(benchmark, item_id, item_text), True
    group = next(groups)
    while group is not None:
        following = next(groups, None)
        broadcast = docs.sparkSession.sparkContext.broadcast(TestSet(group, window))  # GROUP_WORDS words at about
        out = T.StructType([*own_fields, *(_STATE if following is not None else added)])

        def look(batches, tests=broadcast, first=first, last=following is None, names=out.names):
            for batch in blocks(batches, body):
                old = None if first else {f.name: batch.column(f.name) for f in _STATE}
                found = _looked(tests.value, batch.column(body), old, matches)
                if last:
                    found = _finished(dict(zip((f.name for f in _STATE), found, strict=True)), matches)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(own_fields)], *found], names)

        rows, first, group = rows.mapInArrow(look, out), False, following
    return renamed(rows, before, [f.name for f in added])


def _maximal(tests: TestSet, n: int, where: np.ndarray, which: np.ndarray, of: np.ndarray, begin: np.ndarray, seq: np.ndarray) -> list[tuple]:
    """(row, item_id, item word, word, length) of each run that can't be extended, from occurrences of windows of ``n`` words."""
    if not len(where):
        return []
    unique, start, position, item = next((u, s, p, i) for k, u, s, p, i in tests.by_length if k == n)
    size = start[which + 1] - start[which]
    pick = np.repeat(start[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    place, test, items = np.repeat(where, size), position[pick], item[pick]
    of = np.repeat(of, size)
    order = np.lexsort((place, place - test, items))
    place, test, items, of = place[order], test[order], items[order], of[order]
    # Windows one word apart in both texts belong to one run.
    new = np.append(True, (items[1:] != items[:-1]) | (np.diff(place) != 1) | (np.diff(test) != 1))
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, len(place))) + n - 1
    return list(zip(of[head].tolist(), [tests.names[i] for i in items[head].tolist()], (test[head] - tests.first[items[head]]).tolist(), (place[head] - begin[of[head]]).tolist(), length.tolist(), strict=True))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a window of a test item; columns unchanged, whatever their names."""
    kept = hits(numbered(docs), benchmark, window, text=f"c{place_of(docs, text)}", matches=False).filter("NOT contaminated")
    return kept.drop(*(f.name for f in _ADDED)).toDF(*docs.columns)
