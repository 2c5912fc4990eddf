"""Periodic runs of words by Karp-Miller-Rosenberg naming.

The words of a block of documents are numbered exactly, each document for itself. Level k names stretches of 2^k words:
two stretches have equal names if both halves have. Stretches that occur once in their document have no name, so higher
levels name only what repeats. How far two places agree is read off the names by descending levels, forwards and
backwards.

A run of period p and at least four periods agrees with itself p words on over at least three periods. Of the places
0, p, 2p, ... of its document one at least agrees over 2p + 1 words, so equal names of the largest level below that
length tell the candidates of each period; each is extended to its full run. Nothing rests on hashes.
"""

from __future__ import annotations

from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textblocks import blocks

#: Least length of a run in periods and in words.
PERIODS, WORDS = 4, 6


def named(words: np.ndarray) -> list[np.ndarray]:
    """Names of all stretches of 2^k words that repeat, level by level; -1 elsewhere and behind the last word."""
    n = len(words)
    often = np.bincount(words, minlength=1)[words] > 1 if n else np.zeros(0, bool)
    level = np.full(n + 1, -1, np.int32)
    level[:n][often] = words[often]
    levels = [level]
    while (level >= 0).any():
        half = 1 << (len(levels) - 1)
        at = np.flatnonzero(level >= 0)
        at = at[at + half < n]
        at = at[level[at + half] >= 0]
        pair = level[at].astype(np.int64) * (int(level.max()) + 1) + level[at + half]
        _, name, times = np.unique(pair, return_inverse=True, return_counts=True)
        repeats = times[name] > 1
        level = np.full(n + 1, -1, np.int32)
        level[at[repeats]] = name[repeats]
        levels.append(level)
    return levels[:-1]


def ahead(levels: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Number of words from ``one`` on that agree with those from ``two`` on."""
    found = np.zeros(len(one), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        last = len(levels[k]) - 1
        a, b = levels[k][np.minimum(one + found, last)], levels[k][np.minimum(two + found, last)]
        found += ((a == b) & (a >= 0)).astype(np.int64) << k
    return found


def behind(levels: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Number of words before ``one`` that agree with those before ``two``; ``one`` is the smaller place."""
    found = np.zeros(len(one), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        at = one - found - (1 << k)
        a, b = levels[k][np.maximum(at, 0)], levels[k][np.maximum(two - found - (1 << k), 0)]
        found += ((at >= 0) & (a == b) & (a >= 0)).astype(np.int64) << k
    return found


def candidates(levels: list[np.ndarray], low: int, high: int, top: int) -> tuple[list[np.ndarray], list[int]]:
    """Places of the grids of all periods in [low, high) from which the words agree a period on, the first of neighbours."""
    found, periods = [], []
    for p in range(1, min((high - low) // PERIODS, (1 << top) - 1) + 1):
        level = levels[(2 * p + 1).bit_length() - 1]
        a, b = level[low : high - p : p], level[low + p : high : p]
        hit = np.flatnonzero((a == b[: len(a)]) & (a >= 0))
        if len(hit):
            found.append(low + p * hit[np.diff(hit, prepend=-2) > 1])
            periods += [p] * len(found[-1])
    return found, periods


def runs_of(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of all runs of numbered words, by start and period.

    Documents end at ``ends``; no number may occur in two of them.
    """
    levels = named(words)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    filled = ends > starts
    top = np.zeros(len(ends), np.int64)
    for k, level in enumerate(levels):
        top[filled] = np.where(np.maximum.reduceat(level[:-1], starts[filled]) >= 0, k, top[filled])
    places, periods = [], []
    for d in np.flatnonzero((top > 0) & (ends - starts >= WORDS)).tolist():
        own, by = candidates(levels, int(starts[d]), int(ends[d]), int(top[d]))
        places += own
        periods += by
    at, p = np.concatenate([np.zeros(0, np.int64), *places]), np.array(periods, np.int64)
    start, end = at - behind(levels, at, at + p), at + p + ahead(levels, at, at + p)
    long = end - start >= np.maximum(WORDS, PERIODS * p)
    start, end, p = start[long], end[long], p[long]
    order = np.lexsort((p, end, start))  # a multiple of a run's smallest period gives the same run
    start, end, p = start[order], end[order], p[order]
    first = np.ones(len(p), bool)
    first[1:] = (np.diff(start) != 0) | (np.diff(end) != 0)
    start, end, p = start[first], end[first], p[first]
    order = np.lexsort((p, start))
    return start[order], end[order], p[order]


def _looked_at(batch: pa.RecordBatch) -> pa.RecordBatch:
    """RUNS' columns of one block of documents."""
    split = [(t or b"").split() for t in batch.column("text").cast(pa.binary()).to_pylist()]  # at ASCII white space
    number, parts = count(), []
    for words in split:
        parts.append(np.fromiter(map({}.setdefault, words, number), np.int64, len(words)))
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(sizes)
    words = np.concatenate([np.zeros(0, np.int64), *parts])
    start, end, period = runs_of(words, ends)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, end, -1)
    kept = np.cumsum(edge)[:-1] == 0
    own = np.searchsorted(ends, start, "right")
    bounds = np.searchsorted(own, np.arange(len(split) + 1))
    runs, tops, texts = [], [], []
    for d, all_words in enumerate(split):
        low, high = int(ends[d] - sizes[d]), int(ends[d])
        found = [(int(start[k]) - low, int(end[k] - start[k]), int(period[k])) for k in range(bounds[d], bounds[d + 1])]
        top = None
        for run in found:
            if top is None or run[1] * top[2] > top[1] * run[2]:
                top = run
        runs.append([dict(zip(_RUN, r, strict=True)) for r in found])
        tops.append(dict(zip(_RUN, top, strict=True)) if top else None)
        texts.append(b" ".join(compress(all_words, kept[low:high].tolist()) if found else all_words))
    run = pa.struct([(n, pa.int64()) for n in _RUN])
    columns = [batch.column("doc_id"), pa.array(sizes), pa.array(runs, pa.list_(run)), pa.array(tops, run), pa.array(texts, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "top", "collapsed"])


_RUN = ("start", "length", "period")
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, top struct<start: long, length: long, period: long>, collapsed string"


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """RUNS' columns for each row of ``docs``: all runs by start and period, the one of most periods, the text without repeats.

    Words are separated by ASCII white space and numbered from 0. A run has at least PERIODS times its smallest period
    and WORDS words, and no neighbouring word extends it. ``top`` has the greatest length over period, of equal ones the
    smallest start, then period; null without runs. ``collapsed`` joins the words that lie in no run behind its first
    period by one space. Null, empty and blank texts have no words. Rows are independent: ids may be null or repeat, and
    an empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: map(_looked_at, blocks(batches)), RUNS)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where a tenth of the documents, by crc32 of the decimal id, repeat a stretch of their words to the end.

    With h the unsigned checksum, g = h div 10 and n words, words from a = g mod n on repeat with the period
    1 + (n - a) div (3 + g mod 8). Documents with a null id or without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " "))

    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    changed = F.get(F.transform(F.array(words), repeated), F.lit(0))  # an array of one, so that words are split once
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(changed, F.col("text"))).otherwise(F.col("text")).alias("text"))
