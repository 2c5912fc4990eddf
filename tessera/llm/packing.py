"""Lexical retrieval packing: windows filled with the BM25 neighbours of a seed document.

Texts become ids once and are stored. Document frequencies and the mean length are counted over all documents; they
are one number per id of the vocabulary. Documents are then routed: each gets a few ids by weighted min-hash, chosen the
likelier the more the id adds to its BM25 scores, and is sorted by them over the whole corpus, so that documents that
share their telling ids come to lie together. Each task cuts its stretch into shards of bounded size, builds an inverted
index per shard and fills windows: a seed, then its best unused neighbours, each id used exactly once. A neighbour that
doesn't fit is cut and its rest seeds the next window, so only a shard's last window can be short; its content is split
at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cluster import input_parts, small_batches, stored
from tessera.llm.textblocks import blocks, flat, mix, release
from tessera.llm.tokens import BLOCK_BYTES, Encoder, with_end

WINDOW = 4096
#: A shard closes when it holds so many documents or ids (one document may exceed the ids by itself).
SHARD_DOCS, SHARD_IDS = 1024, 1 << 21
#: Postings summed at once.
POSTINGS = 1 << 17
K1, B = 1.2, 0.75
_LEAST = np.iinfo(np.int64).min
#: Min-hashes that route a document, the bits that each keeps, and the power of BM25 weights that they are chosen by.
ROUTES, ROUTE_BITS, ROUTE_POWER = 3, 21, 3
#: Documents per task, and at most, whose routes decide where the tasks' stretches begin; every document is routed.
SAMPLE_PER_TASK, SAMPLE_ROWS = 200, 1 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit) of every text, null as empty, ``end_id`` last."""

    def encode(batches):
        encoder = Encoder.shared(tokenizer)
        for batch in blocks(batches, limit=BLOCK_BYTES):
            ids, counts = with_end(*encoder.encode(*flat(batch.column("text"))), end_id)
            ends = np.concatenate([[0], np.cumsum(counts)]) * 4
            column = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], ["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids binary")


def _frequencies(ids: DataFrame) -> tuple[np.ndarray, int, int]:
    """(documents that hold each id, number of documents, number of ids): as long as the vocabulary, not the corpus."""

    def count(batches):
        df, docs, total = np.zeros(1 << 16, np.int64), 0, 0
        for batch in blocks(batches, "ids", 1 << 20):
            raw, starts, ends = flat(batch.column("ids"))
            flat_ids = raw.view("<u4").astype(np.int64)
            size = (ends - starts) // 4
            if len(flat_ids) and flat_ids.max() >= len(df):
                df = np.concatenate([df, np.zeros(int(flat_ids.max()) + 1 - len(df), np.int64)])
            pair = np.sort(np.repeat(np.arange(len(size)), size) * len(df) + flat_ids)
            once = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
            df += np.bincount(once % len(df), minlength=len(df))
            docs, total = docs + len(size), total + len(flat_ids)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, [-1, -2])), pa.array(np.append(df[used], [docs, total]))], ["id", "n"])

    rows = dict(ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect())
    docs, total = rows.pop(-1, 0), rows.pop(-2, 0)
    df = np.zeros(max(rows, default=0) + 1, np.int64)
    df[list(rows)] = list(rows.values())
    return df, docs, total


def weighted(ids: np.ndarray, lengths: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, BM25 weight) of the distinct ids of each document, by document and id."""
    pair = np.repeat(np.arange(len(lengths)) * len(idf), lengths)
    pair += ids
    pair.sort()
    new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
    tf, pair = np.diff(np.append(new, len(pair))), pair[new]
    doc, term = (pair // len(idf)).astype(np.int32), (pair % len(idf)).astype(np.int32)
    return doc, term, idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean))


def routes(ids: np.ndarray, lengths: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """A number per document, made of ROUTES ids; documents with equal leading ids are neighbours in its order."""
    doc, term, weight = weighted(ids, lengths, idf, mean)
    first, out = np.searchsorted(doc, np.arange(len(lengths))), np.zeros(len(lengths), np.int64)
    rate = np.maximum(weight, 1e-9) ** ROUTE_POWER
    for k in range(ROUTES):
        chance = ((mix(term.astype(np.uint64) * np.uint64(ROUTES) + np.uint64(k + 1)) >> np.uint64(11)) + 0.5) / (1 << 53)
        wait = -np.log(chance) / rate
        least = np.minimum.reduceat(wait, first) if len(wait) else wait
        at = np.flatnonzero(wait == least[doc])
        chosen = np.zeros(len(lengths), np.int64)
        chosen[doc[at][::-1]] = term[at][::-1]
        out = out << ROUTE_BITS | chosen & (1 << ROUTE_BITS) - 1
    return out


class Stretches:
    """Where the stretch of each task begins among documents in order of route and id, so that each holds about as many ids."""

    def __init__(self, route: np.ndarray, doc_id: np.ndarray, size: np.ndarray, parts: int):
        order = np.lexsort((doc_id, route))
        upto = np.cumsum(size[order])
        at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)) if len(upto) else np.zeros(0, np.int64)
        self.route, self.doc_id = route[order][at], doc_id[order][at]

    def task(self, route: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
        """The stretch of each document: how many bounds lie at or before it."""
        n = len(self.route)
        row = np.append(np.zeros(n, bool), np.ones(len(route), bool))
        order = np.lexsort((row, np.append(self.doc_id, doc_id), np.append(self.route, route)))
        out = np.empty(n + len(route), np.int32)
        out[order] = np.cumsum(~row[order])
        return out[n:]


class Shard:
    """An inverted index over the documents of one shard."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, idf: np.ndarray, mean: float):
        self.n, size = len(lengths), len(idf)
        self.doc, self.term, weight = weighted(ids, lengths, idf, mean)
        self.first = np.searchsorted(self.doc, np.arange(self.n + 1))
        self.weight = weight
        order = np.argsort(self.term, kind="stable")
        self.posted, self.posted_weight = self.doc[order], weight[order]
        start = np.searchsorted(self.term, np.arange(size + 1), sorter=order).astype(np.int32)
        self.low, self.high = start[self.term], start[self.term + 1]

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents by descending BM25 score against all ids of the seed, ties by position."""
        own = np.arange(self.first[seed], self.first[seed + 1])
        own = own[self.weight[own] > 0]  # an id in over half of the documents adds nothing to any score
        score = np.zeros(self.n)
        ends = np.cumsum(self.high[own].astype(np.int64) - self.low[own])
        at = 0
        while at < len(own):  # about POSTINGS at once
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POSTINGS, "right")))
            part = own[at:stop]
            size = (self.high[part] - self.low[part]).astype(np.int64)
            where = np.repeat(self.low[part] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            score += np.bincount(self.posted[where], weights=self.posted_weight[where], minlength=self.n)
            at = stop
        left = np.flatnonzero(unused)
        return left[np.argsort(-score[left], kind="stable")]


def fill(lengths: np.ndarray, shard: Shard, window: int):
    """Sequences as lists of (document, start, length); every id of every document is in exactly one."""
    unused = np.ones(shard.n, bool)
    cursor, rest = 0, None
    while True:
        if rest is None:
            while cursor < shard.n and not unused[cursor]:
                cursor += 1
            if cursor == shard.n:
                return
            unused[cursor] = False
            rest = (cursor, 0)
        seed, start = rest
        rest, row, room = None, [], window
        take = min(room, int(lengths[seed]) - start)
        row.append((seed, start, take))
        room -= take
        if start + take < lengths[seed]:
            rest = (seed, start + take)
        elif room:
            for doc in shard.neighbours(seed, unused).tolist():
                take = min(room, int(lengths[doc]))
                unused[doc] = False
                row.append((doc, 0, take))
                room -= take
                if take < lengths[doc]:
                    rest = (doc, take)
                if not room:
                    break
        yield row


def without_padding(row: list, window: int):
    """A sequence as it is if full; else split into sequences whose lengths are powers of two, the largest first."""
    total = sum(n for _, _, n in row)
    if total == window:
        yield row
        return
    at = 0
    for bit in range(total.bit_length() - 1, -1, -1):
        if not total >> bit & 1:
            continue
        room, part = 1 << bit, []
        while room:
            doc, start, n = row[at]
            take = min(room, n)
            part.append((doc, start, take))
            room -= take
            if take == n:
                at += 1
            else:
                row[at] = (doc, start + take, n - take)
        yield part


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text holds only ``end_id`` and is packed like any other; rows that repeat a doc_id are documents of
    their own; a null doc_id stays null. Long documents fill windows alone before their rest seeds another. An empty
    table gives no piece. Only ``doc_id`` and ``text`` are read. Documents that share a frequent route are dealt by id.
    """
    small_batches(docs.sparkSession)
    ids = stored(tokenised(docs, tokenizer, end_id), "packing-ids")
    df, n_docs, total = _frequencies(ids)
    idf = np.maximum(0.0, np.log((n_docs - df + 0.5) / (df + 0.5)))
    mean = max(1.0, total / max(1, n_docs))

    def routed(batches):
        """(batch of ids, its doc_ids with nulls first, its routes, its lengths) of each block."""
        for batch in blocks(batches, "ids", 1 << 20):
            raw, starts, ends = flat(batch.column("ids"))
            lengths = (ends - starts) // 4
            yield batch, batch.column("doc_id").fill_null(_LEAST).to_numpy(), routes(raw.view("<u4"), lengths, idf, mean), lengths

    def sample(batches):
        for _, doc_id, route, lengths in routed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(doc_id), pa.array(lengths)], ["route", "own", "size"])

    parts = input_parts(ids)
    share = min(1.0, min(SAMPLE_ROWS, SAMPLE_PER_TASK * parts) / max(1, n_docs))
    drawn = ids.sample(share, 1).mapInArrow(sample, "route long, own long, size long").toArrow()  # at most SAMPLE_ROWS rows or so
    bounds = docs.sparkSession.sparkContext.broadcast(Stretches(*(drawn.column(c).to_numpy() for c in ("route", "own", "size")), parts))

    def deal(batches):
        for batch, doc_id, route, _ in routed(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(route), pa.array(bounds.value.task(route, doc_id))], ["doc_id", "ids", "route", "task"])

    def run(batches):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 32
        doc_ids, parts, sizes = [], [], []

        def close():
            nonlocal doc_ids, parts, sizes, sequence
            lengths, flat_ids = np.concatenate(sizes), np.concatenate(parts)
            shard, begin = Shard(flat_ids, lengths, idf, mean), np.cumsum(lengths) - lengths
            names = pa.concat_arrays(doc_ids)
            out = []
            for full in fill(lengths, shard, window):
                for row in without_padding(full, window):
                    offset = 0
                    for doc, start, n in row:
                        a = begin[doc] + start
                        out.append((doc, start, n, zlib.crc32(flat_ids[a : a + n].tobytes()), int(lengths[doc]), sequence, offset))
                        offset += n
                    sequence += 1
            columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
            doc_ids, parts, sizes = [], [], []
            del shard, out
            release()
            return pa.RecordBatch.from_arrays([names.take(columns[0]), *columns[1:]], [x.split()[0] for x in PIECES.split(", ")])

        held = 0
        for batch in blocks(batches, "ids", 1 << 20):
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, SHARD_DOCS - held)
                raw, starts, ends = flat(part.column("ids"))
                doc_ids.append(part.column("doc_id"))
                parts.append(raw.view("<u4"))
                sizes.append((ends - starts) // 4)
                held, at = held + part.num_rows, at + part.num_rows
                if held >= SHARD_DOCS or sum(map(len, parts)) >= SHARD_IDS:
                    yield close()
                    held = 0
        if held:
            yield close()

    dealt = ids.mapInArrow(deal, "doc_id long, ids binary, route long, task int")
    return dealt.repartitionById(parts, "task").sortWithinPartitions("route", "doc_id").drop("route", "task").mapInArrow(run, PIECES)
