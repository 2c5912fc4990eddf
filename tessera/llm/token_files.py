"""Token-id files: whole texts as ids in range-coded, checksummed blocks, written and read through Spark's own file sources.

A file holds records, each followed by a line feed (the text writer's separator). A record is

    magic "TSR1" | u32 length of what follows up to the line feed | u32 crc32 of the body | body
    body: u32 file number | u32 block number | u32 pieces | u32 length of index | index (zlib) | block of ``rangecoder``
    index: per piece u8 (bit 0: its document ends here, bit 1: doc_id is null), then i64 doc_ids, then u32 lengths

A document longer than a block continues in the next one of its file. Files follow each other in ascending doc_id order.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.cluster import input_parts, shared_dir, small_batches
from tessera.llm.rangecoder import compress, decompress
from tessera.llm.textblocks import blocks, flat
from tessera.llm.tokens import BLOCK_BYTES, Encoder, with_end

MAGIC = b"TSR1"
#: Ids in a block; the coder's model is reset after it.
BLOCK_IDS = 1 << 20
_HEAD = struct.Struct("<4sII")
_BODY = struct.Struct("<IIII")


def _record(file_no: int, block_no: int, doc_ids: list, lengths: np.ndarray, ended: np.ndarray, ids: np.ndarray) -> bytes:
    null = np.array([d is None for d in doc_ids], bool)
    index = zlib.compress((ended + 2 * null).astype("u1").tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + lengths.astype("<u4").tobytes(), 1)
    body = _BODY.pack(file_no, block_no, len(doc_ids), len(index)) + index + compress(ids)
    return _HEAD.pack(MAGIC, len(body), zlib.crc32(body)) + body


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode every whole text of ``docs`` (null: empty) followed by ``end_id`` and write the files under ``path``.

    Rows go in ascending ``doc_id`` order, nulls first; rows of one id, which may lie in several tasks, by a hash of their
    text. An empty table writes no record.
    """

    def encode(batches):
        from pyspark import TaskContext

        encoder, file_no, block_no = Encoder.shared(tokenizer), TaskContext.get().partitionId(), 0
        held, held_ids, held_counts = [], np.zeros(0, np.uint32), np.zeros(0, np.int64)

        def cut(all_of_it: bool):
            """Records of the ids gathered so far; the rest waits for more unless ``all_of_it``."""
            nonlocal held, held_ids, held_counts, block_no
            while len(held_ids) >= BLOCK_IDS or all_of_it and len(held):
                upto = np.cumsum(held_counts)
                full = int(np.searchsorted(upto, BLOCK_IDS, "right"))
                part = 0 if full == len(held) else BLOCK_IDS - (int(upto[full - 1]) if full else 0)
                lengths = held_counts[:full]
                if part:
                    lengths = np.append(lengths, part)
                ended = np.arange(len(lengths)) < full
                take = int(lengths.sum())
                record = _record(file_no, block_no, held[: len(lengths)], lengths, ended, held_ids[:take])
                yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], ["record"])
                block_no += 1
                held, held_ids, held_counts = held[full:], held_ids[take:], held_counts[full:].copy()
                if part:
                    held_counts[0] -= part

        for batch in blocks(batches, limit=BLOCK_BYTES):
            ids, counts = with_end(*encoder.encode(*flat(batch.column("text"))), end_id)
            held = held + batch.column("doc_id").to_pylist()
            held_ids, held_counts = np.concatenate([held_ids, ids]), np.concatenate([held_counts, counts])
            yield from cut(False)
        yield from cut(True)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tied = rows.withColumn("tie", F.xxhash64("text"))
    spread = tied.repartitionByRange(input_parts(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    spread.mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value")).write.text(path)


def records(content: bytes):
    """(file number, pieces, flags, doc_ids, lengths, block) of each record of one file; ValueError where a checksum differs."""
    at = 0
    while at < len(content):
        magic, size, crc = _HEAD.unpack_from(content, at)
        body = content[at + _HEAD.size : at + _HEAD.size + size]
        if magic != MAGIC or len(body) != size or zlib.crc32(body) != crc:
            raise ValueError("a record of token ids is damaged")
        file_no, _, pieces, index_size = _BODY.unpack_from(body)
        index = zlib.decompress(body[_BODY.size : _BODY.size + index_size])
        flags = np.frombuffer(index, "u1", pieces)
        doc_ids = np.frombuffer(index, "<i8", pieces, pieces)
        yield file_no, flags, doc_ids, np.frombuffer(index, "<u4", pieces, 9 * pieces).astype(np.int64), body[_BODY.size + index_size :]
        at += _HEAD.size + size + 1


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files under ``path``: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids array<long>``.

    ``start`` counts the ids of all documents before it. Damaged records raise an error.
    """

    def totals(batches):
        for batch in batches:
            for content in batch.column(0):
                n: dict[int, int] = {}
                for file_no, _, _, lengths, _ in records(content.as_py()):
                    n[file_no] = n.get(file_no, 0) + int(lengths.sum())
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["file_no", "n"])

    def decode(batches):
        for batch in batches:
            for content in batch.column(0):
                at, open_ids, start = 0, [], 0
                for file_no, flags, doc_ids, lengths, block in records(content.as_py()):
                    ids = decompress(block)
                    out = {k: [] for k in ("doc_id", "file_no", "start", "n", "crc", "ids")}
                    upto = np.cumsum(lengths)
                    for flag, doc, a, b in zip(flags.tolist(), doc_ids.tolist(), (upto - lengths).tolist(), upto.tolist(), strict=True):
                        open_ids.append(ids[a:b])
                        at += b - a
                        if flag & 1:
                            whole = open_ids[0] if len(open_ids) == 1 else np.concatenate(open_ids)
                            row = (None if flag & 2 else doc, file_no, start, len(whole), zlib.crc32(whole.astype("<u4").tobytes()), whole.tolist() if with_ids else None)
                            for k, v in zip(out, row, strict=True):
                                out[k].append(v)
                            open_ids, start = [], at
                    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    sums = files.mapInArrow(totals, "file_no long, n long")
    before = F.coalesce(F.sum("n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("file_no", before.alias("before"))  # one row per file
    rows = files.mapInArrow(decode, "doc_id long, file_no long, start long, n long, crc long, ids array<long>")
    found = rows.join(offsets, "file_no").select("doc_id", (F.col("before") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"), "ids")
    return found if with_ids else found.drop("ids")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back."""
    small_batches(docs.sparkSession)
    path = shared_dir(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
