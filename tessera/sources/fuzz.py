"""Damaged media files in any number, each the same for its number and seed on every machine."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import fixtures
from tessera.sources.parts import kind_of


def mutated(content: bytes, draw: random.Random) -> bytes:
    """One to four edits: bits flipped, bytes set, ranges cut, doubled, moved or filled."""
    data = bytearray(content)
    for _ in range(draw.randint(1, 4)):
        if not data:
            break
        a = draw.randrange(len(data))
        b = min(len(data), a + draw.randint(1, 16))
        edit = draw.randrange(6)
        if edit == 0:
            data[a] ^= 1 << draw.randrange(8)
        elif edit == 1:
            data[a] = draw.choice((0, 1, 0x7F, 0x80, 0xFF))
        elif edit == 2:
            del data[a:b]
        elif edit == 3:
            data[a:a] = data[a:b]
        elif edit == 4:
            piece = data[a:b]
            del data[a:b]
            at = draw.randint(0, len(data))
            data[at:at] = piece
        else:
            data[a:b] = bytes([draw.choice((0, 0xFF))]) * (b - a)
    return bytes(data)


def files(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """``file_id, kind, content`` of ``n`` mutated fixtures."""
    cases = [content for _, content, *_ in fixtures.cases()]

    def make(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            made = [mutated(cases[i % len(cases)], random.Random(f"{seed}:{i}")) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["file_id", "content"])

    table = spark.range(n).withColumnRenamed("id", "file_id").mapInArrow(make, "file_id long, content binary")
    return table.select("file_id", kind_of(F.col("content")).alias("kind"), "content")
