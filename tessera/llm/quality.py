"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

The machine's pairwise term is computed in linear time by the sum-of-squares identity
``sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2``. It is fitted on the driver to the
features of a bounded sample of labelled rows (``SAMPLE_ROWS``); scoring reads every whole text in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.cluster import numbered, place_of, renamed
from tessera.llm.textblocks import SPACE, blocks, flat, hashes, lowered, release, spans

#: Labelled rows that the machine is fitted to: those with the smallest hashed ids.
SAMPLE_ROWS = 8000
BITS, RANK = 15, 8
EPOCHS, BATCH, RATE, DECAY = 14, 128, 0.08, 2e-5
ACCEPT = 0.3

_NOT_SPACE = ~SPACE
_NOT_BREAK = np.ones(256, bool)
_NOT_BREAK[0x0A] = False
#: Classes of bytes whose shares describe a text's structure.
CLASSES = [np.isin(np.arange(256), list(chars)) for chars in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~<>{}[]|\\", b".,;:", b"!?", b"\"'()-_/+=", b"\n", range(128, 256))]
DENSE = ["bytes", "words", "lines", *(f"share_{n}" for n in range(len(CLASSES))), "space", "word_bytes", "distinct_words", "distinct_lines", "top_word", "line_bytes", "long_words", "upper_words", "stop_dense"]


@dataclass
class Machine:
    """Weights over 2**BITS hashed words followed by the standardised dense features."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dense, row, word bucket, value) of the texts of a block; buckets are sorted within ascending rows."""
    n, size = len(starts), np.maximum(1, ends - starts)
    share = []
    for table in CLASSES:
        total = np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])
        share.append((total[ends] - total[starts]) / size)
    begin, stop, row = spans(raw, starts, ends, _NOT_SPACE)
    words = np.bincount(row, minlength=n)
    some = np.maximum(1, words)
    length = stop - begin
    key = hashes(lowered(raw), begin, stop)
    order = np.argsort(row * np.int64(1 << 40) + (key >> np.uint64(24)).astype(np.int64), kind="stable")
    pair_row, pair_key = row[order], key[order]
    new = np.flatnonzero(np.append(True, (pair_row[1:] != pair_row[:-1]) | (pair_key[1:] != pair_key[:-1]))) if len(row) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(row)))
    r, k = pair_row[new], pair_key[new]
    top = np.zeros(n)
    np.maximum.at(top, r, count)
    lb, le, lrow = spans(raw, starts, ends, _NOT_BREAK)
    lines = np.bincount(lrow, minlength=n)
    lkey = np.unique(lrow * np.int64(1 << 40) + (hashes(raw, lb, le) >> np.uint64(24)).astype(np.int64))
    upper = np.concatenate([[0], np.cumsum(CLASSES[0][raw], dtype=np.int64)])
    loud = (upper[stop] - upper[begin]) * 2 > length
    spaces = np.concatenate([[0], np.cumsum(SPACE[raw], dtype=np.int64)])
    dense = np.stack([
        np.log1p(ends - starts), np.log1p(words), np.log1p(lines), *share, (spaces[ends] - spaces[starts]) / size,
        np.bincount(row, weights=np.minimum(length, 60), minlength=n) / some, np.bincount(r, minlength=n) / some,
        np.bincount(lkey >> 40, minlength=n) / np.maximum(1, lines), top / some,
        np.log1p((ends - starts) / np.maximum(1, lines)), np.bincount(row, weights=length > 24, minlength=n) / some,
        np.bincount(row, weights=loud & (length > 1), minlength=n) / some, np.bincount(row, weights=length <= 3, minlength=n) / some,
    ], axis=1)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(r, weights=value**2, minlength=n))
    return dense, r, (k >> np.uint64(64 - BITS)).astype(np.int64), value / np.maximum(norm[r], 1e-9)


def _split(dense: np.ndarray, machine: Machine) -> np.ndarray:
    """Standardised dense features, bounded so that no outlier rules a product."""
    return np.clip((dense - machine.mean) / machine.scale, -4, 4) / np.sqrt(len(DENSE))


def margins(machine: Machine, dense: np.ndarray, row: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The machine's output for each row, linear in the number of features."""
    n, x = len(dense), _split(dense, machine)
    hashed = 1 << BITS
    total, square = x @ machine.factors[hashed:], (x**2) @ (machine.factors[hashed:] ** 2)
    out = machine.bias + x @ machine.linear[hashed:] + np.bincount(row, weights=value * machine.linear[bucket], minlength=n)
    for f in range(machine.factors.shape[1]):
        v = value * machine.factors[bucket, f]
        total[:, f] += np.bincount(row, weights=v, minlength=n)
        square[:, f] += np.bincount(row, weights=v**2, minlength=n)
    return out + 0.5 * (total**2 - square).sum(1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(samples: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]) -> Machine:
    """A machine from (dense, buckets, values, label) by logistic loss and adaptive steps; no samples: score 0.5 for all."""
    hashed, width = 1 << BITS, (1 << BITS) + len(DENSE)
    draw = np.random.default_rng(3)
    machine = Machine(0.0, np.zeros(width), draw.normal(0, 0.03, (width, RANK)), np.zeros(len(DENSE)), np.ones(len(DENSE)))
    if not samples:
        machine.factors[:] = 0
        return machine
    dense = np.stack([s[0] for s in samples])
    machine.mean, machine.scale = dense.mean(0), dense.std(0) + 1e-3
    x, y = _split(dense, machine), np.array([s[3] for s in samples], float)
    machine.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    g_bias, g_linear, g_factors = 1e-6, np.full(width, 1e-6), np.full((width, RANK), 1e-6)
    for _ in range(EPOCHS):
        order = draw.permutation(len(samples))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            size = [len(samples[i][1]) for i in own]
            row = np.repeat(np.arange(len(own)), size)
            bucket = np.concatenate([samples[i][1] for i in own]).astype(np.int64)
            value = np.concatenate([samples[i][2] for i in own]).astype(float)
            error = (sigmoid(margins(machine, dense[own], row, bucket, value)) - y[own]) / len(own)
            used, place = np.unique(bucket, return_inverse=True)
            vectors = machine.factors[bucket]
            total = x[own] @ machine.factors[hashed:]
            for f in range(RANK):
                total[:, f] += np.bincount(row, weights=value * vectors[:, f], minlength=len(own))
            touched = np.append(used, np.arange(hashed, width))
            d_linear = np.append(np.bincount(place, weights=error[row] * value, minlength=len(used)), error @ x[own])
            step = (error[row] * value)[:, None] * (total[row] - vectors * value[:, None])
            d_words = np.stack([np.bincount(place, weights=step[:, f], minlength=len(used)) for f in range(RANK)], axis=1)
            d_dense = (x[own] * error[:, None]).T @ total - (error @ x[own] ** 2)[:, None] * machine.factors[hashed:]
            d_factors = np.concatenate([d_words, d_dense])
            d_linear += DECAY * machine.linear[touched]
            d_factors += DECAY * machine.factors[touched]
            g_bias += error.sum() ** 2
            g_linear[touched] += d_linear**2
            g_factors[touched] += d_factors**2
            machine.bias -= RATE * error.sum() / np.sqrt(g_bias)
            machine.linear[touched] -= RATE * d_linear / np.sqrt(g_linear[touched])
            machine.factors[touched] -= RATE * 0.5 * d_factors / np.sqrt(g_factors[touched])
    return machine


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", held_out: int = 0, folds: int = 5) -> Machine:
    """A machine for ``labels.<target>`` from rows whose crc32(doc_id) modulo ``folds`` is not ``held_out``.

    Null ids and labels outside {0, 1} teach nothing; of repeated labels the larger counts; at most SAMPLE_ROWS
    labelled ids, those with the smallest hash, are used; of documents that repeat such an id one counts, chosen by content.
    """
    known = labels.filter(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != held_out))
    known = known.groupBy("doc_id").agg(F.max(target).alias("label"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(SAMPLE_ROWS).select(F.col("doc_id").alias("chosen"), "label")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).select("doc_id", "text", "label")

    def extract(batches):
        for batch in blocks(batches):
            dense, row, bucket, value = features(*flat(batch.column("text")))
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            columns = [batch.column("doc_id"), pa.array([d.tobytes() for d in dense], pa.binary()), cut(bucket.astype("<u4")), cut(value.astype("<f4")), batch.column("label")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "dense", "bucket", "value", "label"])

    found = rows.mapInArrow(extract, "doc_id long, dense binary, bucket binary, value binary, label int")
    one = found.groupBy("doc_id").agg(F.min(F.struct("bucket", "dense", "value", "label")).alias("row"))
    got = one.select("doc_id", "row.*").toArrow().sort_by("doc_id")  # a row per chosen id
    dense, bucket, value, label = (got.column(c).to_pylist() for c in ("dense", "bucket", "value", "label"))
    machine = train([(np.frombuffer(d, float), np.frombuffer(k, "<u4"), np.frombuffer(v, "<f4"), y) for d, k, v, y in zip(dense, bucket, value, label, strict=True)])
    del got, dense, bucket, value, label
    release()  # the driver keeps the machine only
    return machine


def score(docs: DataFrame, machine: Machine, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every row, whole text; a null text scores like an empty one.

    Other columns pass through unchanged, but one that has the name ``column`` gives way to it; an empty table gives an
    empty result.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(machine)  # 2**BITS * (RANK + 1) numbers, whatever the input

    before, rows, body = docs.columns, numbered(docs), f"c{place_of(docs, text)}"
    rows = rows.withColumn(body, F.col(body).cast("string"))

    def look(batches):
        for batch in blocks(batches, body):
            own = sigmoid(margins(shared.value, *features(*flat(batch.column(body)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.float64())], [*batch.schema.names, "score"])

    scored = rows.mapInArrow(look, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    return renamed(scored.withColumnRenamed("score", column), before, [column])


def accepted(docs: DataFrame, machine: Machine, least: float = ACCEPT) -> DataFrame:
    """``docs`` without the rows that score below ``least``; columns unchanged, whatever their names."""
    kept = score(numbered(docs), machine, f"c{place_of(docs, 'text')}").filter(F.col("score") >= least)
    return kept.drop("score").toDF(*docs.columns)
