"""Language identification as a mixture: every document is a blend of languages whose shares are estimated by expectation-maximisation.

Each language has likelihoods of hashed byte n-grams within words, counted over all its labelled training texts. A
word's likelihood in a language is the product of its n-grams'. For each document, expectation-maximisation estimates
the share of each language; sets of languages, nested by share, compete by penalised likelihood, and the shares of the
winning set are the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.quality import remainder
from tessera.llm.textblocks import blocks, flat, gather, hashes, lowered, spans

BITS, ORDERS = 15, (3, 4)
SMOOTHING, TEMPER = 0.5, 0.5
ROUNDS_ALL, ROUNDS_SET = 8, 5
#: Weight of the penalty log(words) for each language beyond the first.
PENALTY = 1.5

#: Bytes of words: a-z and everything outside ASCII (texts are lower-cased first).
LETTER = np.zeros(256, bool)
LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Models:
    """Languages in order, and log-likelihoods of n-gram buckets: one row per bucket and a column per language."""

    languages: list[str]
    logs: np.ndarray


def _apart(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts lower-cased with a space behind each, so that no n-gram reaches into the next row's text."""
    n, size = np.arange(len(starts)), ends - starts
    out = np.full(len(raw) + len(starts), 0x20, np.uint8)
    out[np.arange(len(raw)) + np.repeat(n, size)] = lowered(raw)
    return out, starts + n, ends + n


def _grams(raw: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that starts one byte before each position (other bytes count as a space)."""
    clean = np.concatenate([[0x20], np.where(LETTER[raw], raw, 0x20), np.full(max(ORDERS), 0x20)]).astype(np.uint32)
    out = []
    for n in ORDERS:
        code = clean[: len(raw) + 1].copy()
        for k in range(1, n):
            code |= clean[k : len(raw) + 1 + k] << np.uint32(8 * k)
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
        code ^= code >> np.uint32(13)
        out.append(((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64))
    return out


def _runs(begin: np.ndarray, stop: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First index and number of a word's n-grams of order ``n``, a space before and behind it included."""
    return begin, np.maximum(0, stop - begin + 3 - n)


def fit(docs: DataFrame, held_out: int = 2, folds: int = 4) -> Models:
    """Models from text and non-null ``lang`` of rows whose crc32(doc_id) modulo ``folds`` is not ``held_out``.

    Counts cover all such rows; a task sends one number per language and bucket it has met. Null ids and texts teach nothing.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), folds) != held_out))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in blocks(batches):
            raw, starts, ends = _apart(*flat(batch.column("text")))
            begin, stop, row = spans(raw, starts, ends, LETTER)
            coded = batch.column("lang").dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            names = coded.dictionary.to_pylist()
            own = np.zeros(len(names) << BITS, np.int64)
            for n, gram in zip(ORDERS, _grams(raw), strict=True):
                first, size = _runs(begin, stop, n)
                own += np.bincount((np.repeat(code[row], size) << BITS) + gram[gather(first, size)], minlength=len(own))
            for k, name in enumerate(names):
                part = own[k << BITS : (k + 1) << BITS]
                total[name] = total[name] + part if name in total else part.copy()
        for name, part in total.items():
            used = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(part[used], pa.int64())], ["lang", "bucket", "n"])

    counts = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(count, "lang string, bucket long, n long")
    got = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got["lang"].unique().tolist())
    table = np.zeros((1 << BITS, len(languages)))
    place = {name: k for k, name in enumerate(languages)}
    table[got["bucket"].to_numpy(), got["lang"].map(place).to_numpy(dtype=np.int64, na_value=0)] = got["n"].to_numpy()
    table += SMOOTHING
    return Models(languages, np.log(table / table.sum(0)).astype(np.float32))


def _mixture(shares: np.ndarray, row: np.ndarray, like: np.ndarray, count: np.ndarray, words: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after ``rounds`` of expectation-maximisation for all documents at once, and the log-likelihood of each."""
    n, k = shares.shape
    for _ in range(rounds):
        joint = shares[row] * like
        joint *= (count / np.maximum(joint.sum(1), 1e-30))[:, None]
        shares = np.stack([np.bincount(row, weights=joint[:, j], minlength=n) for j in range(k)], axis=1) / words[:, None]
    fit_ = np.log(np.maximum((shares[row] * like).sum(1), 1e-30)) * count
    return shares, np.bincount(row, weights=fit_, minlength=n)


def proportions(models: Models, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Shares of the languages in each text of a block; all zero where there is no word."""
    n, k = len(starts), len(models.languages)
    out = np.zeros((n, k))
    raw, starts, ends = _apart(raw, starts, ends)
    begin, stop, row = spans(raw, starts, ends, LETTER)
    if not len(begin) or not k:
        return out
    coded = pa.array(hashes(raw, begin, stop).view(np.int64)).dictionary_encode()
    index, distinct = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    at = np.zeros(distinct, np.int64)
    at[index] = np.arange(len(index))
    log = np.zeros((distinct, k), np.float64)
    for order, gram in zip(ORDERS, _grams(raw), strict=True):
        first, size = _runs(begin[at], stop[at], order)
        total = np.concatenate([np.zeros((1, k)), np.cumsum(models.logs[gram[gather(first, size)]], axis=0, dtype=np.float64)])
        upto = np.cumsum(size)
        log += total[upto] - total[upto - size]
    log *= TEMPER
    log -= log.max(1, keepdims=True)
    pair, count = np.unique(row * distinct + index, return_counts=True)
    row, like = pair // distinct, np.exp(log[pair % distinct])
    words = np.bincount(row, weights=count, minlength=n)
    some = np.maximum(words, 1)
    shares, _ = _mixture(np.full((n, k), 1 / k), row, like, count, some, ROUNDS_ALL)
    rank = np.argsort(np.argsort(-shares, axis=1, kind="stable"), axis=1)
    best = np.full(n, np.inf)
    for size in range(1, k + 1):
        start = np.where(rank < size, np.maximum(shares, 1e-6), 0)
        start /= start.sum(1, keepdims=True)
        own, log_like = _mixture(start, row, like, count, some, ROUNDS_SET if size > 1 else 0)
        cost = PENALTY * (size - 1) * np.log(some + 1) - log_like
        better = cost < best
        best[better], out[better] = cost[better], own[better]
    out[words == 0] = 0
    return out


def predict(docs: DataFrame, models: Models, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id, lang_pred, score`` and ``shares``, a map from language to its share above zero.

    ``lang_pred`` is the language with the largest share, ``score`` that share. A text that is null or has no letter
    is ``und`` with score 0, and so is every text where nothing was learned. Texts of any length are read whole.
    Other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)  # 2**BITS numbers per language

    def look(batches):
        own = shared.value
        for batch in blocks(batches):
            raw, starts, ends = flat(batch.column("text"))
            share = proportions(own, raw, starts, ends)
            total = np.concatenate([[0], np.cumsum(LETTER[lowered(raw)] & (raw < 0x80), dtype=np.int64)])
            letters = total[ends] > total[starts]
            for r in np.flatnonzero(~letters & (ends > starts)).tolist():
                letters[r] = any(c.isalpha() for c in raw[starts[r] : ends[r]].tobytes().decode("utf-8", "replace"))
            known = letters & (share.sum(1) > 0) if share.shape[1] else np.zeros(len(starts), bool)
            top = share.argmax(1) if share.shape[1] else np.zeros(len(starts), np.int64)
            names = [own.languages[k] if ok else "und" for k, ok in zip(top.tolist(), known.tolist(), strict=True)]
            value = np.where(known, np.clip(share.max(1, initial=0), 0, 1), 0.0)
            kept = [[(own.languages[k], float(p)) for k, p in enumerate(row) if p > 1e-4] if ok else [] for row, ok in zip(share.tolist(), known.tolist(), strict=True)]
            columns = [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(value, pa.float64()), pa.array(kept, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "shares"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(look, "doc_id long, lang_pred string, score double, shares map<string,double>")
