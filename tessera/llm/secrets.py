"""Secret scans: fixed patterns, and strings that a character Markov model of random strings explains better than one of ordinary identifiers.

Both models are order-2 chains over the characters of keys. The ordinary one counts the characters of identifiers
joined from the words of all whole texts, in one aggregate; the random one learns from strings that a seeded generator
draws in the alphabets that keys use. ``train`` takes labelled samples instead.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textblocks import blocks

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # runs are maximal, so the length may be asked for in the pattern
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "markov")

#: Strings that the models judge: at least SHORTEST characters of this alphabet, with a digit or both cases.
SHORTEST, CANDIDATE = 16, re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Parts of such a string that are judged by themselves where the whole is ordinary.
PART = re.compile(r"[A-Za-z0-9+_-]{16,}")
CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Mean log-likelihood ratio per character above which a string counts as random.
THRESHOLD = 0.3
#: Strings of the random class; of the ordinary one where no text has a word.
SAMPLE_STRINGS = 4000
#: Words that make up identifiers, and how many of them the identifiers of a text hold in turn.
NAME_WORD, IN_NAME = re.compile("[a-z]{3,12}"), (2, 3, 4, 5)
#: Share of identifiers that end in a number below NUMBERS.
NUMBERED, NUMBERS = 0.3, 2031


@dataclass
class Models:
    """log P(random) - log P(ordinary) of a character after the two before it, as one table."""

    ratio: np.ndarray
    threshold: float = THRESHOLD

    def score(self, text: str) -> float:
        """Mean log-likelihood ratio per character."""
        code = np.array([CODE.get(c, 0) for c in text], np.int64)
        return float(self.ratio[np.append([0, 0], code[:-1])[: len(code)], np.append([0], code[:-1]), code].mean()) if len(code) else 0.0


CODE = {c: n + 1 for n, c in enumerate(CHARS)}


def triples(samples) -> np.ndarray:
    """How often each character follows each two, over the strings; before its first character a string has two zeros."""
    n = len(CHARS) + 1
    out = np.zeros((n, n, n))
    for text in samples:
        if text:
            c = np.array([CODE.get(x, 0) for x in text], np.int64)
            np.add.at(out, (np.append([0, 0], c[:-1])[: len(c)], np.append([0], c[:-1]), c), 1)
    return out


def models(random_counts: np.ndarray, ordinary_counts: np.ndarray, smoothing: float = 0.3, threshold: float = THRESHOLD) -> Models:
    """Models from the counts of both classes (as ``triples`` gives them)."""
    logs = []
    for triple in (random_counts, ordinary_counts):
        pair = smoothing + triple.sum(0)
        back = pair / pair.sum(1, keepdims=True)
        weight = 4.0  # of the order-1 chain in the order-2 one
        logs.append(np.log((triple + weight * back) / (triple.sum(2, keepdims=True) + weight)))
    return Models(logs[0] - logs[1], threshold)


def train(samples: list[tuple[str, int]], smoothing: float = 0.3, threshold: float = THRESHOLD) -> Models:
    """Models from (string, label) pairs, label 1 for random strings and 0 for ordinary identifiers."""
    return models(*(triples(text for text, own in samples if own == label) for label in (1, 0)), smoothing, threshold)


def random_strings(n: int, seed: int = 7) -> list[str]:
    """Strings as key generators make them: hex, base 32, base 62, base 64."""
    draw, out = random.Random(seed), []
    alphabets = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", CHARS[:62], CHARS[:62] + "+/", CHARS[:62] + "-_")
    for k in range(n):
        out.append("".join(draw.choices(alphabets[k % len(alphabets)], k=draw.randint(16, 64))))
    return out


def ordinary_strings(words: list[str], n: int, seed: int = 11) -> list[str]:
    """Identifiers and paths joined from words: snake, kebab, camel, upper case, with a number now and then."""
    draw, out = random.Random(seed), []
    for k in range(n if words else 0):
        part = draw.choices(words, k=draw.randint(2, 5))
        style = k % 6
        name = ("_".join(part), "-".join(part), part[0] + "".join(p.capitalize() for p in part[1:]), "_".join(part).upper(), "/".join(part), "".join(part))[style]
        out.append(name + (str(draw.randint(0, 2030)) if draw.random() < 0.3 else ""))
    return out


#: Codes of ASCII bytes, and the separators that stand between words of a name: "_" or, between names, two zeros.
_CODES = np.array([CODE.get(chr(b), 0) for b in range(128)], np.int64)
_UNDER = CODE["_"]
_BETWEEN = [s for n in IN_NAME for s in ["_"] * (n - 1) + ["\0\0"]]


def _counted(code: np.ndarray) -> np.ndarray:
    n = len(CHARS) + 1
    at = np.flatnonzero(code[2:])  # a zero is no character
    return np.bincount((code[at] * n + code[at + 1]) * n + code[at + 2], minlength=n**3)


def identifier_counts(texts) -> np.ndarray:
    """Rows of (snake, camel, plain, ends): counts of characters after two in identifiers of each text's distinct words.

    Words are taken in order of their first occurrence, in names of IN_NAME words in turn; ``ends`` counts the last two
    characters of the names of each style, as (style, two, one).
    """
    n, parts = len(CHARS) + 1, []
    for text in texts:
        words = list(dict.fromkeys(NAME_WORD.findall((text or "").lower())))
        if words:
            between = (_BETWEEN * (len(words) // len(_BETWEEN) + 1))[: len(words)]
            between[-1] = "\0\0"
            parts += [w for pair in zip(words, between, strict=True) for w in pair]
    snake = _CODES[np.frombuffer(("\0\0" + "".join(parts)).encode(), np.uint8)]
    under = snake == _UNDER
    camel = snake.copy()
    camel[1:][under[:-1]] += CODE["A"] - CODE["a"]
    out = [_counted(snake), _counted(camel[~under]), _counted(snake[~under])]
    ends = np.zeros((3, n, n), np.int64)
    for k, code in enumerate((snake, camel[~under], snake[~under])):
        at = np.flatnonzero((code[2:-1] > 0) & (code[3:] == 0)) + 2
        ends[k] = np.bincount(code[at - 1] * n + code[at], minlength=n * n).reshape(n, n)
    return np.concatenate([*out, ends.reshape(-1)])


def ordinary_counts(total: np.ndarray) -> np.ndarray:
    """Characters after two in identifiers of all six styles, from summed ``identifier_counts``."""
    n = len(CHARS) + 1
    snake, camel, plain = total[: 3 * n**3].reshape(3, n, n, n).astype(float)
    ends = total[3 * n**3 :].reshape(3, n, n).astype(float)
    upper = np.arange(n)
    for small in range(26):
        upper[[CODE["a"] + small, CODE["A"] + small]] = CODE["A"] + small, CODE["a"] + small
    instead = lambda c: np.array([{_UNDER: CODE[c], CODE[c]: _UNDER}.get(k, k) for k in range(n)])
    out, last = camel + plain, ends[1] + ends[2]
    for change in (np.arange(n), instead("-"), instead("/"), upper):
        out = out + snake[np.ix_(change, change, change)]
        last = last + ends[0][np.ix_(change, change)]
    digits = np.zeros((n, n, n))
    first, pair = np.zeros(n), np.zeros((n, n))
    for number in map(str, range(NUMBERS)):
        c = [CODE[d] for d in number]
        first[c[0]] += 1
        for k in range(1, len(c)):
            if k == 1:
                pair[c[0], c[1]] += 1
            else:
                digits[c[k - 2], c[k - 1], c[k]] += 1
    share = NUMBERED / NUMBERS
    out += share * (last[:, :, None] * first + last.sum(0)[:, None, None] * pair + last.sum() * digits)
    return out


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Models:
    """Models for these texts: random strings against identifiers from the words of all whole texts.

    Each task counts into one array of fixed size, and the counts are summed in one aggregate. They are scaled to the
    number of characters of the random class, so that smoothing weighs the same in both.
    """

    def count(batches):
        total = 0
        for batch in blocks(batches):
            total = total + identifier_counts(batch.column("text").to_pylist())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.atleast_1d(total)[used])], ["cell", "n"])

    n = len(CHARS) + 1
    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "cell long, n long")
    cells = rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 3 * (n^3 + n^2) rows
    total = np.zeros(3 * (n**3 + n**2), np.int64)
    total[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    chance = triples(random_strings(SAMPLE_STRINGS))
    ordinary = ordinary_counts(total) if total.any() else triples(ordinary_strings(["user", "name", "value", "index", "table", "path", "file", "page"], SAMPLE_STRINGS))
    return models(chance, ordinary * (chance.sum() / ordinary.sum()))


def _merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same characters, in order."""
    out: list[tuple[int, int]] = []
    for a, _, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _left(a: int, b: int, covered: list[tuple[int, int]], starts: list[int]) -> list[tuple[int, int]]:
    """What the covered spans leave of a span, where it is long enough to judge."""
    out, at = [], bisect.bisect_right(starts, a) - 1
    at = max(at, 0)
    while at < len(covered) and covered[at][0] < b:
        x, y = covered[at]
        if y > a:
            out.append((a, x))
            a = max(a, y)
        at += 1
    return [(x, y) for x, y in [*out, (a, b)] if y - x >= SHORTEST]


def _random(text: str, a: int, b: int, fitted: Models) -> list[tuple[int, int]]:
    """The span if it scores as random, else those of its parts between slashes and equals signs that do."""
    if _is_random(text[a:b], fitted):
        return [(a, b)]
    return [(m.start(), m.end()) for m in PART.finditer(text, a, b) if m.span() != (a, b) and _is_random(m.group(), fitted)]


def _is_random(own: str, fitted: Models) -> bool:
    mixed = any(c.isdigit() for c in own) or not (own.islower() or own.isupper())
    return mixed and fitted.score(own) > fitted.threshold


def spans(text: str, fitted: Models | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, by start, then kind as listed in KINDS. Code points, end exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if fitted is not None:
        covered = _merged(found)
        starts = [a for a, _ in covered]
        for m in CANDIDATE.finditer(text):
            for a, b in _left(*m.span(), covered, starts):
                found += [(x, 3, y) for x, y in _random(text, a, b, fitted)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def scan(docs: DataFrame, models: Models | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, found``.

    ``found`` is an array of (kind, start, end); ``spans`` the same as one string. A null text counts as empty and has
    no span. Texts of any length are scanned whole. Other columns are ignored; an empty table gives an empty result.
    """

    def look(batches):
        for batch in blocks(batches):
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "found")}
            for body in batch.column("text").to_pylist():
                own = spans(body or "", models)
                base = ",".join(f"{k}:{a}:{b}" for k, a, b in own if k != "markov")
                kinds = [k for k, _, _ in own]
                row = (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in own), [{"kind": k, "start": a, "end": b} for k, a, b in own])
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [span]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["doc_id", *out])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(look, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind string, start long, end long>>")
