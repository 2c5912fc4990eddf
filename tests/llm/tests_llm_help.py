"""Brute-force versions that several tests use."""

import hashlib
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np

from tessera.llm.tokens import Encoder, default_tokenizer

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def lowered(text):
    return (text or "").translate(LOWER)


def library_ids(texts, end_id):
    library = Encoder.shared(default_tokenizer()).library
    return [library.encode(t or "", add_special_tokens=False).ids + [end_id] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_pieces(pieces, rows, end_id, window):
    ids = defaultdict(list)
    for r, i in zip(rows, library_ids([r[1] for r in rows], end_id), strict=True):
        ids[r[0]].append(i)
    sequences, cover = defaultdict(list), defaultdict(Counter)
    for p in pieces:
        assert any(p.ids_crc32 == crc(i[p.start : p.start + p.length]) and p.doc_tokens == len(i) for i in ids[p.doc_id])
        sequences[p.sequence_id].append((p.offset, p.length))
        cover[p.doc_id].update(range(p.start, p.start + p.length))
    for key, own in ids.items():
        assert cover[key] == sum((Counter(range(len(i))) for i in own), Counter())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == window or at < window and at & (at - 1) == 0


def brute_hits(text, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    words, hit, met = split(text), set(), set()
    for name, body in items:
        own = split(body)
        size = min(window, len(own))
        for k in range(len(own) - size + 1) if own else ():
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[k : k + size]:
                    hit.update(range(at, at + size))
                    met.add(str(name))
    return len(words), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)


def brute_near(rows, similarity=0.8):
    """The smallest id of each row's component, in order of the rows."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 10 * len(a & b) >= round(10 * similarity) * len(a | b) > 0:
                label[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(rows))]
