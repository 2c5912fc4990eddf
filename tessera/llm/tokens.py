"""Token ids of whole texts through the tokenizers library, remembering the ids of pieces it has seen.

The vocabulary file splits texts at white space and between letters and other characters before it merges
anything, so the ids of a text are the ids of its pieces, one after the other. Pieces are cut here at ASCII white
space and between an ASCII letter and an ASCII sign other than the apostrophe; each distinct piece goes through the
library once per worker, and is known again by its bytes: hashes only say where to look. Texts that may hold a special
token's string, or a piece whose hash another piece has, go through the library as they are, and so do all texts where
the vocabulary file normalises or splits otherwise than ``NORMAL`` and ``SPLIT`` say.
"""

from __future__ import annotations

import json
import os
from itertools import chain
from unicodedata import normalize

import numpy as np
import pyarrow as pa

from tessera.llm.textblocks import CACHES, SPACE, gather, hashes, lowered, release, same_bytes

#: Pieces that a worker remembers; beyond it the memory is emptied and filled anew.
REMEMBERED = 1_200_000

#: Words of letters that go through the library as one text.
WORDS_AT_ONCE = 64
#: Bytes of remembered pieces beside a block's own.
BODY_BYTES = 1 << 26

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


# How a vocabulary file must normalise and split for its texts to be encoded piece by piece.
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: Bytes of text that are encoded at once: pieces repeat more in larger blocks.
BLOCK_BYTES = 2 << 20


def default_tokenizer() -> str:
    """Path of the public vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _simple(word: str) -> bool:
    """Latin letters up to U+024F but for those whose lower case isn't one letter: lower-casing needs no context."""
    return max(word) < "\u0250" and "\u0130" not in word


def _room(values: np.ndarray, n: int) -> np.ndarray:
    """The array with room for ``n`` values."""
    if n <= len(values):
        return values
    grown = np.zeros(max(n, len(values) + (len(values) >> 1)), values.dtype)
    grown[: len(values)] = values
    return grown


class Encoder:
    """Ids of texts by one vocabulary file; ``shared`` keeps one encoder per worker and file."""

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        bare = json.loads(self.library.to_str())
        special = [t["content"] for t in bare["added_tokens"]]
        #: Whether pieces may be encoded apart from each other.
        self.by_piece = bare["normalizer"] == NORMAL and bare["pre_tokenizer"] == SPLIT and not (bare["truncation"] or bare["padding"]) and all(t.startswith("<|") for t in special)
        suffix = bare["model"].get("end_of_word_suffix")
        self.by_piece &= bool(suffix) and bare["model"]["type"] == "BPE" and not bare["model"].get("dropout")
        bare["normalizer"] = None
        bare["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, SPLIT["pretokenizers"][1]]}
        #: The same merges without normalising and splitting but at spaces, for runs of letters in normal form; ids that end a word.
        self.letters = Tokenizer.from_str(json.dumps(bare)) if self.by_piece else None
        vocabulary = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[n for token, n in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        del bare, vocabulary
        release()
        self._empty()

    @classmethod
    def shared(cls, path: str) -> "Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _empty(self) -> None:
        #: Hashes of known pieces in order, and the slot of each.
        self.keys, self.slot_of = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.known = 0
        #: Ids and bytes of all known pieces by slot, one after the other; a slot ends where the next begins.
        self.flat, self.begin = np.zeros(4096, np.uint16), np.zeros(1025, np.int32)
        self.body, self.body_at = np.zeros(4096, np.uint8), np.zeros(1025, np.int32)

    def _learn(self, raw: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Remember the ids and bytes of new pieces; the slot of each."""
        size = stop - begin
        upto = np.concatenate([[0], np.cumsum(_LETTER[raw], dtype=np.int32)])
        ascii_word = upto[stop] - upto[begin] == size
        plain, odd = np.flatnonzero(ascii_word), np.flatnonzero(~ascii_word)
        flat, sizes = self._ascii_words(raw, begin[plain], size[plain])
        words = [raw[a:b].tobytes().decode() for a, b in zip(begin[odd].tolist(), stop[odd].tolist(), strict=True)]
        simple = np.array([w.isalpha() and _simple(w) for w in words], bool)
        more, other = odd[simple], odd[~simple]
        found = self._words([normalize("NFC", w).lower() for w, ok in zip(words, simple, strict=True) if ok])
        rest = [e.ids for e in self.library.encode_batch_fast([w for w, ok in zip(words, simple, strict=True) if not ok], add_special_tokens=False)]
        flat = np.concatenate([flat, found[0], np.fromiter(chain.from_iterable(rest), np.int64)])
        sizes = np.concatenate([sizes, found[1], np.fromiter(map(len, rest), np.int64, len(rest))])
        order = np.concatenate([plain, more, other])
        slots = np.empty(len(order), np.int64)
        slots[order] = self.known + np.arange(len(order))
        if len(flat) and flat.max() > 0xFFFF and self.flat.dtype != np.uint32:
            self.flat = self.flat.astype(np.uint32)
        whole, n = raw[gather(begin[order], size[order])], self.known + len(order)
        used, written = int(self.begin[self.known]), int(self.body_at[self.known])
        self.begin, self.body_at = _room(self.begin, n + 1), _room(self.body_at, n + 1)
        self.flat, self.body = _room(self.flat, used + len(flat)), _room(self.body, written + len(whole))
        self.flat[used : used + len(flat)] = flat
        self.body[written : written + len(whole)] = whole
        self.begin[self.known + 1 : n + 1] = used + np.cumsum(sizes)
        self.body_at[self.known + 1 : n + 1] = written + np.cumsum(size[order])
        self.known = n
        return slots

    def _ascii_words(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_words`` of ASCII letters, which are lower-cased and joined as bytes."""
        if not len(begin):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = np.append(lowered(raw), np.uint8(0x20))[gather(begin, size + 1)]
        ends = np.cumsum(size + 1)
        text[ends - 1] = 0x20
        body, cuts = text.tobytes().decode("ascii"), [0, *ends[WORDS_AT_ONCE - 1 : -1 : WORDS_AT_ONCE].tolist(), int(ends[-1])]
        return self._joined([body[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a], len(begin)) or self._words(body.split(" ")[:-1], one_by_one=True)

    def _joined(self, texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids of all words one after the other, number of ids of each of the ``n`` words); None if ids don't tell where words end."""
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.letters.encode_batch_fast(texts, add_special_tokens=False)), np.int64)
        ends = np.flatnonzero(self.ends_word[ids])
        if len(ends) != n or len(ids) and (not n or ends[-1] != len(ids) - 1):
            return None
        return ids, np.diff(ends, prepend=-1)

    def _words(self, words: list[str], one_by_one: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words of letters, as ``_joined`` gives them."""
        found = None if one_by_one else self._joined([" ".join(words[at : at + WORDS_AT_ONCE]) for at in range(0, len(words), WORDS_AT_ONCE)], len(words))
        if found is None:
            each = [e.ids for e in self.letters.encode_batch_fast(words, add_special_tokens=False)]
            found = np.fromiter(chain.from_iterable(each), np.int64), np.fromiter(map(len, each), np.int64, len(each))
        return found

    def encode(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other as uint32, number of ids of each text)."""
        counts = np.zeros(len(starts), np.int64)
        if not len(raw):
            return np.zeros(0, np.uint32), counts
        if not self.by_piece:
            return self._whole(raw, starts, ends, np.zeros(0, np.uint32), counts, np.arange(len(starts)))
        begin, stop = _pieces(raw, starts, ends)
        key = hashes(raw, begin, stop).view(np.int64)
        coded = pa.array(key).dictionary_encode()
        index, unique = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        if self.known and (self.known + len(unique) > REMEMBERED or int(self.body_at[self.known]) + len(raw) > BODY_BYTES):
            self._empty()
        order = np.argsort(unique)
        wanted = unique[order]
        place = np.searchsorted(self.keys, wanted)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == wanted[known]
        found = np.zeros(len(unique), np.int64)
        found[known] = self.slot_of[place[known]]
        if len(new := np.flatnonzero(~known)):
            at = np.zeros(len(unique), np.int32)
            at[index] = np.arange(len(index), dtype=np.int32)
            at = at[order[new]]
            found[new] = self._learn(raw, begin[at], stop[at])
            self.keys, self.slot_of = np.insert(self.keys, place[new], wanted[new]), np.insert(self.slot_of, place[new], found[new])
        slot = np.empty(len(unique), np.int64)
        slot[order] = found
        slot = slot[index]
        length = (self.begin[slot + 1] - self.begin[slot]).astype(np.int64)
        ids = self.flat[gather(self.begin[slot], length)].astype(np.uint32)
        upto = np.concatenate([[0], np.cumsum(length)])
        counts = np.diff(upto[np.searchsorted(begin, np.append(starts, len(raw)))])
        # Texts with ``<|`` may hold a special token's string; a piece with another's hash has ids of its own.
        other = begin[~same_bytes(raw, begin, stop, self.body, self.body_at[slot], self.body_at[slot + 1])]
        hit = np.concatenate([np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)), other])
        return self._whole(raw, starts, ends, ids, counts, np.unique(np.searchsorted(starts, hit, "right") - 1) if len(hit) else hit)

    def _whole(self, raw, starts, ends, ids, counts, rows):
        """The ids with those of ``rows`` as the library gives them for the whole texts."""
        if not len(rows):
            return ids, counts
        parts, done, at = [], 0, np.concatenate([[0], np.cumsum(counts)])
        for r in rows.tolist():
            own = self.library.encode(raw[starts[r] : ends[r]].tobytes().decode(), add_special_tokens=False).ids
            parts += [ids[at[done] : at[r]], np.array(own, np.uint32)]
            counts[r], done = len(own), r + 1
        return np.concatenate([*parts, ids[at[done] :]]), counts


CACHES.append(lambda: [e._empty() for e in Encoder._made.values()])


def _pieces(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside, letter, sign = ~SPACE[raw], _LETTER[raw], _SIGN[raw]
    first, last = inside.copy(), inside.copy()
    turn = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
    first[1:] &= ~inside[:-1] | turn
    last[:-1] &= ~inside[1:] | turn
    filled = ends > starts
    first[starts[filled]] |= inside[starts[filled]]
    last[ends[filled] - 1] |= inside[ends[filled] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text's own."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1
