"""Exact BPE encoding of many texts with few calls of the tokenizer.

Texts are cut at blanks into units at which the tokenizer cuts as well; a unit
is encoded by the tokenizers library when it is first met and remembered, and
the ids of a batch are gathered from that memory with array operations. Units
for which the cut would not be exact go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units remembered by one worker before it starts anew.
MOST_UNITS = 400_000


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lens[i]] for each i, one after another."""
    ends = np.cumsum(lens)
    if len(ends) == 0 or ends[-1] == 0:
        return flat[:0]
    at = np.repeat(starts - (ends - lens), lens)
    at += np.arange(ends[-1], dtype=at.dtype)
    return flat[at]


class Memory:
    """Ids of units, in one growing array."""

    def __init__(self, encode):
        self.encode = encode
        self.clear()

    def clear(self):
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def add(self, units: list[str]):
        ids = self.encode(units)
        n, more = len(self.known), sum(map(len, ids))
        while n + len(units) > len(self.starts):
            self.starts, self.lens = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.lens, np.zeros_like(self.lens)])
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self.lens[n : n + len(ids)] = lens
        self.starts[n : n + len(ids)] = self.used + np.cumsum(lens) - lens
        self.flat[self.used : self.used + more] = np.fromiter((x for one in ids for x in one), np.uint32, more)
        self.used += more
        self.known.update(zip(units, range(n, n + len(units)), strict=True))

    def numbers(self, units: list[str]) -> np.ndarray:
        """The number of each of these different units."""
        if len(self.known) > MOST_UNITS:
            self.clear()
        get = self.known.get
        found = [get(u, -1) for u in units]
        if missing := [u for u, k in zip(units, found, strict=True) if k < 0]:
            self.add(missing)
            found = [self.known[u] for u in units]
        return np.array(found, np.int64)


#: A Latin letter followed by an ASCII mark other than the apostrophe: both tokenizers cut between the two.
CUT = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])"


def _cut(texts: pa.Array, separator: str):
    """Texts split at the separator: different units, the unit at each place, and where each text's places begin."""
    units = pc.split_pattern(texts, separator)
    values, ends = units.flatten(), units.offsets.to_numpy().astype(np.int64)
    coded = values.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64), ends - ends[0]


def _runs(ids: list[int], ends: np.ndarray) -> list[list[int]]:
    bounds = [0, *ends.tolist()]
    return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class WordPieces:
    """For tokenizers that drop white space, fold case and mark word ends, such as word_bpe_49k.

    The tokenizer composes (NFC) before it lowers. Letters in ASCII may be lowered
    first only where nothing composes with them, so texts that hold a combining mark
    go to the library whole.
    """

    LETTERS = re.compile(r"[a-zà-öø-ÿ]+")
    #: The marks with which ASCII characters compose.
    MARKS = "[\u0300-\u036f]"

    def __init__(self, path: str):
        self.tokenizer = load(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True
        self.memory = Memory(self._units)

    def _units(self, units: list[str]) -> list[list[int]]:
        """Words of letters are encoded as one text: each ends with the one token that marks a word's end."""
        plain = [u for u in units if self.LETTERS.fullmatch(u)]
        ids = self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids
        ends = np.flatnonzero(self.last[np.array(ids, np.int64)]) + 1 if ids else np.zeros(0, np.int64)
        if len(ends) != len(plain):
            plain, ends = [], np.zeros(0, np.int64)
        found = dict(zip(plain, _runs(ids, ends), strict=True))
        rest = [u for u in units if u not in found]
        found.update((u, e.ids) for u, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        return [found[u] for u in units]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts as one array, and where each text's begin (one more entry than texts)."""
        if texts.null_count:
            texts = texts.fill_null("")
        special = np.flatnonzero(pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, self.MARKS)).to_numpy(zero_copy_only=False))
        whole = [texts[int(i)].as_py() for i in special]
        low = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
        words, at, ends = _cut(pc.replace_substring_regex(low, CUT, r"\1 \2"), " ")
        names = list(dict.fromkeys([*words, *whole])) if whole else words
        numbers = self.memory.numbers(names)
        number = numbers[at]
        lens = self.memory.lens[number]
        if whole:  # a control token in capitals is none
            by = dict(zip(names, numbers.tolist(), strict=True))
            for i, text in zip(special, whole, strict=True):
                lens[ends[i] : ends[i + 1]] = 0
                number[ends[i]], lens[ends[i]] = by[text], self.memory.lens[by[text]]
        ids = gather(self.memory.flat, self.memory.starts[number], lens)
        return ids, np.concatenate([[0], np.cumsum(lens)])[ends]


class BytePieces:
    """For byte-level tokenizers whose pieces begin with the blank before a word, such as byte_bpe_50k.

    Cuts stand before a blank that anything but white space follows, around a
    line end without white space at its sides, and between a letter and a mark;
    the tokenizer cuts there whatever stands around. Texts with other white space
    go to the library whole.
    """

    LETTERS = re.compile(r" [A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, path: str, tokenizer=None):
        self.tokenizer = tokenizer or load(path)
        vocabulary = self.tokenizer.get_vocab()
        self.first = np.zeros(max(vocabulary.values()) + 1, bool)
        self.first[[k for w, k in vocabulary.items() if w.startswith("\u0120")]] = True
        self.memory = Memory(self._units)

    def _units(self, units: list[str]) -> list[list[int]]:
        """Words of letters are encoded as one text: each begins with the one token that holds its blank."""
        plain = [u for u in units if self.LETTERS.fullmatch(u)]
        ids = self.tokenizer.encode_batch_fast(["".join(plain)], add_special_tokens=False)[0].ids
        begins = np.flatnonzero(self.first[np.array(ids, np.int64)]) if ids else np.zeros(0, np.int64)
        if len(begins) != len(plain):
            plain, begins, ids = [], np.zeros(0, np.int64), []
        found = dict(zip(plain, _runs(ids, np.append(begins[1:], len(ids))) if plain else [], strict=True))
        rest = [u for u in units if u not in found]
        found.update((u, e.ids) for u, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        return [found[u] for u in units]

    @staticmethod
    def _odd(unit: str) -> bool:
        if unit == "\n":
            return False
        return not unit or unit[-1].isspace() or unit[0].isspace() and (unit[0] != " " or unit[1].isspace())

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if texts.null_count:
            texts = texts.fill_null("")
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        words, at, ends = _cut(pc.replace_substring_regex(marked, CUT, "\\1\0\\2"), "\0")
        firsts = ends[:-1]
        odd = np.array([self._odd(w) for w in words], bool)[at] if len(at) else np.zeros(0, bool)
        # an empty unit before a leading blank or after a closing line end means nothing
        begins, closes = np.zeros(len(at), bool), np.zeros(len(at), bool)
        begins[firsts], closes[ends[1:] - 1] = True, True
        empty = np.array([not w for w in words], bool)[at] if len(at) else odd
        odd &= ~(empty & (begins | closes))
        strange = pc.or_(pc.match_substring(texts, "\0"), pc.match_substring(texts, "<|")).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero((np.add.reduceat(odd, firsts) > 0) | strange) if len(firsts) else []
        wholes = [texts[int(i)].as_py() for i in whole]
        names = list(dict.fromkeys([*words, *wholes])) if wholes else words
        numbers = self.memory.numbers(names)
        number = numbers[at]
        lens = self.memory.lens[number]
        if wholes:
            by = dict(zip(names, numbers.tolist(), strict=True))
            for i, text in zip(whole, wholes, strict=True):
                lens[firsts[i] : ends[i + 1]] = 0
                number[firsts[i]], lens[firsts[i]] = by[text], self.memory.lens[by[text]]
        ids = gather(self.memory.flat, self.memory.starts[number], lens)
        return ids, np.concatenate([[0], np.cumsum(lens)])[ends]


_OWN: dict[tuple, object] = {}


def encoder(kind: type, path: str):
    """This worker's encoder for a vocabulary file."""
    if (kind, path) not in _OWN:
        _OWN[kind, path] = kind(path)
    return _OWN[kind, path]
