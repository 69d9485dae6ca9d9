"""Byte-level BPE encoding of documents with reuse of content-defined chunks.

A rolling hash cuts texts into chunks where its top bits are zero, so documents
that share a passage share its chunks wherever they stand. Rows are brought
together by the smallest hash of their chunks (as balanced partitions: a hot
group of copies is split), and a worker encodes each chunk it meets once. The
joins of chunks are then repaired: between the last point of a chunk and the
first of the next at which the tokenizer must cut, the text is encoded again;
where a chunk's tokens do not end exactly at such a point, the stretch widens
to the next chunk, until both sides agree.

Null and empty texts have no ids. Texts of any length are used whole; repeated
rows stay; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes
from .pieces import BytePieces, encoder, gather

#: Chunks have about 2**BITS bytes, LEAST at least; a worker remembers KEPT bytes of ids.
BITS, LEAST, KEPT = 10, 256, 64 << 20

_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_PLAIN = np.array([b > 0x20 and b < 0x7F for b in range(256)])


def cuts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin in the bytes of all texts (with the end), and how many each text has."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):  # the sum over the last 32 bytes, each shifted by its distance
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    found = np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + 1
    text = np.searchsorted(at, found, side="right") - 1
    # the hash must not reach into the text before, nor the cut into a character
    ok = (found - at[np.minimum(text, len(at) - 2)] >= 32) & (found < len(data))
    found, text = found[ok], text[ok]
    ok = (found < at[text + 1]) & ((data[found] & 0xC0) != 0x80)
    found, text = found[ok].tolist(), text[ok].tolist()
    bounds, counts = [], np.ones(len(at) - 1, np.int64)
    ends, k = at.tolist(), 0
    for i in range(len(ends) - 1):
        if ends[i] == ends[i + 1]:
            counts[i] = 0
            continue
        last = ends[i]
        bounds.append(last)
        while k < len(found) and text[k] == i:
            if found[k] - last >= LEAST:
                last = found[k]
                bounds.append(last)
                counts[i] += 1
            k += 1
    return np.array([*bounds, ends[-1]], np.int64), counts


def _strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Runs of the bytes as an array of texts."""
    lens = end - begin
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(gather(data, begin, lens)))


def _route(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            data, at = text_bytes(batch.column("text"))
            bounds, counts = cuts(data, at)
            view = memoryview(np.ascontiguousarray(data))
            keys = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], np.uint64)
            route = np.zeros(len(counts), np.uint64)
            full = np.flatnonzero(counts)
            if len(full):
                route[full] = np.minimum.reduceat(keys, (np.cumsum(counts) - counts)[full])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(route.view(np.int64))], names=["id", "text", "route"])


class Reuse:
    """Encodes texts by their chunks; a chunk met before isn't encoded again."""

    def __init__(self, path: str):
        self.pieces = encoder(BytePieces, path)
        tokenizer = self.pieces.tokenizer
        alphabet = {c: b for b, c in _alphabet().items()}
        self.words = [b""] * tokenizer.get_vocab_size()
        for word, k in tokenizer.get_vocab().items():
            self.words[k] = bytes(alphabet[c] for c in word)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.known: dict[bytes, np.ndarray] = {}
        self.kept = 0

    def chunks(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        view = memoryview(np.ascontiguousarray(data))
        keys = [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        if self.kept > KEPT:
            self.known, self.kept = {}, 0
        new: dict[bytes, int] = {}
        for i, k in enumerate(keys):
            if k not in self.known:
                new.setdefault(k, i)
        if new:
            which = np.array(list(new.values()), np.int64)
            ids, at = self.pieces(_strings(data, bounds[which], bounds[which + 1]))
            for k, a, b in zip(new, at[:-1].tolist(), at[1:].tolist(), strict=True):
                self.known[k] = ids[a:b].copy()
            self.kept += 4 * len(ids)
        return [self.known[k] for k in keys]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        data, at = text_bytes(texts)
        bounds, counts = cuts(data, at)
        if len(bounds) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        own = self.chunks(data, bounds)
        # points at which every tokenization is cut: a blank between ASCII letters or marks
        safe = np.flatnonzero((data[1:-1] == 0x20) & _PLAIN[data[:-2]] & _PLAIN[data[2:]]) + 1
        low = np.searchsorted(safe, bounds[:-1] + 1)
        high = np.searchsorted(safe, bounds[1:] - 1) - 1
        text = np.repeat(np.arange(len(counts)), counts)
        opens = np.append(True, text[1:] != text[:-1])
        closes = np.append(text[1:] != text[:-1], True)
        parts: list = []  # of ids, or (begin, end) of a stretch to encode
        owner: list[int] = []
        pending = 0
        for i, (ids, lo, hi, first, last, t) in enumerate(zip(own, low.tolist(), high.tolist(), opens.tolist(), closes.tolist(), text.tolist(), strict=True)):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if first:
                pending = a
            if first and last:
                parts.append(ids)
                owner.append(t)
                continue
            if lo <= hi:
                ends = np.cumsum(self.size[ids]) + a
                left, right = (a if first else int(safe[lo])), (b if last else int(safe[hi]))
                x = 0 if first else int(np.searchsorted(ends, left)) + 1
                y = len(ids) if last else int(np.searchsorted(ends, right)) + 1
                if (first or ends[x - 1] == left) and (last or ends[y - 1] == right):
                    if left > pending:
                        parts.append((pending, left))
                        owner.append(t)
                    parts.append(ids[x:y])
                    owner.append(t)
                    pending = right
            if last and pending < b:
                parts.append((pending, b))
                owner.append(t)
        gaps = [p for p in parts if isinstance(p, tuple)]
        if gaps:
            g = np.array(gaps, np.int64)
            ids, ends = self.pieces(_strings(data, g[:, 0], g[:, 1]))
            again = iter(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            parts = [ids[slice(*next(again))] if isinstance(p, tuple) else p for p in parts]
        lens = np.bincount(np.array(owner, np.int64), np.fromiter(map(len, parts), float, len(parts)), minlength=len(counts)).astype(np.int64)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(lens)])


def _alphabet() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _table(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(lens) - lens, lens


def _spell(ids: np.ndarray, at: np.ndarray, words: tuple) -> tuple[memoryview, list[int]]:
    """The words of all ids, one after another, and where each text's begin."""
    flat, starts, lens = words
    size = lens[ids]
    return memoryview(np.ascontiguousarray(gather(flat, starts[ids], size))), np.concatenate([[0], np.cumsum(size)])[at].tolist()


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col and ids (little-endian unsigned 32-bit)."""
    return _encoded(df, tokenizer, id_col, text_col, lambda reuse: lambda ids, at: {"ids": pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())}, "ids binary")


def digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, n_tokens, ids_sha256, decoded_sha256."""

    def of(reuse):
        spelled, decimal = _table(reuse.words), _table([b"%d," % k for k in range(len(reuse.words))])

        def one(ids, at):
            sums = []
            for words, cut in ((decimal, 1), (spelled, 0)):
                body, ends = _spell(ids, at, words)
                sums.append(pa.array([hashlib.sha256(body[a : max(a, b - cut)]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string()))
            return {"n_tokens": pa.array(np.diff(at)), "ids_sha256": sums[0], "decoded_sha256": sums[1]}

        return one

    return _encoded(df, tokenizer, id_col, text_col, of, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(df: DataFrame, tokenizer: str, id_col: str, text_col: str, make, columns: str) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        reuse = encoder(Reuse, tokenizer)
        finish = make(reuse)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = reuse(batch.column("text"))
                yield pa.RecordBatch.from_pydict({"id": batch.column("id")} | finish(ids, at))

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    together = rows.mapInArrow(_route, f"id {kind}, text string, route long").hint("rebalance", "route")
    return together.mapInArrow(run, f"id {kind}, {columns}").withColumnRenamed("id", id_col)
