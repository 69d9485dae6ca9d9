"""Texts that contain given strings, by the parts of texts that may be one of them.

All strings' bytes are known to each task by two bitmaps of fixed size: of what the strings
begin with, and of the strings themselves (their first LONG bytes). A text gives each of
its parts that both bitmaps know, once, and parts equal strings by a join. So what is sent
is what stands in the texts, and few others; only longer strings are looked for in the text
again. A place in a text is hashed for 1, 2, 4, 8 and so on bytes; a string of n bytes
begins with the largest of these that n holds, and two such hashes make up that of n bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_of

#: Bytes of a string that are compared by the join; cells of a bitmap as a power of two; bytes of texts, and parts, at a time.
LONG, MAP_BITS, SLICE, ROWS = 96, 24, 1 << 20, 1 << 14

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def _slices(array: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of about SLICE bytes: number of the first text, bytes of all, bounds of each."""
    array = array.cast(pa.large_string()).fill_null("")
    if len(array) == 0:
        return
    ends = np.frombuffer(array.buffers()[1], "<i8", len(array) + 1 + array.offset)[array.offset :]
    body = array.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, side="right")) - 1)
        yield at, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def _joined(h: np.ndarray, later: np.ndarray, n: int) -> np.ndarray:
    return _mix(h * _M2 + later + np.uint64(n))


def _starts(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For 1, 2, 4 and so on bytes up to LONG: hashes of so many bytes from each place on."""
    q, h = 1, _mix(data.astype(np.uint64) + np.uint64(1))
    while q <= LONG and len(h):
        yield q, h
        h = _joined(h[: len(h) - q], h[q:], 2 * q) if len(h) > q else h[:0]
        q *= 2


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    cell = _cells(h)
    return (bits[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 1


def _pattern_bits(batches):
    """Words of 64 cells: of kind 0, what patterns begin with; of kind 1, patterns; of kind 2, their lengths."""
    for batch in batches:
        for _, data, bounds in _slices(batch.column(0)):
            size = np.minimum(np.diff(bounds), LONG)
            kinds, cells = [np.full(len(size), 2)], [size]
            for q, h in _starts(data):
                for n in np.unique(size[(size >= q) & (size < 2 * q)]).tolist():
                    at = bounds[:-1][size == n]
                    kinds += [np.zeros(len(at), np.int64), np.ones(len(at), np.int64)]
                    cells += [_cells(h[at]), _cells(_joined(h[at], h[at + n - q], n))]
            kind, cell = np.concatenate(kinds), np.concatenate(cells)
            yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array((cell >> 6).astype(np.int32)), pa.array(np.left_shift(np.uint64(1), (cell & 63).astype(np.uint64)).view(np.int64))], names=["kind", "word", "bits"])


def _bitmaps(patterns: DataFrame) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Both bitmaps, 2 MB each at most, and the lengths of patterns up to LONG."""
    out = np.zeros((3, 1 << (MAP_BITS - 6)), np.uint64)
    words = patterns.select("pattern").mapInArrow(_pattern_bits, "kind int, word int, bits long").groupBy("kind", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[words.column("kind").to_numpy(), words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    lengths = [n for n in range(1, LONG + 1) if out[2][n >> 6] >> np.uint64(n & 63) & np.uint64(1)]
    return out[0], out[1], lengths


def _apart(place: np.ndarray, new: np.ndarray, n: int) -> np.ndarray:
    """Of each group of ascending places, how many are n apart, from the first on."""
    edge = np.flatnonzero(new)
    count = np.diff(np.append(edge, len(place)))
    near = np.flatnonzero((np.diff(place) < n) & ~new[1:])
    for g in np.unique(np.searchsorted(edge, near, side="right") - 1).tolist():
        last, kept = -n, 0
        for x in place[edge[g] : edge[g] + count[g]].tolist():
            if x - last >= n:
                last, kept = x, kept + 1
        count[g] = kept
    return count


def _parts_of(batches, begins: np.ndarray, whole: np.ndarray, lengths: list[int]):
    """(text_id, part, n): the parts of each text that patterns may be, each once, and how often they stand there without overlap."""
    for batch in batches:
        for first, data, bounds in _slices(batch.column("text")):
            for q, h in _starts(data):
                some = [n for n in lengths if q <= n < 2 * q]
                if not some:
                    continue
                at = np.flatnonzero(_known(begins, h))
                row = np.searchsorted(bounds, at, side="right") - 1
                left = bounds[row + 1] - at
                for n in some:
                    fits = left >= n
                    place, of = at[fits], row[fits]
                    name = _joined(h[place], h[place + n - q], n)
                    there = _known(whole, name)
                    place, of, name = place[there], of[there], name[there]
                    order = np.lexsort((name, of))
                    place, of, name = place[order], of[order], name[order]
                    new = np.ones(len(name), bool)
                    new[1:] = (name[1:] != name[:-1]) | (of[1:] != of[:-1])
                    times = _apart(place, new, n)
                    place, of = place[new], of[new]
                    for k in range(0, len(place), ROWS):
                        body = data[place[k : k + ROWS, None] + np.arange(n)]
                        part = pa.Array.from_buffers(pa.binary(), len(body), [None, pa.py_buffer(np.arange(0, (len(body) + 1) * n, n, dtype=np.int32)), pa.py_buffer(body.tobytes())])
                        yield pa.RecordBatch.from_arrays([batch.column("text_id").take(pa.array(first + of[k : k + ROWS])), part, pa.array(times[k : k + ROWS])], names=["text_id", "part", "n"])


def candidates(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pairs (text_id, pattern) of the texts that contain the pattern, or its first LONG bytes; n, how often these stand there without overlap.

    texts: text_id, text; patterns: pattern, different strings, not empty. Patterns are
    read twice, texts once.
    """
    begins, whole, lengths = _bitmaps(patterns)
    kind = texts.schema["text_id"].dataType.simpleString()
    parts = texts.select("text_id", "text").mapInArrow(lambda batches: _parts_of(batches, begins, whole, lengths), f"text_id {kind}, part binary, n long")
    return parts.join(patterns.select("pattern", F.substring(F.col("pattern").cast("binary"), 1, LONG).alias("part")), "part").select("text_id", "pattern", "n")


def _long(patterns: DataFrame) -> bool:
    return not patterns.where(F.octet_length("pattern") > LONG).isEmpty()


def contained(texts: DataFrame, patterns: DataFrame, text_id: str = "text_id", text: str = "text", pattern: str = "pattern") -> DataFrame:
    """Pairs (text_id, pattern): the different strings of `pattern`, not empty, and the texts in which they stand.

    Null texts contain nothing; rows with one id and different texts are looked at apart.
    """
    t = texts.select(F.col(text_id).alias("text_id"), F.col(text).alias("text")).where("text is not null")
    p = patterns.select(F.col(pattern).alias("pattern")).where("pattern <> ''").distinct()
    pairs = candidates(t, p)
    if _long(p):
        pairs = pairs.join(t.withColumnRenamed("text_id", "_id"), F.col("text_id").eqNullSafe(F.col("_id")) & (F.octet_length("pattern") > LONG), "left")
        pairs = pairs.where((F.octet_length("pattern") <= LONG) | F.contains("text", F.col("pattern")))
    return pairs.select(F.col("text_id").alias(text_id), F.col("pattern").alias(pattern)).distinct()


def occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_id, pattern, n): how often each pattern stands in each text that has it, without overlap.

    texts: text_id, text; text_id is unique. patterns: pattern, different strings, not empty.
    """
    found = candidates(texts.where("text is not null"), patterns)
    if not _long(patterns):
        return found
    again = found.where(F.octet_length("pattern") > LONG).join(texts, "text_id").select("text_id", "pattern", count_of(F.col("text"), F.col("pattern")).alias("n"))
    return found.where(F.octet_length("pattern") <= LONG).union(again.where("n > 0"))
