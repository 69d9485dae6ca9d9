"""Importance resampling of documents towards a target, by hashed runs of words.

Features of a text are its runs of one to three words; a feature's bucket is the crc32
of its bytes modulo BUCKETS. A bucket gains by the log ratio of its smoothed shares in
the target and in the corpus, a document weighs the sum over its features, and the
documents of the highest weight plus seeded Gumbel noise are drawn.

The vocabulary has a head and a tail. The head goes to every task: the crc states of at
most WORDS frequent words, and of at most PAIRS frequent pairs of them. Words outside it
take their crc from their bytes, and a run that isn't a frequent pair continues its first
words' state over the bytes of the next word, by tables of the crc's linear shifts. Both
give the crc of the whole run, so the bucket totals are exact whatever the head holds.
A word (pair) that makes a share of 1 / WORDS (1 / PAIRS) of the corpus makes one in some
stretch of it, so that only those of each stretch are counted together for the head.

Null texts have no words, and a null doc_id draws its noise as an empty one; repeated rows
count and are drawn apiece, equal scores by doc_id, then by weight; without target texts
or corpus all totals are 0; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import VECTOR_SCHEMA, slices, stored, summed, text_bytes, vector_rows
from .ranks import positions

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 42, 20, 5
WORDS, PAIRS, SLOTS = 1 << 16, 1 << 17, 1 << 18
#: Words of more bytes aren't in the head; shifts up to this have tables of their own.
LONGEST = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def _one_byte() -> np.ndarray:
    """What a zero byte makes of a crc's lowest byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


def _bytes_of(tables: np.ndarray, n: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[n, 0, crc & 255]
    for k in (1, 2, 3):
        out ^= tables[n, k, (crc >> np.uint32(8 * k)) & 255]
    return out


class Shifts:
    """crc of A and B joined, from the crc of A and that of B: the first is shifted by the bytes of B."""

    def __init__(self):
        start = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
        byte = _one_byte()
        self.short = np.empty((LONGEST + 1, 4, 256), np.uint32)
        self.short[0] = start
        for n in range(LONGEST):
            self.short[n + 1] = byte[self.short[n] & 255] ^ (self.short[n] >> 8)
        self.powers = np.empty((32, 4, 256), np.uint32)
        self.powers[0] = self.short[1]
        for k in range(31):
            self.powers[k + 1] = _bytes_of(self.powers, np.full((4, 256), k), self.powers[k])

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = _bytes_of(self.short, np.minimum(n, LONGEST), crc)
        if len(far := np.flatnonzero(n > LONGEST)):
            c, left = crc[far], n[far]
            for k in range(32):
                odd = np.flatnonzero((left >> k) & 1)
                c[odd] = _bytes_of(self.powers, np.full(len(odd), k), c[odd])
            out[far] = c
        return out


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """For all words of the texts: the text's number, the word's number, and the different words."""
    data, at = text_bytes(texts)
    data = _LOWER[data]
    word = _WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    starts, ends = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
    first[starts], last[ends] = word[starts], word[ends]
    begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(begin) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    bounds = np.empty(2 * len(begin) + 1, np.int64)
    bounds[:-1:2], bounds[1::2], bounds[-1] = begin, stop, len(data)
    slices_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = slices_.take(pa.array(np.arange(0, 2 * len(begin), 2))).dictionary_encode()
    return np.searchsorted(at, begin, side="right") - 1, coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def _frequent(batches):
    """Words and pairs of each stretch that make their share of it."""
    for whole in batches:
        for batch in slices(whole, "text"):
            doc, number, different = words(batch.column("text"))
            if not different:
                continue
            count = np.bincount(number)
            often = np.flatnonzero((count >= len(number) / WORDS) & (np.array([len(w) for w in different]) <= LONGEST))
            head = np.zeros(len(different), bool)
            head[often] = True
            pair = np.flatnonzero((doc[1:] == doc[:-1]) & head[number[1:]] & head[number[:-1]])
            code, n = np.unique(number[pair] * len(different) + number[pair + 1], return_counts=True)
            keep = n >= max(2, len(number) / PAIRS)
            a, b = np.divmod(code[keep], len(different))
            get = lambda k: [different[i] for i in k.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(get(often) + get(a), pa.binary()), pa.array([None] * len(often) + get(b), pa.binary()), pa.array(np.concatenate([count[often], n[keep]]), pa.int64())], names=["a", "b", "n"]
            )


def head(texts: DataFrame) -> tuple[list[bytes], list[tuple[bytes, bytes]]]:
    """At most WORDS frequent words and PAIRS frequent pairs of the texts, most frequent first."""
    counts = stored(texts.mapInArrow(_frequent, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "frequent")
    top = lambda rows, most: rows.orderBy(F.desc("n"), "a", "b").limit(most).collect()
    return [bytes(r["a"]) for r in top(counts.where("b is null"), WORDS)], [(bytes(r["a"]), bytes(r["b"])) for r in top(counts.where("b is not null"), PAIRS)]


class Hasher:
    """crc32 of all runs of one to three words."""

    def __init__(self, head_words: list[bytes], head_pairs: list[tuple[bytes, bytes]]):
        self.shift = Shifts()
        self.number = {w: i for i, w in enumerate(head_words)}
        self.own, self.after, self.size = self._states(head_words)
        # one slot for each pair's code; of two pairs the more frequent stays
        known = [(self.number[a], self.number[b], zlib.crc32(a + b" " + b)) for a, b in reversed(head_pairs) if a in self.number and b in self.number]
        code = np.array([(a << 16) | b for a, b, _ in known], np.int64)
        self.pair = np.full(SLOTS, -1, np.int64)
        self.state = np.zeros(SLOTS, np.uint32)
        self.pair[self._slot(code)] = code
        self.state[self._slot(code)] = np.array([c for *_, c in known], np.uint32)

    @staticmethod
    def _states(some: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """crc of each word, crc of a blank and the word, and bytes of both."""
        return np.array([zlib.crc32(w) for w in some], np.uint32), np.array([zlib.crc32(b" " + w) for w in some], np.uint32), np.array([len(w) + 1 for w in some], np.int64)

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def __call__(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For runs of one, two and three words: the text's number and the crc of each."""
        doc, number, different = words(texts)
        known = np.array([self.number.get(w, -1) for w in different], np.int64)
        own, after, size = np.zeros(len(different), np.uint32), np.zeros(len(different), np.uint32), np.zeros(len(different), np.int64)
        seen = known >= 0
        own[seen], after[seen], size[seen] = self.own[known[seen]], self.after[known[seen]], self.size[known[seen]]
        tail = np.flatnonzero(~seen)
        own[tail], after[tail], size[tail] = self._states([different[i] for i in tail.tolist()])
        one, add, far = own[number], after[number], size[number]
        # pairs: the frequent ones are looked up, the others continue the first word's state
        two = np.flatnonzero(doc[1:] == doc[:-1])
        word = known[number]
        code = np.where((word[two] >= 0) & (word[two + 1] >= 0), (word[two] << 16) | word[two + 1], -2)
        slot = self._slot(code)
        pair = self.state[slot]
        rest = np.flatnonzero(self.pair[slot] != code)
        pair[rest] = self.shift(one[two[rest]], far[two[rest] + 1]) ^ add[two[rest] + 1]
        # triples continue the state of a pair whose second word has a follower
        follows = np.flatnonzero(two[1:] == two[:-1] + 1) if len(two) else np.zeros(0, np.int64)
        three = two[follows]
        triple = self.shift(pair[follows], far[three + 2]) ^ add[three + 2]
        return [(doc, one), (doc[two], pair), (doc[three], triple)]


def totals(texts: DataFrame, hasher_of) -> np.ndarray:
    """Features of all texts in each bucket."""

    def count(batches):
        hasher, total = hasher_of(), np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                for _, crc in hasher(batch.column("text")):
                    total += np.bincount(crc % BUCKETS, minlength=BUCKETS)
        yield vector_rows({"totals": total})

    return summed(texts.mapInArrow(count, VECTOR_SCHEMA), BUCKETS).get("totals", np.zeros(BUCKETS, np.int64))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousands of the log ratio of each bucket's smoothed shares, rounded down."""
    s, t = [[int(x) for x in v] for v in (corpus, target)]
    ratio = [((b + 1) * (sum(s) + BUCKETS)) / ((a + 1) * (sum(t) + BUCKETS)) for a, b in zip(s, t, strict=True)]
    return np.floor(1000 * np.log(np.array(ratio))).astype(np.int64)


def weighed(rows: DataFrame, hasher_of, gain: np.ndarray) -> DataFrame:
    """Columns id, n_features, n_words, weight for rows (id, text)."""

    def run(batches):
        hasher = hasher_of()
        for whole in batches:
            for batch in slices(whole, "text"):
                runs = hasher(batch.column("text"))
                count = [np.bincount(doc, minlength=batch.num_rows) for doc, _ in runs]
                weight = sum(np.bincount(doc, weights=gain[crc % BUCKETS], minlength=batch.num_rows) for doc, crc in runs)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sum(count).astype(np.int64)), pa.array(count[0].astype(np.int64)), pa.array(weight.astype(np.int64))], names=["id", "n_features", "n_words", "weight"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_features long, n_words long, weight long")


def resample(df: DataFrame, target: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, n_features, weight, score and rank: 1, 2, 3 in order of drawing, null if not drawn.

    Of the rows with LEAST_WORDS words or more, `percent` percent are drawn.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts, aims = rows.select("text").where("text is not null"), target.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    frequent = head(texts)
    hasher_of = lambda: Hasher(*frequent)
    gain = gains(totals(texts, hasher_of), totals(aims, hasher_of))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296)))
    scored = stored(weighed(rows, hasher_of, gain).withColumn("score", score), "scored")
    able = scored.where(F.col("n_words") >= LEAST_WORDS).withColumn("one", F.lit(0))
    placed = positions(able, "one", [F.desc("score"), F.col("id"), F.col("weight"), F.col("n_features")], "drawn")
    drawn = F.when(F.col("pos") < F.expr(f"total * {percent} div 100"), F.col("pos") + 1)
    others = scored.where(F.col("n_words") < LEAST_WORDS)
    out = placed.select("id", "n_features", "weight", "score", drawn.alias("rank")).union(others.select("id", "n_features", "weight", "score", F.lit(None).cast("long")))
    return out.withColumnRenamed("id", id_col)
