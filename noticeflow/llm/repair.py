"""Token ids in files, compressed by a grammar of pairs.

Documents in ascending order of their ids are encoded and gathered into blocks of
about BLOCK ids. In each block pairs of neighbouring symbols that occur LEAST times or
more are replaced by new symbols, the most frequent of overlapping pairs first, round
after round until no such pair is left, never across documents. A rule takes about as
many bytes as five places save, so rarer pairs stay. The block keeps the rules, the
length each expands to, the symbols, and where each document begins. A document, or a
stretch of it, is decoded from its own symbols alone: expansion lengths lead by binary
search to the symbols that cover the stretch.

Layout, little-endian: magic, then unsigned 32-bit version, bits of a symbol, first
rule's symbol, numbers of documents, rules and symbols; document ids (64-bit); first
symbol of each document and the end (64-bit); left and right side of each rule
(symbols); length of each rule's expansion (32-bit); symbols. A run of symbols is
their low 16 bits, then for each further bit a plane of one bit per symbol.

Null and empty texts hold the closing id alone; equal ids stand in the order of
their texts; rows without an id are not written; other columns are not read; an empty
table gives no blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, work_path
from .pieces import WordPieces, encoder, gather

MAGIC, HEAD = b"NFGRAM\0\0", "<6I"
#: Ids of a block about; occurrences from which a pair is frequent; ids that `read` decodes by random access.
BLOCK, LEAST, TAIL = 1 << 20, 10, 64


def _every_other(place: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of sorted places at which a symbol repeats, those that a scan from the left of each run replaces."""
    new = np.ones(len(place), bool)
    new[1:] = following[place[:-1]] != place[1:]
    begin = np.flatnonzero(new)
    nth = np.arange(len(place)) - np.repeat(begin, np.diff(np.append(begin, len(place))))
    return nth % 2 == 0


def _grouped(key: np.ndarray, place: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and their places."""
    shift = np.uint64(most.bit_length())
    if int(key.max(initial=0)).bit_length() + int(shift) <= 64:
        both = np.sort((key << shift) | place.astype(np.uint64))
        return both >> shift, (both & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    order = np.argsort(key, kind="stable")
    return key[order], place[order]


def compress(ids: np.ndarray, at: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs of symbols), the symbols left, and where each document's begin."""
    n = len(ids)
    at = at.astype(np.int64)
    symbols = np.append(ids, 0).astype(np.uint32)
    # neighbours of each place; n stands for none
    kind = np.int32 if n < (1 << 31) - 2 else np.int64
    following, before = np.arange(1, n + 2, dtype=kind), np.arange(-1, n, dtype=kind)
    ends, begins = at[1:][at[1:] > at[:-1]] - 1, at[:-1][at[1:] > at[:-1]]
    following[ends], before[begins] = n, n
    alive, weight, mark = np.ones(n + 1, bool), np.zeros(n + 1, np.int32), np.zeros(n + 1, bool)
    alive[n] = False
    rules = [np.zeros((0, 2), np.uint32)]
    made, look = 0, np.flatnonzero(following[:n] < n).astype(kind)
    while len(look):
        bits = np.uint64(int(first + made).bit_length())
        a, b = symbols[look], symbols[following[look]]
        whole, same = (a.astype(np.uint64) << bits) | b, np.flatnonzero(a == b)
        if len(same):
            odd = same[~_every_other(look[same], following)]
            single = np.ones(len(look), bool)
            single[odd] = False
            key, place = _grouped(whole[single], look[single], n)
        else:
            key, place = _grouped(whole, look, n)
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(begin, len(key)))
        often = np.flatnonzero(count >= LEAST)
        if len(often) == 0:
            break
        # of overlapping pairs the most frequent wins, so the most frequent of all wins everywhere
        often = often[np.argsort(count[often], kind="stable")]
        rank = np.zeros(len(count), np.int32)
        rank[often] = np.arange(1, len(often) + 1)
        weight[place] = np.repeat(rank, count)
        own = weight[look]
        win = (own > weight[before[look]]) & (own > weight[following[look]])
        weight[look] = 0
        times = np.bincount(own[win], minlength=len(often) + 1)
        good = times >= LEAST
        good[0] = False
        win &= good[own]
        number = np.cumsum(good) - 1
        chosen = key[begin[often[good[1:]]]]
        new = look[win]
        gone = following[new]
        symbols[new] = (first + made + number[own[win]]).astype(np.uint32)
        after = following[gone]
        following[new] = after
        before[after] = new
        alive[gone] = False
        rules.append(np.stack([chosen >> bits, chosen & ((np.uint64(1) << bits) - np.uint64(1))], axis=1).astype(np.uint32))
        made += len(chosen)
        # a pair that is frequent after this was so before, or holds a new symbol
        keep = look[own > 0]
        mark[keep] = mark[new] = mark[before[new]] = True
        if len(same):
            mark[look[same]] = True
        seen = np.flatnonzero(mark)
        mark[seen] = False
        look = seen[alive[seen]].astype(kind)
        look = look[following[look] < n]
    kept = alive[:n]
    return np.concatenate(rules), symbols[:n][kept], np.concatenate([[0], np.cumsum(kept)])[at]


def _planes(values: np.ndarray, bits: int) -> bytes:
    return values.astype("<u2").tobytes() + b"".join(np.packbits((values >> np.uint32(k)).astype(np.uint8) & 1).tobytes() for k in range(16, bits))


def block(doc_ids: np.ndarray, ids: np.ndarray, at: np.ndarray, first: int) -> bytes:
    """The file image of documents and their ids; rules get symbols from `first` on."""
    rules, symbols, starts = compress(ids, at, first)
    bits = max(16, (first + len(rules)).bit_length())
    lengths = np.ones(first + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        lengths[first + k] = lengths[a] + lengths[b]
    head = MAGIC + struct.pack(HEAD, 2, bits, first, len(doc_ids), len(rules), len(symbols))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), starts.astype("<i8").tobytes(), _planes(rules[:, 0], bits), _planes(rules[:, 1], bits), lengths[first:].astype("<u4").tobytes(), _planes(symbols, bits)])


class Block:
    """A block's file image, read."""

    def __init__(self, body: bytes):
        if body[:8] != MAGIC:
            raise ValueError("not a block of token ids")
        _, bits, self.first, docs, rules, symbols = struct.unpack_from(HEAD, body, 8)
        at = 8 + struct.calcsize(HEAD)

        def part(kind, n):
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes
            return out

        def run(n):
            out = part("<u2", n).astype(np.uint32)
            for k in range(16, bits):
                out |= np.unpackbits(part(np.uint8, -(-n // 8)), count=n).astype(np.uint32) << np.uint32(k)
            return out

        self.doc_ids, self.starts = part("<i8", docs), part("<i8", docs + 1)
        self.left, self.right = run(rules), run(rules)
        self.lengths, self.symbols = part("<u4", rules).astype(np.int64), run(symbols)
        self._flat = None

    def expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What every symbol stands for: ids, where each symbol's begin, and their number."""
        if self._flat is None:
            spelled = []
            for a, b in zip(self.left.tolist(), self.right.tolist(), strict=True):
                spelled.append((spelled[a - self.first] if a >= self.first else struct.pack("<I", a)) + (spelled[b - self.first] if b >= self.first else struct.pack("<I", b)))
            lens = np.concatenate([np.ones(self.first, np.int64), self.lengths])
            flat = np.concatenate([np.arange(self.first, dtype="<u4"), np.frombuffer(b"".join(spelled), "<u4")])
            self._flat = flat, np.cumsum(lens) - lens, lens
        return self._flat

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, and where each document's begin."""
        flat, starts, lens = self.expansions()
        size = lens[self.symbols]
        return gather(flat, starts[self.symbols], size), np.concatenate([[0], np.cumsum(size)])[self.starts]

    def ranges(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids begin[i]..end[i] of the block for each i, one after another, and where each begins; only the symbols that cover them are expanded."""
        flat, starts, lens = self.expansions()
        ends = np.cumsum(lens[self.symbols])
        some = end > begin
        a = np.searchsorted(ends, begin, side="right")
        b = np.where(some, np.searchsorted(ends, end) + 1, a)
        which = gather(self.symbols, a, b - a)
        size = lens[which]
        ids = gather(flat, starts[which], size)
        # where each range's symbols begin among all expanded, and what of the first one lies before the range
        piece = np.concatenate([[0], np.cumsum(size)])[np.cumsum(b - a) - (b - a)]
        before = np.where(some, begin - (ends - lens[self.symbols])[np.minimum(a, max(len(ends) - 1, 0))], 0) if len(ends) else np.zeros(len(begin), np.int64)
        length = np.maximum(end - begin, 0)
        return gather(ids, piece + before, length), np.concatenate([[0], np.cumsum(length)])

    def range(self, doc: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids begin..end of the doc-th document."""
        at = self.bounds()
        low, high = int(at[doc]), int(at[doc + 1])
        end = high if end is None else min(low + end, high)
        return self.ranges(np.array([low + begin]), np.array([max(end, low + begin)]))[0]

    def bounds(self) -> np.ndarray:
        """Where each document's ids begin, and the end."""
        lens = self.expansions()[2]
        return np.concatenate([[0], np.cumsum(lens[self.symbols])])[self.starts]


def write(df: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes blocks (part, block, n_tokens, body) in ascending order of document ids; (part, block) sorts them."""

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(WordPieces, tokenizer)
        first = max(encode.tokenizer.get_vocab_size(), (end_id or 0) + 1)
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            nonlocal number, held, size
            ids = np.concatenate([h[1] for h in held])
            lens = np.concatenate([np.diff(h[2]) for h in held])
            body = block(np.concatenate([h[0] for h in held]), ids, np.concatenate([[0], np.cumsum(lens)]), first)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([body], pa.binary())], names=["part", "block", "n_tokens", "body"])
            number, held, size = number + 1, [], 0
            return row

        for whole in batches:
            for batch in slices(whole, "text", 3 << 20):
                ids, at = encode(batch.column("text"))
                if end_id is not None:
                    ids, at = np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))
                held.append((batch.column("id").to_numpy(), ids, at))
                size += len(ids)
                if size >= BLOCK:
                    yield close()
        if held:
            yield close()

    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(F.col("id"), F.xxhash64("text")).sortWithinPartitions("id", "text")
    ordered.mapInArrow(run, "part int, block int, n_tokens long, body binary").write.option("compression", "uncompressed").parquet(path)


def read(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """Returns id_col, start, n_tokens, ids_crc32 and tail_crc32 of each document, from the blocks.

    The last checksum is that of the document's last TAIL ids, which are decoded by themselves.
    """
    blocks = spark.read.schema("part int, block int, n_tokens long, body binary").parquet(path)

    def run(batches):
        for batch in batches:
            for part, number, body in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "body")), strict=True):
                one = Block(body)
                ids, at = one.all()
                view, bounds = memoryview(np.ascontiguousarray(ids, dtype="<u4")), at.tolist()
                crc = [zlib.crc32(view[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                n, size = len(crc), np.diff(at)
                last, cut = one.ranges(np.maximum(at[1:] - TAIL, at[:-1]), at[1:])
                ends, cut = memoryview(np.ascontiguousarray(last, dtype="<u4")), cut.tolist()
                tail = [zlib.crc32(ends[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(one.doc_ids), pa.array(at[:-1]), pa.array(size), pa.array(crc, pa.int64()), pa.array(tail, pa.int64())], names=["part", "block", "id", "within", "n_tokens", "ids_crc32", "tail_crc32"])

    docs = blocks.select("part", "block", "body").mapInArrow(run, "part int, block int, id long, within long, n_tokens long, ids_crc32 long, tail_crc32 long")
    # ids before each part, then before each block of it: one row per part in the first window
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    inner = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "block", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("block_start")).join(parts, "part")
    starts = starts.select("part", "block", (F.col("part_start") + F.col("block_start")).alias("before"))
    out = docs.join(starts, ["part", "block"])
    return out.select(F.col("id").alias(id_col), (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "tail_crc32")


def stored_ids(df: DataFrame, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts to a work folder and reads them back. Rows without an id are not written."""
    path = work_path(df.sparkSession, "token-ids")
    write(df, path, tokenizer, end_id, id_col, text_col)
    return read(df.sparkSession, path, id_col)
