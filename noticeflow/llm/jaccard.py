"""Similarity join of documents on word runs, by parity sketches.

A text is the set of its runs of WORDS words, as 64-bit hashes. Texts of equal sets are
one set. A set of n runs is sketched for a size band: each run flips one bit of PARTS x
bits, so two sketches differ in at most as many bits as the sets have runs that only one
of them holds, and a pair with J >= t has at most k = (1 - t) / (1 + t) x (a + b) of
those. Of a band's parts, more than k, all but k at least are equal then. Each sketch
gives the k + 1 parts of the most bits as keys (equal parts rank equally in both, so two
such sketches share one of these), and sets of a common key are candidates. A band
holds sizes from one bound up to half as much again; a set that may meet larger ones of
the next band is sketched for that too.

Candidates pass where the sketches, folded to eight bits a part, differ in at most k bits,
and link where the sets themselves are similar enough. Within a key's bucket every
set meets the smallest. Where a bucket then still holds several components, the sets
outside its largest one meet all others in blocks; in large buckets first by a part of the
pairs, so that few components are left for the rest. Only sketches go to blocks, and
only candidates leave them.

Null texts and texts without words are empty sets, which link with nothing; fewer
words than WORDS are one run; repeated rows and equal texts share a component; a null id
stands alone; where an id has several texts, each of its rows belongs to its own text; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import marked, marks, slices, text_bytes
from .common import stored as written
from .components import components

WORDS, PERCENT = 4, 85
#: Bits of a part, at most; sizes of the first band; sets in one block; shares of a bucket's rows.
PART_BITS, FIRST, MEMBERS, SALTS = 1 << 16, 6, 256, 16
#: Parts of 1024 of the pairs that are compared first, in buckets of several blocks.
SOME = 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2, _PRIME = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x100000001B3)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A work table that joins sort and merge: a small file may hold many rows, and a broadcast brings them to the driver whole."""
    return written(df, name).hint("merge")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different runs of each text, and where each text's begin."""
    data, at = text_bytes(texts)
    data = _LOWER[data]
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = at[:-1][at[:-1] < at[1:]]
    first[inner] = word[inner]
    begin = np.flatnonzero(first)
    if len(begin) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    # a word's hash is a polynomial in its bytes
    data, word = data[begin[0] :], word[begin[0] :]
    start = begin - begin[0]
    place = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    power = np.cumprod(np.full(int(place.max()) + 1, _PRIME, np.uint64), dtype=np.uint64)
    value = (data.astype(np.uint64) + np.uint64(1)) * power[place]
    value[~word] = 0
    h = _mix(np.add.reduceat(value, start))
    doc = np.searchsorted(at, begin, side="right") - 1
    count = np.bincount(doc, minlength=len(texts))
    runs = np.where(count == 0, 0, np.maximum(count - words + 1, 1))
    of = np.repeat(np.arange(len(texts)), runs)
    head = np.repeat(np.cumsum(count) - count, runs) + np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
    left = np.repeat(np.cumsum(count), runs) - head
    h = np.append(h, np.zeros(words, np.uint64))
    total = np.zeros(len(head), np.uint64)
    for k in range(words):
        total = _mix(total + np.where(left > k, h[head + k], np.uint64(0)) * np.uint64(2 * k + 1) + np.uint64(k + 1))
    order = np.argsort(total)
    order = order[np.argsort(of[order].astype(np.uint16 if len(texts) < 1 << 16 else np.int64), kind="stable")]
    total, of = total[order], of[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (of[1:] != of[:-1])
    return total[new], np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=len(texts)))])


class Bands:
    """Size bands: their bounds, and of each the differing runs of a similar pair at most, the parts and their bits."""

    def __init__(self, percent: int = PERCENT, first: int = FIRST):
        self.percent = percent
        bound = [first]
        while bound[-1] < 1 << 40:
            bound.append(max(bound[-1] + 1, bound[-1] * 3 // 2, self.largest(bound[-1])))
        self.bound = np.array(bound, np.int64)
        self.most = self.differing(2 * self.bound)
        self.parts = self.most + 1 + np.where(self.most > 0, np.maximum(1, (self.most + 1) // 4), 0)
        self.bits = np.maximum(1, np.minimum(PART_BITS, (1 << 32) // np.maximum(self.parts, 1) - 1))

    def largest(self, n):
        """The largest set that may be similar to one of n runs."""
        return 100 * n // self.percent

    def differing(self, both):
        """Runs that only one of two similar sets may hold, by the sum of their sizes."""
        return (100 - self.percent) * both // (100 + self.percent)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bound, n)

    def next_too(self, n: np.ndarray) -> np.ndarray:
        """Whether sets of n runs may meet sets of the next band."""
        return self.largest(n) > self.bound[self.of(n)]


def sketches(runs: np.ndarray, at: np.ndarray, band: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each set (not empty) in its given band and where they begin; sketches of eight bits a part, and where they begin."""
    n = np.diff(at)
    parts, bits, most = bands.parts[band], bands.bits[band], bands.most[band]
    of = np.repeat(np.arange(len(n)), n)
    # bits ascend with the sorted runs, so that those of a part, and runs of one bit, stand together
    bit = ((runs >> np.uint64(32)) * (parts * bits).astype(np.uint64)[of]) >> np.uint64(32)
    head = np.ones(len(bit), bool)
    head[1:] = (bit[1:] != bit[:-1]) | (of[1:] != of[:-1])
    where = np.flatnonzero(head)
    odd = where[np.diff(np.append(where, len(bit))) % 2 == 1]
    bit, of = bit[odd].astype(np.int64), of[odd]
    base = np.concatenate([[0], np.cumsum(parts)])
    cell = base[of] + bit // bits[of]
    code, folded, count = np.zeros(base[-1], np.uint64), np.zeros(base[-1], np.uint8), np.bincount(cell, minlength=base[-1])
    if len(cell):
        edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        code[cell[edge]] = np.bitwise_xor.reduceat(_mix(bit.astype(np.uint64) + np.uint64(1)), edge)
        folded[cell[edge]] = np.bitwise_xor.reduceat(np.left_shift(np.uint8(1), (bit & 7).astype(np.uint8)), edge)
    owner = np.repeat(np.arange(len(n)), parts)
    part = np.arange(base[-1]) - base[owner]
    # of 48 bits, as random bytes are what the join of keys moves
    key = _mix(code ^ _mix((band[owner].astype(np.uint64) << np.uint64(40)) + part.astype(np.uint64) + np.uint64(1))) >> np.uint64(16)
    # parts of the most bits first; what ranks them is the same in two equal parts
    rank = ((np.uint64(65535) - np.minimum(count, 65535).astype(np.uint64)) << np.uint64(48)) | key
    order = np.argsort(rank)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(n) < 1 << 16 else np.int64), kind="stable")]
    keep = order[part < (most + 1)[owner]]  # places within the owner, as part counts them
    return key[keep], np.concatenate([[0], np.cumsum(most + 1)]), folded, base


def _digests(runs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that name each set."""
    out = np.zeros((2, len(at) - 1), np.uint64)
    full = np.flatnonzero(np.diff(at))
    for k in range(2 if len(full) else 0):
        out[k, full] = np.add.reduceat(_mix(runs + np.uint64(k * 2 + 1) * _PRIME), at[full])
    return out[0].view(np.int64), out[1].view(np.int64)


def _binary(data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    bounds = bounds.tolist()
    return [data[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


def _sketch_rows(percent: int, words: int):
    bands = Bands(percent)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                runs, at = sets(batch.column("text"), words)
                n = np.diff(at)
                k1, k2 = _digests(runs, at)
                keys, own, higher = [b""] * len(n), [b""] * len(n), [None] * len(n)
                for more in (0, 1):
                    which = np.flatnonzero((n > 0) & (bands.next_too(n) if more else True))
                    if len(which) == 0:
                        continue
                    mask = np.zeros(len(n), bool)
                    mask[which] = True
                    some = runs if len(which) == len(n) else runs[np.repeat(mask, n)]
                    got, key_at, folded, base = sketches(some, np.concatenate([[0], np.cumsum(n[which])]), bands.of(n[which]) + more, bands)
                    for i, a, b in zip(which.tolist(), _binary(got, key_at), _binary(folded, base), strict=True):
                        keys[i] += a
                        if more:
                            higher[i] = b
                        else:
                            own[i] = b
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(n), pa.array(k1), pa.array(k2), pa.array(keys, pa.binary()), pa.array(own, pa.binary()), pa.array(higher, pa.binary())], names=["id", "n", "k1", "k2", "keys", "own", "higher"]
                )

    return run


def _key_rows(wanted: np.ndarray | None = None):
    """A row for each key, or each that is marked; a set that a task has just given isn't given again."""

    def run(batches):
        seen: set[tuple] = set()
        for batch in batches:
            name = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True))
            new = []
            for i, k in enumerate(name):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            if len(seen) > 1 << 18:
                seen.clear()
            body = batch.column("keys").take(pa.array(new, pa.int64()))
            size = pc.binary_length(body).to_numpy(zero_copy_only=False).astype(np.int64) // 8
            row = np.repeat(batch.column("nth").to_numpy()[new], size)
            key = np.frombuffer(b"".join(body.to_pylist()), "<i8")
            if wanted is not None:
                keep = marked(wanted, key)
                key, row = key[keep], row[keep]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(row)], names=["key", "nth"])

    return run


def _in_buckets(rows: DataFrame) -> DataFrame:
    """(key, nth) of the keys that several rows give. Those of up to three rows are told by aggregates; of the others only marked rows are sent again."""
    rows = rows.select("nth", "k1", "k2", "keys")
    schema = "key long, nth long"
    counts = rows.mapInArrow(_key_rows(), schema).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("lo"), F.max("nth").alias("hi"), F.bit_xor("nth").alias("x"))
    counts = stored(counts.where("lo < hi"), "common")
    third = F.col("x").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))
    few = counts.where("n <= 3").select("key", F.explode(F.when(F.col("n") == 2, F.array("lo", "hi")).otherwise(F.array("lo", "hi", third))).alias("nth"))
    many = counts.where("n > 3").select("key")
    again = rows.mapInArrow(_key_rows(marks(many)), schema)
    return few.union(again.join(many, "key"))


def _differ(x: bytes, y: bytes) -> int:
    return int(np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum())


def _candidates(pairs: DataFrame, nodes: DataFrame, bands: Bands) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow that they are similar."""

    def run(batches):
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            fits = np.maximum(na, nb) <= bands.largest(np.minimum(na, nb))
            most, step = bands.differing(na + nb), bands.of(na) - bands.of(nb)
            own, higher = [[batch.column(f"{c}{x}") for x in "ab"] for c in ("own", "higher")]
            keep = []
            for i in np.flatnonzero(fits).tolist():
                # the sketches of the larger one's band
                x, y = (higher[0][i] if step[i] < 0 else own[0][i]).as_py(), (higher[1][i] if step[i] > 0 else own[1][i]).as_py()
                if _differ(x, y) <= most[i]:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in "ab"], names=["a", "b"])

    for x in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("own").alias(f"own{x}"), F.col("higher").alias(f"higher{x}")), x)
    return pairs.mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _links(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            keep = [similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in "ab"], names=["a", "b"])

    for x in "ab":
        pairs = pairs.join(bodies.select(F.col("node").alias(x), F.col("runs").alias(f"x{x}")), x)
    return pairs.mapInArrow(run, "a long, b long")


def _block_pairs(rows: list[tuple], bands: Bands, lo: int, hi: int, share: int):
    """Candidates between components of one block, or of two."""
    node, block, component, leader, n = (np.array(c) for c in list(zip(*rows, strict=True))[3:8])
    own, higher = [r[8] for r in rows], [r[9] for r in rows]
    band = bands.of(n)
    for level in np.unique(band).tolist():
        of = np.flatnonzero(band == level)
        sketch = np.stack([np.frombuffer(own[i], np.uint8) for i in of.tolist()])
        for x in range(len(rows)):
            if band[x] == level:
                mine, later = own[x], of > x
            elif band[x] == level - 1 and higher[x] is not None:
                mine, later = higher[x], np.ones(len(of), bool)
            else:
                continue
            y = of[later & (component[of] != component[x]) & ~leader[of] & ~leader[x] & ((block[of] != block[x]) if lo != hi else True)]
            y = y[np.maximum(n[y], n[x]) <= bands.largest(np.minimum(n[y], n[x]))]
            if share < 1024:
                y = y[(_mix(node[y].astype(np.uint64) ^ _mix(node[x : x + 1].astype(np.uint64))) >> np.uint64(54)).astype(np.int64) < share]
            if len(y) == 0:
                continue
            far = np.bitwise_count(sketch[np.searchsorted(of, y)] ^ np.frombuffer(mine, np.uint8)).sum(axis=1, dtype=np.int64)
            for k in y[far <= bands.differing(n[y] + n[x])].tolist():
                yield min(node[x], node[k]).item(), max(node[x], node[k]).item()


def _several(placed: DataFrame) -> DataFrame:
    """Buckets of several components: key, the largest component, sets in it and outside it."""
    sizes = placed.groupBy("key", "component").count().groupBy("key").agg(F.max(F.struct("count", "component")).alias("m"), F.sum("count").alias("n"), F.count(F.lit(1)).alias("parts"))
    return sizes.where("parts > 1 and n > 2").select("key", F.col("m.component").alias("main"), F.col("m.count").alias("inside"), (F.col("n") - F.col("m.count")).alias("outside"))


def _in_blocks(placed: DataFrame, several: DataFrame, nodes: DataFrame, bands: Bands, share: int) -> DataFrame:
    """Candidates of buckets that hold several components; their rows meet the buckets' sizes in SALTS shares.

    Sets outside a bucket's largest component are dealt into blocks 0 to few - 1, those of the
    largest into blocks few and up. A group is one of the first blocks with itself or any other.
    """
    main = several.select("key", "main", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.ceil(F.col("outside") / MEMBERS).cast("int").alias("few"), F.ceil(F.col("inside") / MEMBERS).cast("int").alias("many"))
    rows = placed.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(SALTS)).cast("int")).join(main, ["key", "salt"])
    rows = rows.withColumn("stray", F.col("component") != F.col("main")).withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("stray"), F.col("few")).otherwise(F.col("many"))).cast("int") + F.when(F.col("stray"), 0).otherwise(F.col("few")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("stray"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1)))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "block", "component", (F.col("node") == F.col("leader")).alias("leads")).join(nodes, "node")
    rows = rows.select("key", "lo", "hi", "node", "block", "component", "leads", "n", "own", "higher").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")

    def run(batches):
        every = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        for (_, lo, hi), group in groupby(every, key=lambda r: r[:3]):
            found = list(_block_pairs(list(group), bands, lo, hi, share))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def linked(df: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, n_shingles and component_id, the smallest id reachable by links.

    Two texts link when 100 x the runs that both hold >= percent x the runs that either holds.
    """
    bands = Bands(percent)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n long, k1 long, k2 long, keys binary, own binary, higher binary"
    rows = stored(texts.mapInArrow(_sketch_rows(percent, words), schema).withColumn("nth", F.monotonically_increasing_id()), "sketches")
    full = rows.where("n > 0 and id is not null")
    # each different set goes by the first of its rows
    heads = stored(full.groupBy("k1", "k2").agg(F.min("nth").alias("node"), F.min("id").alias("least")), "heads")

    named = full.select("nth", "k1", "k2").join(heads, ["k1", "k2"]).select("nth", "node")
    shared = _in_buckets(full).join(named, "nth").select("key", "node").distinct()
    shared = stored(shared, "shared")
    leaders = shared.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "leader")
    shared = stored(shared.join(leaders, "key"), "buckets")

    # what is compared: sketches of the sets in buckets, and the sets themselves from their texts
    members = shared.select("node").distinct()
    nodes = stored(rows.join(members, F.col("nth") == F.col("node"), "left_semi").select(F.col("nth").alias("node"), "id", "k1", "k2", "n", "own", "higher"), "nodes")
    pairs = stored(_candidates(shared.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), nodes, bands), "candidates")

    def bodies_of(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                runs, at = sets(batch.column("text"), words)
                k1, k2 = _digests(runs, at)
                same = (k1 == batch.column("k1").to_numpy()) & (k2 == batch.column("k2").to_numpy())
                body = pa.array(_binary(runs, at), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node"), body], names=["node", "runs"]).filter(pa.array(same))

    def bodies(wanted: DataFrame) -> DataFrame:
        """Sets of the nodes in the pairs. Texts of unmarked ids stay where they are."""
        some = stored(nodes.select("node", "id", "k1", "k2").join(wanted.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"), "wanted")
        bits = marks(some.select(F.xxhash64("id")))

        def marked_texts(batches):
            for batch in batches:
                yield batch.filter(pa.array(marked(bits, batch.column("h").to_numpy()))).select(["id", "text"])

        near = texts.where("id is not null").withColumn("h", F.xxhash64("id")).mapInArrow(marked_texts, texts.schema)
        return near.join(some, "id").select("node", "k1", "k2", "text").mapInArrow(bodies_of, "node long, runs binary").dropDuplicates(["node"])

    compared = nodes.select("node", "n", "own", "higher")
    linked_by = lambda pairs: stored(_links(pairs, stored(bodies(pairs), "sets"), percent), "links")
    found = stored(components(linked_by(pairs)), "components")
    first = True
    while True:
        placed = stored(shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
        several = stored(_several(placed), "several")
        # in large buckets a part of the pairs first
        large = several.where(F.col("outside") > MEMBERS)
        some = first and not large.isEmpty()
        pairs = stored(_in_blocks(placed, large if some else several, compared, bands, SOME if some else 1024), "candidates")
        if not pairs.isEmpty():
            # components are joined by links between them
            of = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
            late = linked_by(pairs).join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
            late = stored(components(late), "components").select(F.col("node").alias("old"), F.col("component").alias("new"))
            whole = found.union(late.join(found.select(F.col("component").alias("old")).distinct(), "old", "left_anti").select("old", "old"))
            renamed = late.select(F.col("old").alias("_old"), "new")
            found = stored(whole.join(renamed, F.col("component") == F.col("_old"), "left").select("node", F.coalesce("new", "component").alias("component")), "components")
        if not some:
            break
        first = False

    named = heads.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("k1", "k2", "least", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least.hint("merge"), "component").select("k1", "k2", "component_id").hint("merge")
    out = full.select("id", "n", "k1", "k2").join(named, ["k1", "k2"]).select("id", "n", "component_id")
    alone = rows.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return out.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
