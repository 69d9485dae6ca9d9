"""Near duplicates by consistent weighted sampling of TF-IDF shingles.

Equal texts are one text. A text is the multiset of its runs of five words
(lower case, split at ASCII marks; fewer words: the one run of all); a shingle
weighs (1 + ln tf) x idf, with the idf FLOOR + (1 - FLOOR) x ln(1 + n / df) / ln(1 + n):
1 for runs of one text, about FLOOR for those of all. n and df count texts up to copies: a
text counts one over the number of texts that share its smallest shingle, in that one of
SKETCHES hashed orders in which most do, so that a group of thousands of near copies
counts about once and doesn't make its own words common. All counts are kept in 2**20
hashed cells less their mean load.
Improved consistent weighted sampling draws BANDS x ROWS samples of each text, equal
with a probability of the weighted Jaccard similarity; texts that share a band are
candidates, and links are candidates whose weighted Jaccard similarity reaches
the least. Within a band's bucket every text is compared with three leaders. After
components of these links are known, a bucket that still holds several is compared
outside its largest component: the others' texts meet those of the largest, and each
other, in blocks of MEMBERS texts. Only links leave a block, so no pair in a bucket
that could join two classes stays uncompared, and a text of the largest component is
sent once for MEMBERS others.

Null texts are alone; empty texts equal each other and texts without words equal
only equal texts; repeated rows share a class; a null id is alone; where an id has
several texts, each of its rows belongs to its own text's class; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import VECTOR_SCHEMA, slices, stored, summed, text_bytes, vector_rows
from .components import components

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 14, 4
CELLS, FLOOR, SKETCHES = 1 << 20, 0.25, 4
#: A text's part in the counts is a whole number of 1 / PARTS.
PARTS = 1 << 12
#: Shingles sampled at a time; texts of a bucket in one block; shares of a bucket's rows.
BLOCK, MEMBERS, SALTS = 1 << 16, 512, 16

_WORD = np.ones(256, bool)
_WORD[[b for b in range(128) if not chr(b).isalnum()]] = False
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different 32-bit shingles of each text, how often each occurs, and where each text's begin."""
    n = len(texts)
    data, at = text_bytes(pc.utf8_lower(texts.fill_null("") if texts.null_count else texts))
    word = _WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = at[:-1][at[:-1] < len(data)]
    first[inner] = word[inner]
    begin = np.flatnonzero(first)
    if len(begin) == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    place = np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data)))) if begin[0] == 0 else np.concatenate([np.zeros(begin[0], np.int64), np.arange(begin[0], len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data))))])
    power = np.cumprod(np.full(int(place.max()) + 1, 0x100000001B3, np.uint64), dtype=np.uint64)
    value = (data.astype(np.uint64) + np.uint64(1)) * power[place]
    value[~word] = 0
    h = _mix(np.add.reduceat(value, begin))
    doc = np.searchsorted(at, begin, side="right") - 1
    count = np.bincount(doc, minlength=n)
    start = np.cumsum(count) - count
    # a run begins at each word that has words - 1 more after it, or at a short text's first
    runs = np.where(count == 0, 0, np.maximum(count - words + 1, 1))
    of = np.repeat(np.arange(n), runs)
    head = np.repeat(start, runs) + np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
    left = np.repeat(start + count, runs) - head
    h = np.append(h, np.zeros(words, np.uint64))
    total = np.zeros(len(head), np.uint64)
    for k in range(words):
        part = h[head + k] if k == 0 else np.where(left > k, h[head + k], np.uint64(0))
        total = _mix(total + part * np.uint64(2 * k + 1) + np.uint64(k + 1))
    key = np.sort((of.astype(np.uint64) << np.uint64(32)) | (total >> np.uint64(32)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    where = np.flatnonzero(new)
    ends = np.concatenate([[0], np.cumsum(np.bincount((key[where] >> np.uint64(32)).astype(np.int64), minlength=n))])
    return key[where].astype(np.uint32), np.diff(np.append(where, len(key))), ends


def sketches(sh: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SKETCHES numbers of each text that has shingles, by its smallest shingle in as many hashed orders."""
    first = at[:-1][np.diff(at) > 0]
    out = np.zeros((len(first), SKETCHES), np.uint64)
    for k in range(SKETCHES if len(first) else 0):
        out[:, k] = _mix(np.minimum.reduceat(_mix(sh.astype(np.uint64) + (np.uint64(k + 1) << np.uint64(40))), first))
    return out


def _shingle_rows(batches):
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            sh, tf, at = shingles(batch.column("text"))
            bounds = at.tolist()
            bodies = [sh[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            more = np.concatenate([[0], np.cumsum(tf > 1)])[at]
            times = [tf[a:b].astype("<u4").tobytes() if d else b"" for a, b, d in zip(bounds, bounds[1:], np.diff(more).tolist(), strict=False)]
            sketch = np.zeros((len(at) - 1, SKETCHES), np.uint64)
            sketch[np.diff(at) > 0] = sketches(sh, at)
            some = pa.FixedSizeListArray.from_arrays(pa.array(sketch.reshape(-1).view(np.int64)), SKETCHES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bodies, pa.binary()), pa.array(times, pa.binary()), some], names=["id", "sh", "tf", "sketch"])


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = pc.binary_length(batch.column("sh")).to_numpy().astype(np.int64) // 4
    sh = np.frombuffer(b"".join(batch.column("sh").to_pylist()), "<u4")
    at = np.concatenate([[0], np.cumsum(sizes)])
    tf = np.ones(len(sh), np.float32)
    for i in np.flatnonzero(pc.binary_length(batch.column("tf")).to_numpy()):
        tf[at[i] : at[i + 1]] = np.frombuffer(batch.column("tf")[int(i)].as_py(), "<u4")
    return sh, tf, at


def _cell(sketch: np.ndarray) -> np.ndarray:
    return (sketch.view(np.uint64) >> np.uint64(44)).astype(np.int64)


def _less_load(cells: np.ndarray) -> np.ndarray:
    """What a cell holds of its own: its count less the mean of the others."""
    return cells - (cells.sum() - cells) / (CELLS - 1)


def _of_batch(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("sketch").flatten().to_numpy().reshape(-1, SKETCHES)


def _count_sketches(batches):
    total = np.zeros((SKETCHES, CELLS), np.int64)
    for batch in batches:
        for k, cell in enumerate(_cell(_of_batch(batch)).T):
            total[k] += np.bincount(cell, minlength=CELLS)
    yield vector_rows({str(k): v for k, v in enumerate(total)})


def parts(sketch: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """How much each text counts: PARTS over the most texts that share one of its sketches, at least 1."""
    shared = np.max([_less_load(n)[cell] for n, cell in zip(alike, _cell(sketch).T, strict=True)], axis=0)
    return np.maximum(PARTS / np.maximum(shared, 1.0), 1.0).round()


def idf(cells: np.ndarray, texts: float) -> np.ndarray:
    """Factor of each cell: 1 for shingles of one text, about FLOOR for those in all texts."""
    df = np.clip(_less_load(cells), 1, max(1.0, texts))
    return (FLOOR + (1 - FLOOR) * (np.log1p(texts / df) / np.log1p(max(1.0, texts))).clip(max=1)).astype(np.float32)


def factors(texts: DataFrame) -> np.ndarray:
    """The idf factor of each cell over all texts (columns sh, tf, sketch)."""
    found = summed(texts.select("sketch").mapInArrow(_count_sketches, VECTOR_SCHEMA), CELLS)
    alike = np.array([found.get(str(k), np.zeros(CELLS, np.int64)) for k in range(SKETCHES)]).astype(np.int32)

    def count(batches):
        total, of_texts = np.zeros(CELLS), 0
        for batch in batches:
            sh, _, at = _unpack(batch)
            part = parts(_of_batch(batch), alike)
            total += np.bincount(sh >> np.uint32(12), weights=np.repeat(part, np.diff(at)), minlength=CELLS)
            of_texts += int(part.sum())
        yield vector_rows({"cells": total, "texts": np.array([of_texts])})

    counts = summed(texts.select("sh", "tf", "sketch").mapInArrow(count, VECTOR_SCHEMA), CELLS)
    return idf(counts.get("cells", np.zeros(CELLS, np.int64)) / PARTS, int(counts.get("texts", np.zeros(1))[0]) / PARTS)


def weights(sh: np.ndarray, tf: np.ndarray, factor: np.ndarray) -> np.ndarray:
    w = factor[sh >> np.uint32(12)]
    return w if (tf == 1).all() else w * (1 + np.log(tf)).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling; its variates come from tables indexed by a hash of shingle and sample."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 5):
        rng = np.random.default_rng(seed)
        r, c = rng.gamma(2, 1, 1 << 16), rng.gamma(2, 1, 1 << 16)
        self.r, self.inverse, self.beta, self.log_c = (np.ascontiguousarray(x, dtype=np.float32) for x in (r, 1 / r, rng.random(1 << 16), np.log(c)))
        self.factors = (rng.integers(0, 1 << 31, samples, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.shifts = rng.integers(0, 1 << 32, samples, dtype=np.uint64).astype(np.uint32)

    def __call__(self, sh: np.ndarray, w: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A 64-bit value of each sample and text; each text has a shingle at least."""
        out = np.empty((len(self.factors), len(first)), np.uint64)
        log_w = np.log(w)
        text = np.repeat(np.arange(len(first)), sizes)
        for k, (factor, shift) in enumerate(zip(self.factors, self.shifts, strict=True)):
            at = (sh * factor + shift) >> np.uint32(16)
            r, beta = self.r[at], self.beta[at]
            t = log_w * self.inverse[at]
            t += beta
            np.floor(t, out=t)
            a = t - beta
            a += np.float32(1)
            a *= r
            np.subtract(self.log_c[at], a, out=a)
            least = np.minimum.reduceat(a, first)
            hit = np.flatnonzero(a == least[text])
            hit = hit[np.searchsorted(hit, first)]
            value = (sh[hit].astype(np.uint64) << np.uint64(32)) | (t[hit].astype(np.int64) & 0xFFFFFFFF).astype(np.uint64)
            out[k] = _mix(value + np.uint64(k))
        return out


def bands(sampler: Sampler, sh: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BANDS keys of each text that has shingles."""
    full = np.flatnonzero(np.diff(at) > 0)
    keys = np.zeros((len(full), BANDS), np.uint64)
    done = 0
    while done < len(full):
        begin = at[full[done]]
        to = max(done + 1, int(np.searchsorted(at[full + 1], begin + BLOCK, side="right")))
        part = full[done:to]
        end = at[part[-1] + 1]
        got = sampler(sh[begin:end], w[begin:end], at[part] - begin, (at[part + 1] - at[part]))
        for b in range(BANDS):
            key = np.full(len(part), b + 1, np.uint64)
            for row in got[b * ROWS : (b + 1) * ROWS]:
                key = _mix(key ^ row)
            keys[done:to, b] = key
        done = to
    return keys


def similarity(a: np.ndarray, ta: np.ndarray, b: np.ndarray, tb: np.ndarray, factor: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts by their shingles and counts."""
    wa, wb = weights(a, ta, factor), weights(b, tb, factor)
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    same = a[at] == b
    both = float(np.minimum(wa[at[same]], wb[same]).sum(dtype=float))
    return both / (float(wa.sum(dtype=float)) + float(wb.sum(dtype=float)) - both)


def _verified(pairs: DataFrame, texts: DataFrame, factor: np.ndarray, least: float) -> DataFrame:
    """Pairs whose similarity reaches the least."""

    def run(batches):
        one = lambda sh, tf: (np.frombuffer(sh, "<u4"), np.frombuffer(tf, "<u4").astype(np.float32) if tf else np.ones(len(sh) // 4, np.float32))
        for whole in batches:
            rows = list(zip(*(whole.column(c).to_pylist() for c in ("sa", "ta", "sb", "tb")), strict=True))
            keep = [similarity(*one(sa, ta), *one(sb, tb), factor) >= least for sa, ta, sb, tb in rows]
            yield pa.RecordBatch.from_arrays([whole.column("a").filter(pa.array(keep, pa.bool_())), whole.column("b").filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("sh").alias("sb"), F.col("tf").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("sh").alias("sa"), F.col("tf").alias("ta")), "a")
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _features(sh: list[bytes], tf: list[bytes], factor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as sets: the k-th occurrence of a shingle is an element of its own, so that common weights add up to the minimum.

    Returns numbers of elements, their weights, and where each text's begin.
    """
    parts, levels = [], []
    for body, times in zip(sh, tf, strict=True):
        s = np.frombuffer(body, "<u4").astype(np.uint64)
        n = np.frombuffer(times, "<u4").astype(np.int64) if times else np.ones(len(s), np.int64)
        level = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
        parts.append((np.repeat(s, n) << np.uint64(32)) | level.astype(np.uint64))
        levels.append(level)
    every, level = np.concatenate(parts), np.concatenate(levels)
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    gain = np.where(level == 1, 1.0, np.log(level) - np.log(np.maximum(level - 1, 1)))
    weight = factor[(every >> np.uint64(44)).astype(np.int64)] * gain
    return np.unique(every, return_inverse=True)[1], weight, at


def _block_links(rows: list[tuple], lo: int, hi: int, factor: np.ndarray, least: float) -> list[tuple]:
    """Linked pairs of one block, or of two, that no leader compared, in the first bucket that both share."""
    if len(rows) < 2:
        return []
    key = rows[0][0]
    ids, block, component, leader, keys, sh, tf = (list(c) for c in list(zip(*rows, strict=True))[3:])
    block, leader, keys = np.array(block), np.array(leader), np.array(keys)
    component = np.unique(np.array(component), return_inverse=True)[1]
    element, weight, at = _features(sh, tf, factor)
    total = np.add.reduceat(weight, at[:-1])
    out = []
    for x in range(len(rows)):
        y = np.arange(x + 1, len(rows))
        y = y[(component[y] != component[x]) & ~leader[y] & ~leader[x] & ((block[y] != block[x]) if lo != hi else True)]
        y = y[np.minimum(total[y], total[x]) >= least * np.maximum(total[y], total[x])]
        if len(y) == 0:
            continue
        same = keys[y] == keys[x]
        y = y[keys[x][same.argmax(1)] == key]
        if len(y) == 0:
            continue
        inside = np.zeros(int(element.max()) + 1, bool)
        inside[element[at[x] : at[x + 1]]] = True
        both = np.add.reduceat(np.where(inside[element], weight, 0.0), at[:-1])[y]
        for k in y[both / (total[x] + total[y] - both) >= least].tolist():
            out.append((min(ids[x], ids[k]), max(ids[x], ids[k])))
    return out


def _in_blocks(rest: DataFrame, texts: DataFrame, factor: np.ndarray, least: float) -> DataFrame:
    """Links among the texts of buckets that hold several components. A bucket's rows meet its sizes in SALTS shares.

    Texts outside the bucket's largest component are dealt into blocks 0 to few - 1 and
    those of the largest into blocks few and up, MEMBERS texts each about. A group is one
    of the first blocks with itself or with any other block.
    """
    sizes = rest.groupBy("key", "component").count()
    main = sizes.groupBy("key").agg(F.max(F.struct("count", "component")).alias("m"), F.sum("count").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    main = main.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("m.component").alias("main"), F.ceil((F.col("n") - F.col("m.count")) / MEMBERS).cast("int").alias("few"), F.ceil(F.col("m.count") / MEMBERS).cast("int").alias("many"))
    rows = rest.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(SALTS)).cast("int")).join(stored(main, "split"), ["key", "salt"]).withColumn("leader", F.col("id").isin(F.col("l0"), F.col("l1"), F.col("l2")))
    rows = rows.withColumn("stray", F.col("component") != F.col("main")).withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("stray"), F.col("few")).otherwise(F.col("many"))).cast("int") + F.when(F.col("stray"), 0).otherwise(F.col("few")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("stray"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1)))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", "block", "component", "leader").join(texts.select("id", "keys", "sh", "tf"), "id")
    rows = rows.select("key", "lo", "hi", "id", "block", "component", "leader", "keys", "sh", "tf").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id")

    def run(batches):
        from itertools import chain, groupby

        every = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        for (key, lo, hi), group in groupby(every, key=lambda r: r[:3]):
            if found := _block_links(list(group), lo, hi, factor, least):
                yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in found])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def classes(df: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col and class_id, the smallest id of the row's class."""
    rows = df.select(F.col(id_col).alias("id"), F.md5(F.col(text_col)).alias("digest"))
    # each different text gets a number, written so that it holds, and the smallest of its ids
    heads = rows.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("head"))
    heads = stored(heads.withColumn("node", F.monotonically_increasing_id()), "heads")
    owned = df.select(F.col(id_col).alias("head"), F.col(text_col).alias("text"), F.md5(F.col(text_col)).alias("digest")).where("text is not null")
    # repeated rows go where the join has dealt them
    firsts = owned.join(heads, ["head", "digest"]).dropDuplicates(["head", "digest"]).select(F.col("node").alias("id"), "text")
    texts = stored(firsts.mapInArrow(_shingle_rows, "id long, sh binary, tf binary, sketch array<long>").where("length(sh) > 0"), "shingles")
    factor = factors(texts)

    def sample(batches):
        sampler = Sampler()
        for batch in batches:
            sh, tf, at = _unpack(batch)
            keys = bands(sampler, sh, weights(sh, tf, factor), at)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1).view(np.int64)), BANDS).cast(pa.list_(pa.int64()))], names=["id", "keys"])

    sampled = stored(texts.select("id", "sh", "tf").mapInArrow(sample, "id long, keys array<long>"), "bands")
    keyed = sampled.select("id", F.explode("keys").alias("key"))
    leaders = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("id").alias("l0"),
        *[F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id")).getField("id").alias(f"l{k}") for k in (1, 2)],
    )
    leaders = stored(leaders.where("n > 1"), "leaders")
    shared = stored(keyed.join(leaders, "key"), "buckets")
    pairs = shared.select("id", F.explode(F.array_distinct(F.array("l0", "l1", "l2"))).alias("leader")).where("id <> leader").select(*_ordered("id", "leader")).distinct()
    pairs = stored(pairs, "pairs")
    links = stored(_verified(pairs, texts, factor, least), "verified")
    found = stored(components(links), "components")

    # what the leaders did not join: every pair of a bucket that is still in two classes, in blocks
    placed = stored(shared.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    late = stored(_in_blocks(placed.where("n > 2"), texts.join(sampled, "id"), factor, least), "verified")
    if not late.isEmpty():
        found = stored(components(links.union(late)), "components")

    # a class is named by the smallest id of its texts
    named = heads.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("digest", "head", F.coalesce("component", "node").alias("component"))
    several = named.groupBy("component").agg(F.min("head").alias("class_id"))
    named = named.join(several, "component").select("digest", "class_id")
    out = rows.join(named, "digest", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"))
