"""Best-fit packing of documents into sequences of a fixed number of tokens.

The lengths are reduced to a histogram, which no input makes larger than
the capacity. The configuration linear program over it (least number of
sequences, each filled by a combination of lengths, every length used up) gets its
columns by multiplicative weights: a length that the proposed configurations use too
much loses weight, one that they neglect gains, and a knapsack dynamic program prices,
for each length, the most valuable sequence that holds it. The weights' dual value
bounds the number of sequences from below. The amounts of the proposed configurations
are then scaled, again multiplicatively, until they exhaust the lengths and overuse
none. Rounding keeps the amounts' sum (a configuration's copies are the whole numbers
that its stretch of the running sum passes); what it leaves is a program of its own,
and so on until a program places nothing more. Best fit takes that rest. Where the
result stays above the bound, it is tried again with other first weights and with
faster ones; should best fit alone need fewer sequences, its result stands.

With at most EXCHANGED different lengths, where sequences can often not be full and
weights alone settle slowly, the amounts are carried on to the program's optimum: of the
configurations found so far, and then of the knapsack's, the one of most value enters a
basis until none is worth more than a sequence. Its whole parts are taken and the rest is
solved again, the largest part first where all are below one.

Rows then find their sequence by their rank among the rows of their length, which
spreads over salted windows.

Null and empty texts are documents of one closing id; tables without rows give
no rows; repeated documents are packed as often as they occur; columns other
than the two named ones are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored
from .pieces import WordPieces, encoder

CAPACITY = 2048
#: Windows over which the rows of one length are ranked: at least so many, one for so many rows.
LEAST_SALTS, SALT_ROWS = 32, 1 << 20
#: Rates of the weights, and whether they begin with the heaviest weights or with the lengths, tried in this order; pricings of one program; steps of the amounts; programs at most.
TRIES, PRICINGS, STEPS, PROGRAMS = ((2e-3, False), (2e-3, True), (0.5, True)), 10, 60, 30
#: What a configuration's value may lack to the best, in programs that place ever less.
SLACKS = (0.0, 1e-3, 0.03, 1.0)
#: A result within this share of the bound, or one sequence, is good.
GAP = 2e-4
#: Different lengths up to which the program is solved to its optimum; parts from which a rest's configurations are taken together.
EXCHANGED, LARGE_PART = 256, 0.6

Configuration = tuple[tuple[int, int], ...]


def price(value: np.ndarray, limit: np.ndarray, capacity: int) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Bounded knapsack: the best value of each room from 0 to capacity, and the (size, count) entries that fill it.

    Sizes come in powers of two, the largest size first, so that of equal fills the one of few large items stands.
    """
    items = []
    for size in np.flatnonzero((value > 0) & (limit > 0))[::-1].tolist():
        left, k = min(int(limit[size]), capacity // size), 1
        while left > 0:
            items.append((size, min(k, left)))
            left, k = left - k, 2 * k
    best, taken = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), bool)
    least = 1e-9 * float(value.max(initial=0.0))
    for j, (size, n) in enumerate(items):
        gain = best[: capacity + 1 - size * n] + value[size] * n
        taken[j, size * n :] = better = gain > best[size * n :] + least
        np.copyto(best[size * n :], gain, where=better)
    room, fills = np.arange(capacity + 1), [[] for _ in range(capacity + 1)]
    for j in range(len(items) - 1, -1, -1):  # all rooms are traced back at once
        at = np.flatnonzero(taken[j, room])
        room[at] -= items[j][0] * items[j][1]
        for r in at.tolist():
            fills[r].append(items[j])
    return best, fills


def _configuration(first: int, fill: list[tuple[int, int]]) -> dict[int, int]:
    counts = {first: 1}
    for size, n in fill:
        counts[size] = counts.get(size, 0) + n
    return counts


def heaviest_weights(demand: np.ndarray, capacity: int) -> np.ndarray:
    """Of a family of weights under which no sequence weighs more than `capacity`, those under which all lengths weigh most.

    Lengths below k weigh next to nothing, those above capacity - k a whole sequence, the others their tokens.
    """
    size = np.arange(capacity + 1)
    below, tokens = np.cumsum(demand * size), np.cumsum(demand)
    k = np.arange(capacity // 2 + 1)
    total = below[capacity - k] - np.where(k > 0, below[np.maximum(k - 1, 0)], 0) + (tokens[capacity] - tokens[capacity - k]) * capacity
    k = int(total.argmax())
    return np.where(size < k, 1e-6 * size, np.where(size > capacity - k, capacity, size))


def columns(demand: np.ndarray, capacity: int, rate: float, slack: float, heaviest: bool = False) -> tuple[dict[Configuration, float], float]:
    """Configurations with the amounts proposed of each, and the best dual bound of the pricings."""
    sizes = np.flatnonzero(demand)
    need = demand[sizes].astype(float)
    per_token = heaviest_weights(demand, capacity)[sizes] / sizes if heaviest else np.ones(len(sizes))
    weight = np.zeros(capacity + 1)
    found: dict[Configuration, float] = {}
    bound = 0.0
    for _ in range(PRICINGS):
        weight[sizes] = sizes * per_token
        best, fills = price(weight, demand, capacity)
        bound = max(bound, float(need @ weight[sizes]) / best[capacity])
        used = np.zeros(capacity + 1)
        for size in sizes[::-1].tolist():
            counts = _configuration(size, fills[capacity - size])
            if any(n > demand[s] for s, n in counts.items()):
                continue
            amount = float(demand[size]) / counts[size]
            value = 0.0
            for s, n in counts.items():
                used[s] += amount * n
                value += weight[s] * n
            if value >= best[capacity] * (1 - slack) - 1e-6:
                key = tuple(sorted(counts.items(), reverse=True))
                found[key] = found.get(key, 0.0) + amount
        much = used[sizes] / need
        per_token *= np.clip(much / max(much.mean(), 1e-9), 1 / 8, 8) ** -rate
        per_token /= per_token.mean()
    return found, bound


def amounts(found: dict[Configuration, float], demand: np.ndarray) -> np.ndarray:
    """Amounts of the configurations that exhaust lengths and overuse none."""
    x = np.array(list(found.values()))
    lens = np.array([len(c) for c in found])
    flat = np.array([entry for c in found for entry in c], np.int64).reshape(-1, 2)
    of, start = np.repeat(np.arange(len(x)), lens), np.cumsum(lens) - lens
    need = np.maximum(demand, 1).astype(float)
    for step in range(STEPS + 1):
        use = np.bincount(flat[:, 0], weights=x[of] * flat[:, 1], minlength=len(demand)) / need
        most = np.maximum.reduceat(use[flat[:, 0]], start)
        x = x * most**-0.7 if step < STEPS else x / np.maximum(1.0, most)
    return x


def rounded(found: dict[Configuration, float], x: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[Configuration, int]]:
    """Whole copies that keep the sum of the amounts, as far as lengths are left; takes them off `left`."""
    known, out = list(found), []
    order = np.lexsort((-x, [capacity - sum(s * n for s, n in c) for c in known])).tolist()
    total = np.floor(np.cumsum(x[order]) + 0.5).astype(np.int64)
    once = np.diff(total, prepend=0)
    # then, where chance passed a configuration over, what lengths still allow of it
    for wanted in (once, np.ceil(x[order]).astype(np.int64)):
        for j, n in zip(order, wanted.tolist(), strict=True):
            n = min([n, *(int(left[s]) // k for s, k in known[j])]) if n else 0
            if n > 0:
                out.append((known[j], n))
                for s, k in known[j]:
                    left[s] -= k * n
    return out


def program(demand: np.ndarray, capacity: int, rate: float, heaviest: bool = False) -> tuple[list[tuple[Configuration, int]], np.ndarray, float]:
    """Sequences by programs over what the one before left, the rest that none places, and the first program's bound."""
    left, groups, bound, k = demand.astype(np.int64).copy(), [], 0.0, 0
    tokens = np.arange(capacity + 1)
    for n in range(PROGRAMS):
        if not left.any():
            break
        found, dual = columns(left, capacity, rate, SLACKS[k], heaviest)
        bound = dual if n == 0 else bound
        placed = rounded(found, amounts(found, left), left, capacity) if found else []
        groups += placed
        # a program that places little of what there is may take configurations of less value next
        if sum(c for _, c in placed) < 0.1 * (left @ tokens) / capacity or not placed:
            k += 1
            if k == len(SLACKS):
                break
    return groups, left, bound


def best_sequence(value: np.ndarray, limit: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Bounded knapsack as in `price`, of the whole room only: its value, and how often each length is in it."""
    items = [(s, n) for s in np.flatnonzero((value > 0) & (limit > 0))[::-1].tolist() for n in _powers(min(int(limit[s]), capacity // s))]
    best, taken = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), bool)
    for j, (size, n) in enumerate(items):
        gain = best[: capacity + 1 - size * n] + value[size] * n
        taken[j, size * n :] = better = gain > best[size * n :] + 1e-12
        np.copyto(best[size * n :], gain, where=better)
    room, counts = capacity, {}
    for j in range(len(items) - 1, -1, -1):
        if taken[j, room]:
            size, n = items[j]
            room -= size * n
            counts[size] = counts.get(size, 0) + n
    return float(best[capacity]), counts


def _powers(n: int) -> list[int]:
    """Powers of two, and a rest, whose sums are all numbers up to n."""
    out, k = [], 1
    while n > 0:
        out.append(min(k, n))
        n, k = n - k, 2 * k
    return out


def optimum(demand: np.ndarray, capacity: int, found: list[Configuration]) -> tuple[list[Configuration], np.ndarray, float]:
    """A basis of configurations, their amounts that use up the demand, and the program's bound; found configurations are tried first."""
    sizes = np.flatnonzero(demand)
    need, at = demand[sizes].astype(float), np.full(capacity + 1, -1)
    at[sizes] = np.arange(len(sizes))

    def column(config: Configuration) -> np.ndarray:
        out = np.zeros(len(sizes))
        for s, n in config:
            out[at[s]] += n
        return out

    basis: list[Configuration] = [((s, min(int(demand[s]), capacity // s)),) for s in sizes.tolist()]
    inverse = np.diag([1.0 / c[0][1] for c in basis])
    x, bound, value = inverse @ need, 0.0, np.zeros(capacity + 1)
    known = np.array([column(c) for c in found]).reshape(-1, len(sizes))
    for _ in range(30 * len(sizes) + 200):  # ends before, but for rounding errors
        dual = inverse.sum(axis=0)
        worth = known @ dual
        if len(found) and worth.max() > 1 + 1e-7:
            config, enters = found[int(worth.argmax())], known[int(worth.argmax())]
        else:
            value[sizes] = np.maximum(dual, 0)
            best, counts = best_sequence(value, demand, capacity)
            bound = max(bound, float(need @ value[sizes]) / best)
            if best <= 1 + 1e-7:
                break
            config = tuple(sorted(counts.items(), reverse=True))
            enters = column(config)
        step = inverse @ enters
        leaves = int(np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf).argmin())
        row = inverse[leaves] / step[leaves]
        inverse -= np.outer(step, row)
        inverse[leaves], basis[leaves] = row, config
        x = np.maximum(inverse @ need, 0)
    return basis, x, bound


def solved(demand: np.ndarray, capacity: int) -> tuple[list[tuple[Configuration, int]], float, int]:
    """As `plan`, by optima of the program over what is left."""
    count = lambda groups: sum(c for _, c in groups)
    left, groups, bound, found = demand.astype(np.int64).copy(), [], None, list(columns(demand, capacity, TRIES[0][0], SLACKS[2])[0])
    best, made = None, 0

    def take(config: Configuration, n: int) -> int:
        n = min([n, *(int(left[s]) // k for s, k in config)])
        if n > 0:
            groups.append((config, n))
            for s, k in config:
                left[s] -= k * n
        return max(n, 0)

    while left.any():
        basis, x, dual = optimum(left, capacity, found)
        bound, found = dual if bound is None else bound, []
        whole = np.floor(x + 1e-6).astype(np.int64)
        placed = sum(take(basis[j], int(whole[j])) for j in np.flatnonzero(whole).tolist())
        part = x - whole
        for j in np.argsort(-part).tolist():
            if part[j] < LARGE_PART and placed:
                break
            placed += take(basis[j], 1)
        rest = best_fit(left.copy(), capacity)
        if best is None or count(groups) + count(rest) < count(best):
            best, made = groups + rest, count(groups)
        if count(best) <= np.ceil(bound - 1e-6) or not placed:
            break
    return best, bound or 0.0, made


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Whole sequences for the items of a histogram: longest first, each into the fullest open sequence that takes it."""
    room: dict[int, list[list]] = {}  # free units: [pattern, copies]
    open_at = np.zeros(capacity + 1, bool)
    done = []

    def put(free, pattern, copies):
        if copies <= 0:
            return
        if free == 0:
            done.append((pattern, copies))
            return
        room.setdefault(free, []).append([pattern, copies])
        open_at[free] = True

    for size in np.flatnonzero(left)[::-1].tolist():
        n = int(left[size])
        while n:
            fits = np.flatnonzero(open_at[size:])
            if len(fits):
                free = size + int(fits[0])
                pattern, copies = room[free].pop()
                take = min(copies, n)
                if copies > take:
                    room[free].append([pattern, copies - take])
                if not room[free]:
                    open_at[free] = False
                put(free - size, (*pattern, (size, 1)), take)
                n -= take
            else:
                each = capacity // size
                if n >= each:
                    put(capacity - each * size, ((size, each),), n // each)
                    n %= each
                if n:
                    put(capacity - n * size, ((size, n),), 1)
                    n = 0
    return done + [(p, c) for groups in room.values() for p, c in groups]


def plan(demand: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[Configuration, int]], float, int]:
    """Groups (configuration, copies) that use up the histogram exactly, the lower bound, and how many sequences the program made."""
    rest = demand.astype(np.int64).copy()
    full, rest[capacity] = int(rest[capacity]), 0
    whole = [(((capacity, 1),), full)] if full else []
    count = lambda groups: sum(c for _, c in groups)
    alone = best_fit(rest, capacity)
    best, made, bound = None, 0, 0.0
    few = np.count_nonzero(rest) <= EXCHANGED
    if few and rest.any():
        best, bound, made = solved(rest, capacity)
    for rate, heaviest in TRIES if rest.any() and not few else ():
        groups, left, dual = program(rest, capacity, rate, heaviest)
        bound, by_program = max(bound, dual), count(groups)
        groups = groups + best_fit(left, capacity)
        if best is None or count(groups) < count(best):
            best, made = groups, by_program
        if count(best) <= max(bound * (1 + GAP), np.ceil(bound - 1e-6)):
            break
    if best is None or count(alone) < count(best):
        best, made = alone, 0
    return whole + best, full + bound, full + made


class Places:
    """Where the row of a given rank among the rows of its length goes."""

    def __init__(self, groups: list, capacity: int):
        rows, base, seen = [], 0, np.zeros(capacity + 1, np.int64)
        for pattern, copies in groups:
            at = 0
            for size, n in pattern:
                rows.append((size, seen[size], base, copies, at))
                seen[size] += n * copies
                at += n * size
            base += copies
        a = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.size, self.rank, self.base, self.copies, self.at = (np.ascontiguousarray(a[:, k]) for k in range(5))
        self.first = np.searchsorted(self.size, np.arange(capacity + 2))
        self.sequences = base

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.first[length], self.first[length + 1]
        while (high - low > 1).any():  # binary search in the intervals of each row's length
            mid = (low + high) // 2
            right = (high - low > 1) & (self.rank[mid] <= rank)
            low, high = np.where(right, mid, low), np.where(right | (high - low <= 1), high, mid)
        within = rank - self.rank[low]
        return self.base[low] + within % self.copies[low], self.at[low] + within // self.copies[low] * length


def cut(df: DataFrame, tokenizer: str, capacity: int, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. The closing id counts as the document's last."""

    def run(batches):
        encode = encoder(WordPieces, tokenizer)
        for whole in batches:
            for batch in slices(whole, "text", 6 << 20):
                ids, at = encode(batch.column("text"))
                if end_id is not None:
                    ids = np.insert(ids, at[1:], np.uint32(end_id))
                    at = at + np.arange(len(at))
                ids = np.ascontiguousarray(ids, dtype="<u4")
                lens = np.diff(at)
                pieces = np.maximum(-(-lens // capacity), 0)
                doc = np.repeat(np.arange(len(lens)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, lens[doc] - start)
                view, begin = memoryview(ids), at[doc] + start
                crc = [zlib.crc32(view[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs the encoded texts into sequences of at most `capacity` tokens.

    Returns one row per piece: id_col, piece, start, length, ids_crc32,
    sequence_id, offset. Only documents longer than a sequence are cut.
    """
    pieces = stored(cut(df, tokenizer, capacity, end_id, id_col, text_col), "packing")
    salts = max(LEAST_SALTS, pieces.count() // SALT_ROWS)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    demand = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most a row for each length
        demand[row["length"]] = row["n"]
    places = Places(plan(demand, capacity)[0], capacity)
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("length", "salt", earlier.alias("before"))

    def place(batches):
        for b in batches:
            length = b.column("length").to_numpy()
            sequence, offset = places(length, b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("nth", nth).join(before, ["length", "salt"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))
    kind = df.schema[id_col].dataType.simpleString()
    out = ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
