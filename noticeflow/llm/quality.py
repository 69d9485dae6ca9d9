"""Quality rules: base counts of a text, and a likelihood ratio of its n-grams.

Two multinomials over hashed byte 4-grams are counted: of trusted text (rows
labelled 1) and of the whole corpus. A document's score is the mean over its
n-grams of the log ratio of their probabilities, so its length does not matter;
it is kept if the score reaches the threshold and the base rules hold. The
threshold is that which parts the labelled rows best, where losing good text
counts GOOD times as much as keeping bad text. For it the labelled rows are dealt
into FOLDS by a hash of the id, and each is scored by a ratio whose trusted counts
leave out its own fold, so that no row's score knows the row.

At most `most_labelled` labelled rows are used (those of the smallest hash of the
id), the rest of the method reads everything. Null and empty texts have no words
and fail the base rules. Without rows of both labels nothing fails by score; an
empty table gives no rows; repeated rows get equal results; a doc_id with several
labels has the smallest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import VECTOR_SCHEMA, slices, summed, text_bytes, vector_rows
from .grams import BUCKETS, hashed, padded

MOST_LABELLED = 20_000
GOOD, SMOOTH, FOLDS = 10.0, 0.5, 2
LEAST_WORDS, MOST_REPEATED = 50, 50

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])


def _repeated(doc: np.ndarray, word: np.ndarray, texts: int) -> np.ndarray:
    """For each text, its words within 3-word windows that occur twice or more in it."""
    out = np.zeros(texts, np.int64)
    if len(word) < 4:
        return out
    start = np.flatnonzero(doc[2:] == doc[:-2])
    if word.max() < 1 << 21:
        key = (word[start] << 42) | (word[start + 1] << 21) | word[start + 2]
    else:  # a single text of millions of different words
        pair = np.unique(word[start] * (word.max() + 1) + word[start + 1], return_inverse=True)[1]
        key = pair * (word.max() + 1) + word[start + 2]
    text = doc[start]
    mixed = (key ^ (text << np.int64(1))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed = (mixed + text.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(mixed, kind="stable")
    k, t, m = key[order], text[order], mixed[order]
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        pair = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
        if ((m[1:] == m[:-1]) & ~pair).any():  # two windows of one hash: sort by the windows themselves
            order = np.lexsort((key, text))
            k, t = key[order], text[order]
            pair = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
        same[1:] |= pair
        same[:-1] |= pair
    hit = start[order[same]]
    covered = np.zeros(len(word), bool)
    for j in range(3):
        covered[hit + j] = True
    return np.bincount(doc[covered], minlength=texts)


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    if texts.null_count:
        texts = texts.fill_null("")
    data, at = text_bytes(texts)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    first[at[:-1][at[:-1] < len(data)]] = ~space[at[:-1][at[:-1] < len(data)]]
    begin = np.flatnonzero(first)
    last = ~space
    last[:-1] &= space[1:]
    ends = at[1:][at[1:] > at[:-1]] - 1
    last[ends] = ~space[ends]
    stop = np.flatnonzero(last) + 1
    doc = np.searchsorted(at, begin, side="right") - 1
    # words as slices of one buffer
    bounds = np.empty(2 * len(begin) + 1, np.int64)
    bounds[0:-1:2], bounds[1::2], bounds[-1] = begin, stop, len(data)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    word = pieces.take(pa.array(np.arange(0, 2 * len(begin), 2))).dictionary_encode().indices.to_numpy().astype(np.int64) if len(begin) else np.zeros(0, np.int64)
    # lines with a word that equal an earlier one
    dup = np.zeros(len(texts), np.int64)
    lines = pc.split_pattern(texts, "\n")
    line_doc, flat = np.repeat(np.arange(len(texts)), np.diff(lines.offsets.to_numpy())), lines.flatten()
    if len(flat):
        coded = flat.dictionary_encode()
        wordy = np.array([bool(x.encode().split()) for x in coded.dictionary.to_numpy(zero_copy_only=False).tolist()], bool)
        at_line = coded.indices.to_numpy().astype(np.int64)
        full = wordy[at_line]
        key = np.sort(line_doc[full].astype(np.int64) * (len(wordy) + 1) + at_line[full])
        again = key[1:][key[1:] == key[:-1]] // (len(wordy) + 1)
        dup = np.bincount(again, minlength=len(texts))
    return {
        "n_words": np.bincount(doc, minlength=len(texts)),
        "word_chars": _per_text(~space & ((data & 0xC0) != 0x80), at),
        "n_symbols": _per_text(_SYMBOL[data], at),
        "n_dup_lines": dup,
        "n_repeat_words": _repeated(doc, word, len(texts)),
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


def scores(texts: pa.Array, ratio: np.ndarray) -> np.ndarray:
    """Mean log ratio over each text's n-grams."""
    data, at = padded(texts, letters=False)
    gram = hashed(data)
    value = np.zeros(len(data), np.float32)
    value[: len(gram)] = ratio[gram]
    for k in (1, 2, 3):
        value[at[1:] - k] = 0
    size = np.maximum(np.diff(at) - 3, 1)
    return np.add.reduceat(value, at[:-1]).astype(float) / size if len(size) else np.zeros(0)


def labelled(labels: DataFrame, most: int, id_col: str, label_col: str) -> DataFrame:
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(most)


def _ratio(trusted: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    p, q = ((c + SMOOTH) / (c + SMOOTH).sum() for c in (trusted, corpus))
    return np.log(p / q).astype(np.float32)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_labelled: int = MOST_LABELLED) -> tuple[np.ndarray, float]:
    """The log ratio of each bucket, and the threshold."""
    # at most most_labelled rows, so they may go to every task
    known = F.broadcast(labelled(labels, most_labelled, id_col, label_col).select("id", "label", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold")))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def count(batches):
        total = {name: np.zeros(BUCKETS, np.int64) for name in ("corpus", *map(str, range(FOLDS)))}
        for whole in batches:
            for batch in slices(whole, "text"):
                data, at = padded(batch.column("text"), letters=False)
                gram = hashed(data)
                inside = np.ones(len(gram), bool)
                for k in (1, 2, 3):
                    inside[at[1:-1] - k] = False
                total["corpus"] += np.bincount(gram[inside], minlength=BUCKETS)
                trusted = pc.equal(batch.column("label"), 1).fill_null(False).to_numpy(zero_copy_only=False)
                fold = batch.column("fold").to_pylist()
                for i in np.flatnonzero(trusted).tolist():
                    total[str(fold[i])] += np.bincount(gram[at[i] : at[i + 1] - 3], minlength=BUCKETS)
        yield vector_rows(total)

    counts = summed(rows.join(known, "id", "left").select("text", "label", "fold").mapInArrow(count, VECTOR_SCHEMA), BUCKETS)
    none = np.zeros(BUCKETS, np.int64)
    trusted = [counts.get(str(k), none) for k in range(FOLDS)]
    if not any(t.any() for t in trusted):
        return np.zeros(BUCKETS, np.float32), -np.inf
    corpus, whole = counts.get("corpus", none), sum(trusted)
    ratio = _ratio(whole, corpus)
    # a fold that holds all trusted rows leaves none; its rows are scored by all
    others = [_ratio(whole - t, corpus) if (whole - t).any() else ratio for t in trusted]

    def score(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                ok = ~base_failed(base_counts(batch.column("text")))
                fold = batch.column("fold").to_numpy()
                value = np.choose(fold, [scores(batch.column("text"), r) for r in others])
                yield pa.RecordBatch.from_arrays([batch.column("label").filter(pa.array(ok)).cast(pa.int64()), pa.array(value[ok])], names=["label", "score"])

    # ids that repeat are scored as often as they occur, but counted: distinct (label, score) pairs with their numbers
    seen = rows.join(known, "id").select("text", "label", "fold").mapInArrow(score, "label long, score double").groupBy("label", "score").count().toPandas()
    return ratio, threshold(seen["label"].to_numpy(), seen["score"].to_numpy(), seen["count"].to_numpy())


def threshold(label: np.ndarray, score: np.ndarray, times: np.ndarray | None = None) -> float:
    """The value that parts the labels best; the lowest of equally good ones."""
    if not (label == 1).any() or not (label == 0).any():
        return -np.inf
    times = np.ones(len(score)) if times is None else times
    values = np.unique(score)
    cuts = np.concatenate([[-np.inf], (values[1:] + values[:-1]) / 2])

    def below(wanted):
        at = np.flatnonzero(label == wanted)
        at = at[np.argsort(score[at], kind="stable")]
        return np.concatenate([[0], np.cumsum(times[at])])[np.searchsorted(score[at], cuts)] / times[at].sum()

    return float(cuts[np.argmin(GOOD * below(1) + 1 - below(0))])


def with_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """Columns row (all columns of df), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    ratio, least = fit(df, labels, id_col, text_col, label_col, most_labelled)

    def run(batches):
        for whole in batches:
            inner = pa.RecordBatch.from_struct_array(whole.column("row"))
            whole = pa.RecordBatch.from_arrays([whole.column("row"), inner.column(inner.schema.get_field_index(text_col))], names=["row", "text"])
            for batch in slices(whole, "text"):
                counts = base_counts(batch.column("text"))
                failed, value = base_failed(counts), scores(batch.column("text"), ratio)
                out = {"row": batch.column("row")} | {k: pa.array(v.astype(np.int64)) for k, v in counts.items()}
                out |= {"base_failed": pa.array(failed), "score": pa.array(value), "kept": pa.array(~failed & (value >= least))}
                yield pa.RecordBatch.from_pydict(out)

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")


def rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Returns id_col and the columns of `with_rules` but row."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    labels = labels.withColumnRenamed(id_col, "id") if id_col != "id" else labels
    out = with_rules(rows, labels, "id", "text", **options)
    return out.select(F.col("row.id").alias(id_col), *[c for c in out.columns if c != "row"])
