"""Language of documents by inference of each document's mixture of languages.

Training counts hashed byte 4-grams of letters per language over all training
rows, summed on the executors. A document is divided into windows of WINDOW
n-grams; a window's log likelihood under each language is the sum over its
n-grams. Expectation-maximisation over the windows estimates the share of each
language; among the sets made of the largest shares, that of the best likelihood
less a penalty per language is taken, and its largest share names the document. Sets
are tried in growing size until none larger could make up for its penalty.

Null texts and texts without letters are `und` with score 0. Without training
rows every document is `und`. A null id counts as not held out. Texts of any
length are used whole; equal texts get equal results; repeated rows stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import VECTOR_SCHEMA, slices, summed, vector_rows
from .grams import BUCKETS, hashed, padded

#: N-grams in a window. A document's estimation ends when no share moves by more than SETTLED, or after STEPS.
WINDOW, STEPS, SETTLED = 48, 200, 1e-4
#: Overlapping 4-grams repeat evidence; penalty per language in units of log(windows + 1).
TEMPER, PENALTY, SMOOTH = 0.25, 1.0, 0.5
#: What an estimation that has settled may lack in likelihood.
NEAR = 0.01


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in slices(whole, "text"):
            data, at = padded(batch.column("text"), letters=True)
            gram = hashed(data)
            langs = batch.column("lang").dictionary_encode()
            inside = np.ones(len(gram), bool)
            for k in (1, 2, 3):
                inside[at[1:-1] - k] = False
            doc = np.repeat(langs.indices.to_numpy(), np.diff(at))[: len(gram)].astype(np.int64)
            found = np.bincount((doc * BUCKETS + gram)[inside], minlength=len(langs.dictionary) * BUCKETS).reshape(-1, BUCKETS)
            for lang, v in zip(langs.dictionary.to_pylist(), found, strict=True):
                total[lang] = total[lang] + v if lang in total else v
    if total:
        yield vector_rows(total)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = 1000) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of each bucket, from the rows that aren't held out; `most` languages at most."""
    rows = df.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = summed(rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(_count, VECTOR_SCHEMA), BUCKETS, most)
    names = sorted(counts)
    table = np.array([counts[n] for n in names], float).reshape(len(names), BUCKETS) + SMOOTH
    return names, np.ascontiguousarray(np.log(table / table.sum(1, keepdims=True)).T.astype(np.float32)) if names else np.zeros((BUCKETS, 0), np.float32)


def _mixture(ll: np.ndarray, first: np.ndarray, count: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log likelihood of each document's windows when only some languages may occur in it."""
    doc = np.repeat(np.arange(len(first)), count)
    ll = np.where(allowed[doc], ll, -np.inf)
    top = ll.max(1, keepdims=True)
    lik = np.exp(ll - top)
    share = allowed / allowed.sum(1, keepdims=True)
    # documents still moving; each goes on by itself, so its result doesn't depend on its neighbours
    moving = np.flatnonzero(allowed.sum(1) > 1)
    for _ in range(STEPS):
        if len(moving) == 0:
            break
        n = count[moving]
        begin = np.cumsum(n) - n
        part = lik[np.repeat(first[moving] - begin, n) + np.arange(n.sum())] * np.repeat(share[moving], n, axis=0)
        part /= part.sum(1, keepdims=True)
        now = np.add.reduceat(part, begin, axis=0) / n[:, None]
        far = np.abs(now - share[moving]).max(1) > SETTLED
        share[moving] = now
        moving = moving[far]
    return share, np.add.reduceat(np.log((lik * share[doc]).sum(1)) + top[:, 0], first)


def infer(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the number of its language and that language's share."""
    data, at = padded(texts, letters=True)
    gram = hashed(data)
    size = np.diff(at) - 3
    size = np.maximum(size, 0)
    count = np.maximum(-(-size // WINDOW), 1)
    first = np.cumsum(count) - count
    nth = np.arange(count.sum()) - np.repeat(first, count)
    begin = np.repeat(at[:-1], count) + nth * WINDOW
    score = table[gram]
    if len(score) < at[-1]:
        score = np.concatenate([score, np.zeros((at[-1] - len(score), table.shape[1]), np.float32)])
    for k in (1, 2, 3):  # n-grams that reach into the next document
        score[at[1:] - k] = 0
    ll = np.add.reduceat(score, begin, axis=0).astype(float) * TEMPER
    everything = np.ones((len(first), table.shape[1]), bool)
    share, most = _mixture(ll, first, count, everything)
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    best = np.full(len(first), -np.inf)
    chosen = np.zeros_like(share)
    for n in range(1, table.shape[1] + 1):
        # no set fits better than all languages together
        at = np.flatnonzero(most - PENALTY * n * np.log(count + 1) + NEAR > best)
        if len(at) == 0:
            break
        rows = np.repeat(first[at] - (np.cumsum(count[at]) - count[at]), count[at]) + np.arange(count[at].sum())
        part, fit = _mixture(ll[rows], np.cumsum(count[at]) - count[at], count[at], rank[at] < n)
        value = fit - PENALTY * n * np.log(count[at] + 1)
        better = value > best[at]
        best[at[better]], chosen[at[better]] = value[better], part[better]
    lang = chosen.argmax(1)
    return lang, chosen[np.arange(len(lang)), lang]


def with_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Columns row (all columns of df), lang_pred, score."""
    names, table = train(df, id_col, text_col, lang_col)
    most = (8 << 20) // max(4, len(names))

    def run(batches):
        for whole in batches:
            inner = pa.RecordBatch.from_struct_array(whole.column("row"))
            whole = pa.RecordBatch.from_arrays([whole.column("row"), inner.column(inner.schema.get_field_index(text_col)), whole.column("has_letter")], names=["row", "text", "has_letter"])
            for batch in slices(whole, "text", most):
                known = batch.column("has_letter").to_numpy(zero_copy_only=False)
                if names:
                    lang, share = infer(batch.column("text"), table)
                    share = np.where(known, np.clip(share, 0.0, 1.0), 0.0)
                    pred = pc.if_else(pa.array(known), pa.array(names).take(pa.array(lang)), "und")
                else:
                    share, pred = np.zeros(len(known)), pa.array(["und"] * len(known))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pred, pa.array(share)], names=["row", "lang_pred", "score"])

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("has_letter"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Returns id_col, held_out, lang_pred, score; learns from rows of df that aren't held out."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return with_languages(rows, "id", "text", "lang").select(F.col("row.id").alias(id_col), held_out("row.id").alias("held_out"), "lang_pred", "score")
