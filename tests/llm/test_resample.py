"""Importance resampling against a sequential version, with heads of several sizes."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
ODD = ["", "a", "A b", "Déjà-VU 中文测试 x", "w" * 70 + " " + "v" * 300 + " z", "one two three one two three one two", "tail." * 3, "É É É", "\x7f\x60 a0 9z"]


def features(text):
    w = WORD.findall((text or "").translate(UPPER))
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def brute(rows, aims, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text)[0]))
    for text in aims:
        t.update(map(bucket, features(text)[0]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for i, text in rows:
        fs, n = features(text)
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


@pytest.mark.parametrize("cut", [0, 3, 10_000])
def test_runs_have_their_crc(cut):
    texts = ODD + [None, " ".join(ODD)]
    every = Counter(w for t in texts for w in WORD.findall((t or "").translate(UPPER)))
    words = [w.encode() for w, _ in every.most_common(cut) if len(w.encode()) <= resample.LONGEST]
    pairs = [(a, b) for a in words[:20] for b in words[:20]]
    got = resample.Hasher(words, pairs)(pa.array(texts))
    for n, (doc, crc) in enumerate(got, 1):
        for k, text in enumerate(texts):
            w = WORD.findall((text or "").translate(UPPER))
            assert crc[doc == k].tolist() == [zlib.crc32(" ".join(w[i : i + n]).encode()) for i in range(len(w) - n + 1)]


def test_shifts_of_any_length():
    shift = resample.Shifts()
    for n in (0, 1, 63, 64, 65, 1000, 70_001):
        b = bytes(k * 7 % 251 for k in range(n))
        got = int(shift(np.array([zlib.crc32(b"abc")], np.uint32), np.array([n]))[0]) ^ zlib.crc32(b)
        assert got == zlib.crc32(b"abc" + b)


def check(df, target, percent):
    got = [tuple(r) for r in resample.resample(df, target, percent).collect()]
    want = brute([tuple(r) for r in df.select("doc_id", "text").collect()], [r[0] for r in target.select("text").collect()], percent)
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


@pytest.mark.parametrize("sizes", [(1 << 16, 1 << 17), (40, 25)])
def test_resample_equals_brute_force(spark, sf_dir, monkeypatch, sizes):
    monkeypatch.setattr(resample, "WORDS", sizes[0])
    monkeypatch.setattr(resample, "PAIRS", sizes[1])
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 5)


def test_resample_edges(spark, edge, nothing):
    target = spark.createDataFrame([(0, "of word1 of word2"), (1, None)], "item_id long, text string")
    ids = edge.withColumn("doc_id", F.when(F.col("doc_id") == 5, None).otherwise(F.col("doc_id")))
    assert any(r[-1] for r in check(ids, target, 40))
    assert check(nothing, target, 40) == []
    check(edge, target.where("item_id < 0"), 100)
