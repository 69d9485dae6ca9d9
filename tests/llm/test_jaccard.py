"""The parity-sketch join against all pairs."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import components, jaccard

UPPER = {c: c + 32 for c in range(65, 91)}


def runs(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {" ".join(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {" ".join(w)} if w else set()


def brute(rows, percent=85):
    of = [runs(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(of[i] & of[j])
            if of[i] and of[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * len(of[i] | of[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = d if root(i) not in least or d is None else min(least[root(i)], d)
    return [(d, len(of[i]), least[root(i)] if d is not None else None) for i, (d, _) in enumerate(rows)]


def check(df, **more):
    got = [tuple(r) for r in jaccard.linked(df, **more).collect()]
    want = brute([tuple(r) for r in df.select("doc_id", "text").collect()], more.get("percent", 85))
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def edited(rng, n_words, copies, share):
    """A text of random words, and copies with a share of the words replaced, dropped or added."""
    base = [f"w{rng.integers(5000)}" for _ in range(n_words)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(int(rng.integers(0, max(1, int(share * n_words)) + 1))):
            at = int(rng.integers(len(w)))
            w[at : at + int(rng.integers(0, 2))] = [f"x{rng.integers(10**6)}"] if rng.integers(3) else []
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def copies(spark):
    rng = np.random.default_rng(3)
    texts = [t for n in (3, 4, 5, 8, 9, 10, 12, 13, 17, 30, 45, 70, 150, 400) for _ in range(3) for t in edited(rng, n, 6, 0.05)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(rng.permutation(texts).tolist())], "doc_id long, text string").repartition(4)


def test_no_pair_is_lost(copies):
    got = check(copies)
    assert len({c for *_, c in got}) < 0.7 * len(got)


def test_late_rounds_find_what_leaders_miss(copies, monkeypatch):
    """Small blocks; a chain of copies whose ends are not similar."""
    monkeypatch.setattr(jaccard, "MEMBERS", 4)
    check(copies, percent=70)


def test_chain(spark):
    base = [f"c{i}" for i in range(120)]
    rows = [(i, " ".join(base[:5] + [f"y{k}" for k in range(3 * i)] + base[5 + 3 * i :])) for i in range(25)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {c for *_, c in got} == {0}


def test_sketches_bound_differences():
    """Two sketches differ in at most as many bits as the sets have runs apart, and similar sets share a key."""
    rng = np.random.default_rng(1)
    bands = jaccard.Bands()
    for n in [*range(1, 40), 100, 333, 1000, 5000]:
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        for drop in range(0, n + 1, max(1, n // 12)):
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 1 << 63, drop // 2).astype(np.uint64)]))
            if len(b) == 0:
                continue
            band = np.full(2, bands.of(np.array([max(len(a), len(b))]))[0])
            keys, at, folded, base = jaccard.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), band, bands)
            apart = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
            assert jaccard._differ(folded[: base[1]].tobytes(), folded[base[1] :].tobytes()) <= apart
            if jaccard.similar(a, b, 85):
                assert set(keys[: at[1]]) & set(keys[at[1] :]), n
                low, high = sorted((len(a), len(b)))
                assert bands.of(np.array([low]))[0] == band[0] or bands.next_too(np.array([low]))[0] and bands.of(np.array([low]))[0] + 1 == band[0]


def test_sets_equal_words():
    texts = ["", " \n", "A b", "a B", "one two three four five one two three four", "x y É é a\x0bb", "a" * 5000]
    got, at = jaccard.sets(pa.array([*texts, None]))
    assert np.diff(at).tolist() == [len(runs(t)) for t in texts] + [0]
    assert got[at[2]] == got[at[3]]


def test_edges(edge, nothing):
    check(edge)
    check(edge.withColumn("doc_id", F.when(F.col("doc_id") == 50, None).when(F.col("doc_id") == 5, 6).otherwise(F.col("doc_id"))))
    assert check(nothing) == []


def test_query_equals_its_sql(spark, sf_dir):
    import duckdb

    from noticeflow import llm

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name in ("op11_resample", "op12_jaccard"):
        want = con.sql(llm.ORACLE_SQL[name])
        got = llm.QUERIES[name](spark, sf_dir).select(*want.columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_nothing_that_grows_is_broadcast(spark, sf_dir, monkeypatch):
    """a work table is small as a file long before its rows are few, so that joins do not send it to the driver."""
    plans = []

    def written(df, name, store=jaccard.written):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(jaccard, "written", written)
    monkeypatch.setattr(components, "stored", written)
    out = jaccard.linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("SortMergeJoin") for p in plans) > 20 and not [p for p in plans if "Broadcast" in p]
