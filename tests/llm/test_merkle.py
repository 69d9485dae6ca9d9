"""The Merkle manifest against a sequential one."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from noticeflow.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [v + more if k == 3 and v is not None else v for k, v in enumerate(row)]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """Root, and for each leaf its (sibling or None, whether it stands on the left) up to there."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            other = p ^ 1
            steps[k].append((nodes[other] if other < len(nodes) else None, other < p))
            at[k] = p // 2
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], steps


def brute(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    for rs in langs.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    below = {x: tree([leaf(r) for r in langs[x]]) for x in order}
    root, above = tree([below[x][0] for x in order]) if order else (None, [])
    out = []
    for x, up in zip(order, above, strict=True):
        for r, path in zip(langs[x], below[x][1], strict=True):
            own = leaf(r, 1 if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else 0)
            for s, left in path + up:
                own = H(s, own) if left else H(own, s or "")
            out.append((r[0], leaf(r), below[x][0], root, H(*[s for s, _ in path + up if s]), own, own == root))
    return out


def check(df):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = [tuple(r) for r in merkle.manifest(df, tampered).collect()]
    want = brute([tuple(r) for r in df.select(*FIELDS).collect()])
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_manifest_equals_sequential(spark, sf_dir):
    got = check(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert {r[-1] for r in got} == {True, False}


def test_manifest_edges(edge, nothing):
    check(edge.withColumn("n_chars", F.when(F.col("doc_id") == 4, None).otherwise(F.col("doc_id"))).withColumn("doc_id", F.when(F.col("doc_id") == 3, None).otherwise(F.col("doc_id"))))
    assert check(nothing) == []


def test_query_equals_its_sql(spark, sf_dir):
    import duckdb

    from noticeflow import llm

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = llm.QUERIES["op13_merkle"](spark, sf_dir)
    want = con.sql(llm.ORACLE_SQL["op13_merkle"])
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("counts", [[1], [2, 1], [1025, 3, 1, 1, 1], [2048, 1024]])
def test_shapes_of_trees(spark, counts, monkeypatch):
    """Lone leaves, lone last nodes, and groups that end at a chunk's edge; joins cut into shares of four."""
    monkeypatch.setattr(merkle, "SHARE", 2)
    rows = [(i * 3 + k, None, f"l{k}", i, "t" * (i % 3)) for k, n in enumerate(counts) for i in range(n)]
    check(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
