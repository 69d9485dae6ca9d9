"""The pipeline's stages against brute force, on ties, repeated rows and edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_ops import brute_classes, brute_rules

import corpus_pipeline as pipe
from noticeflow.llm import quality


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = docs
    for name, stage in pipe.STAGES[:-1]:
        after = stage(spark, at, sf_dir)
        assert after.columns == docs.columns, name
        kept = after.select("doc_id").distinct().count()
        assert 0 < kept <= at.count()
        at = spark.createDataFrame(after.toPandas(), docs.schema)
    packed = pipe.run(spark, sf_dir).toPandas()
    assert set(packed.doc_id) == {r["doc_id"] for r in at.select("doc_id").collect()}


def test_pipeline_edges(spark, edge, nothing, sf_dir):
    for name, stage in pipe.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0, name
    texts = {(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()}
    for name, stage in pipe.STAGES[:-1]:
        after = stage(spark, edge, sf_dir)
        assert after.columns == edge.columns and {(r["doc_id"], r["text"]) for r in after.select("doc_id", "text").collect()} <= texts, name
    assert {r["doc_id"] for r in pipe.packed(spark, edge, sf_dir).select("doc_id").collect()} == {d for d, _ in texts}


def test_language_stage(spark, sf_dir):
    """What has a letter stays, repeated rows and rows without an id too; what has none goes."""
    rows = [(1, "plain words here", "en", 0), (1, "plain words here", "en", 0), (2, "123 !?", "en", 0), (3, None, None, 0), (None, "слова", None, 0), (4, "", "en", 0), (5, "é", None, 0), (6, "trailing words", "de", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in pipe.language(spark, docs, sf_dir).collect())
    assert got == sorted((d or 0, t) for d, t, *_ in rows if t and any(c.isalpha() for c in t))


def test_quality_stage(spark, sf_dir, tmp_path):
    rng = np.random.default_rng(9)
    words = [[f"{a}{k}" for k in range(200)] for a in ("good", "junk")]
    texts = [" ".join(rng.choice(words[i % 2], int(rng.integers(45, 90)))) for i in range(60)] + [None, "", "x " * 80]
    texts[7] = texts[5]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("kept", F.lit("clash"))
    known = {i: int(i % 2 == 0) for i in range(40)}
    spark.createDataFrame(list(known.items()), "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    folds = {r["id"]: r["f"] for r in spark.range(60).selectExpr("id", f"pmod(xxhash64(id), {quality.FOLDS}) as f").collect()}
    want = [i for i, k in enumerate(brute_rules(texts, known, folds)) if k]
    assert sorted(r["doc_id"] for r in pipe.good(spark, docs, str(tmp_path)).collect()) == want


def test_near_duplicate_stage(spark, sf_dir):
    """The row of the smallest id of each class stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is not None]
    group = brute_classes([t for _, t in rows])
    want = sorted(min(rows[i][0] for i, g in enumerate(group) if g == k) for k in set(group))
    assert sorted(r["doc_id"] for r in pipe.unique(spark, docs.where("text is not null"), sf_dir).collect()) == want


def test_unique_keeps_one_row_of_a_group(spark, sf_dir):
    a, b = "one two three four five six seven " * 9, "quite another text of eight words and more " * 5
    rows = [(5, a, 0), (5, a, 1), (3, a, 2), (3, a, 3), (9, b, 4), (5, b, 5), (None, a, 6), (None, None, 7), (8, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    got = sorted((r["doc_id"] or 0, r["text"] == b, r["n"]) for r in pipe.unique(spark, docs, sf_dir).collect())
    assert [x[:2] for x in got] == [(0, False), (0, False), (3, False), (5, True), (8, False)]
    assert {x[2] for x in got} - {2, 3} == {5, 6, 7, 8}


def test_mixed_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = docs.where("lang is not null").groupBy("lang").agg(F.array_join(F.slice(F.collect_list("text"), 1, 40), " ").alias("t")).orderBy("lang").limit(3)
    parts = [r["t"][:n] for r, n in zip(whole.collect(), (4000, 3000, 3000), strict=True)]
    mixed = docs.limit(1).withColumns({"doc_id": F.lit(-1).cast(docs.schema["doc_id"].dataType), "text": F.lit(" ".join(parts)), "lang": F.lit(None).cast("string")})
    assert pipe.language(spark, docs.unionByName(mixed), sf_dir).where("doc_id = -1").count() == 1


def test_shares_of_seven_languages():
    import pyarrow as pa

    from noticeflow.llm import langid

    rng = random.Random(3)
    runs = ["".join(rng.choice(abc) for _ in range(4800)) for abc in ("abc", "def", "ghi", "jkl", "mno", "pqr", "stu")]
    counts = np.array([np.bincount(langid.hashed(langid.padded(pa.array([r]), letters=True)[0]), minlength=langid.BUCKETS) for r in runs]) + 0.5
    table = np.ascontiguousarray(np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32))
    _, share = langid.infer(pa.array(["".join(runs)]), table)
    assert abs(share[0] - 1 / 7) < 0.02
