"""Product matching against all pairs, with heavy items, and the pairs that it looks at."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeflow.functions.text import normalize, search_tokens, stems
from noticeflow.operators import products


def tokens(x):
    return list(dict.fromkeys(t for t in re.findall(r"[a-zа-я0-9]+(?:[-/.][a-zа-я0-9]+)*", x) if len(t) > 1))


def stem(w):
    return w[: max(4, min(10, len(w) - 2))]


def brute(queries, items, k):
    out = set()
    for qid, q, cat in queries:
        qt = tokens(q)
        qs, models = list(dict.fromkeys(map(stem, qt))), [t for t in qt if re.search(r"\d", t)]
        found = []
        for pid, name, article, category, price, priority, allowed in items:
            toks = tokens(f"{name} {article}")
            ps, hit_models = {stem(t) for t in toks}, [m for m in models if m in toks]
            hits = sum(s in ps for s in qs)
            if not hits or models and not hit_models or cat is not None and allowed and cat not in allowed:
                continue
            score = hits / len(qs) * 70 + hits * 2 + 35 * (len(q) >= 4 and q in name) + 120 * bool(article and (q == article or article in qt)) + 25 * len(hit_models)
            score += 20 * bool(toks and stem(toks[0]) in qs) + 8 * bool(set(qs) & {stem(t) for t in tokens(category)})
            if round(score, 2) >= 25:
                found.append((-round(score, 2), priority, price is None, price or 0.0, name, pid))
        out |= {(qid, f[5], -f[0], n + 1) for n, f in enumerate(sorted(found)[:k])}
    return out


def catalog(rng, n):
    words = ["кабель", "кабельный", "провод", "лампа", "труба 20", "10", "hp-2035n", "насос"] + [f"слово{i}" for i in range(40)]
    pick = lambda m: " ".join(rng.choice(words, m, p=[0.2, 0.05, 0.1, 0.1, 0.05, 0.05, 0.03, 0.02] + [0.01] * 40))
    items = []
    for i in range(n):
        article = ["", "нет", f"a{i % 9}", "10", pick(2)][int(rng.integers(5))]
        items.append((i, pick(int(rng.integers(1, 5))), article, str(rng.choice(["", "кабели", "лампа", "разное"])), None if i % 7 == 0 else float(rng.integers(1, 6)), int(rng.integers(2)), None if i % 3 == 0 else [] if i % 3 == 1 else ["x", str(rng.choice(["y", "z"]))]))
    queries = [(j, pick(int(rng.integers(1, 4))), [None, "x", "y"][j % 3]) for j in range(60)] + [(100, "нет", None), (101, "абель", None), (102, "кабель лам", None), (103, "a3", None), (104, "!", None)]
    return items, queries


@pytest.mark.parametrize("light", [None, 0, 5, 40])
def test_equals_all_pairs(spark, light):
    items, queries = catalog(np.random.default_rng(light or 1), 300)
    p = spark.createDataFrame(items, "product_id long, name string, article string, category string, price double, priority int, allowed array<string>").withColumn("supplier_id", F.lit("s"))
    q = spark.createDataFrame(queries, "query_id long, query string, cat string")
    got = {(r["query_id"], r["product_id"], r["score"], r["rank"]) for r in products.match_products(q, p, k=4, category="cat", light=light).collect()}
    assert got == brute(queries, items, 4)
    got = {(r["query_id"], r["product_id"], r["score"], r["rank"]) for r in products.match_products(q, p, k=4, light=light).collect()}
    assert got == brute([(i, x, None) for i, x, _ in queries], items, 4)


def test_hot_stem_gives_no_near_all_pairs(spark):
    """Half of 4,000 products and all 300 queries hold one stem."""
    hot = F.when(F.col("id") % 2 == 0, F.concat(F.lit("кабель марка"), F.col("id"))).otherwise(F.concat(F.lit("насос модели"), F.col("id")))
    p = spark.range(4000).select(F.col("id").alias("product_id"), F.lit("s").alias("supplier_id"), hot.alias("name"), F.lit("").alias("article"), F.lit("").alias("category"), F.col("id").cast("double").alias("price"), F.lit(0).alias("priority"))
    q = spark.range(300).select(F.col("id").alias("query_id"), F.concat(F.lit("кабель силовой тип"), F.when(F.col("id") % 3 == 0, "").otherwise("ный")).alias("query"))
    _q = q.select("query_id", normalize("query").alias("_q")).withColumn("_qt", search_tokens("_q")).withColumn("_qs", stems(F.col("_qt")))
    pairs = products.candidate_pairs(_q, products.product_keys(p), 10, 200)
    assert pairs.count() <= 300 * 20
    out = products.match_products(q, p, light=200)
    assert out.count() == 3000 and {r["product_id"] for r in out.select("product_id").distinct().collect()} == set(range(0, 20, 2))
