"""Containment join against brute force, and the rows between its stages."""

import numpy as np
from pyspark.sql import functions as F

from noticeflow.operators import contain


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    letters = list("abcжщ é")
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 90)))) for _ in range(150)] + ["", "a", "ж"]
    patterns = set()
    for _ in range(400):
        t = texts[int(rng.integers(len(texts)))]
        i, n = int(rng.integers(0, max(1, len(t)))), int(rng.integers(1, 50))
        patterns.add(t[i : i + n] if rng.integers(4) else "".join(rng.choice(letters, n % 6 + 1)))
    patterns.discard("")
    t = spark.createDataFrame([*enumerate(texts), (999, None)], "text_id long, text string").repartition(3)
    p = spark.createDataFrame([(x,) for x in [*patterns, "", None]], "pattern string")
    got = {tuple(r) for r in contain.contained(t, p).collect()}
    assert got == {(i, x) for i, s in enumerate(texts) for x in patterns if x in s}


def test_empty(spark):
    t = spark.createDataFrame([(1, "text")], "text_id long, text string")
    p = spark.createDataFrame([("ex",)], "pattern string")
    assert contain.contained(t.limit(0), p).count() == 0
    assert contain.contained(t, p.limit(0)).count() == 0


def test_hot_prefix_gives_no_pairs(spark):
    """All titles and texts begin with the same words: titles meet by what is rare in them."""
    start = "supply of cable and wire for the needs of the plant number "
    t = spark.range(400).select(F.col("id").alias("text_id"), F.concat(F.lit(start), F.col("id") * 7919 % 400 + 10_000, F.lit(" and more")).alias("text"))
    p = spark.range(400).select(F.concat(F.lit(start), F.col("id") + 10_000).alias("pattern"))
    assert contain.candidates(t, p).distinct().count() < 4000
    assert contain.contained(t, p).count() == 400


def test_parts_of_a_string_are_not_the_string(spark):
    """texts that hold both halves of a string, but not the string, are no candidates; long strings are looked for in the text."""
    part = lambda k: "".join(f"{(k + 1) * 7919 * n % 9973:04d}" for n in range(1, 11))
    t = spark.createDataFrame([(k, f"{part(k)[:25]} and {part(k)[15:]}") for k in range(200)] + [(200, "ж" * 60 + "x")], "text_id long, text string")
    p = spark.createDataFrame([(part(k),) for k in range(200)] + [("ж" * 60,), ("ж" * 60 + "y",), ("ж" * 60 + "x",), ("ж" * 48,)], "pattern string")
    assert contain.candidates(t.where("text_id < 200"), p).count() == 0
    assert {tuple(r) for r in contain.contained(t, p).collect()} == {(200, "ж" * 60), (200, "ж" * 60 + "x"), (200, "ж" * 48)}


def test_occurrences_without_overlap(spark):
    """occurrences are counted where the texts lie, also of strings that overlap themselves and of long ones."""
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abж "), int(rng.integers(0, 200)))) for _ in range(80)] + ["a" * 301, "аб" * 120, ""]
    patterns = {t[i : i + n] for t in texts for i, n in [(k * 3, k % 6 + 1) for k in range(12)]} | {"aa", "aba", "a" * 100, "аб" * 49, "аб" * 48}
    patterns.discard("")
    t = spark.createDataFrame([*enumerate(texts), (999, None)], "text_id long, text string").repartition(3)
    got = {tuple(r) for r in contain.occurrences(t, spark.createDataFrame([(x,) for x in patterns], "pattern string")).collect()}
    assert got == {(i, x, s.count(x)) for i, s in enumerate(texts) for x in patterns if x in s}
