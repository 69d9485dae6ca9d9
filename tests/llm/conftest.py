import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 997} of{i % 31}" for i in range(30_000))
TEXTS = [None, "", " \n\t", "a", "Hello world, the quick brown fox. " * 20, LONG, "中文 测试 " * 50, "<|endoftext|>x<|im_end|>", "line one here\nline one here\n\nline two", "no-break  space wide\x0bx"]


@pytest.fixture(scope="session")
def vocab():
    import public_tokenizers

    return lambda name: str(public_tokenizers.path(name))


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, repeated rows and texts, and columns named like the operators' own."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", i) for i, t in enumerate(TEXTS)]
    rows += [(4, TEXTS[4], None, "s", 4), (50, TEXTS[4], "en", "s", 50), (51, TEXTS[4], "de", "s", 51)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("id", "row", "key", "score", "kept", "lang_pred", "class_id", "piece", "start", "length", "salt", "shard", "slot", "h", "rank", "one", "place", "route", "digest", "head", "media", "n", "count", "_n"):
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("doc_id < 0")
