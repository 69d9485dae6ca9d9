"""A corpus pipeline over documents: language, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
documents. The stages fit models, take signatures and solve a packing program,
which SQL cannot express: their tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm import langid, neardup, packing, quality
from noticeflow.llm.common import stored, table, work_path
from noticeflow.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the learned languages, one or a mixture; those without letters go."""
    found = langid.with_languages(docs)
    return found.where(F.col("lang_pred") != "und").select("row.*")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and resemble trusted text; the others go."""
    return quality.with_rules(docs, table(spark, sf_dir, "labels")).where("kept").select("row.*")


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, repeated rows among them: that with the smallest doc_id.

    Rows without a text or a doc_id are alone and stay.
    """
    # a number for each row, as a doc_id may repeat; written, so that it holds
    rows = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("nth")), "rows")
    known = rows.where("row.doc_id is not null").select("nth", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    classes = neardup.classes(known.select("nth", "text"), id_col="nth")
    first = known.select("nth", "doc_id").join(classes, "nth").groupBy("class_id").agg(F.min(F.struct("doc_id", "nth")).alias("least")).select("least.nth")
    kept = rows.join(first, "nth", "left_semi").select("row.*")
    return kept.union(rows.where("row.doc_id is null").select("row.*"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, packed into sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", good), ("near_duplicates", unique), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
