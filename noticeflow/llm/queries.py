"""The operators applied to the given tables: one query per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import conversations, digests

    said = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).selectExpr("-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{said}' as text")
    path = vocabulary("byte_bpe_50k.json")
    return digests(conversations(rows.unionByName(planted), path), path)


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import interleave

    return interleave(table(spark, sf_dir, "documents")).drop("source")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived

    return archived(table(spark, sf_dir, "pages"))


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiff import text_features

    return text_features(table(spark, sf_dir, "documents"))


def op8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import stored_ids

    return stored_ids(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import rules

    return rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import classes

    return classes(table(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import linked

    return linked(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(table(spark, sf_dir, "documents"), tampered)


QUERIES = {
    "op1_pack": op1_pack,
    "op2_chat": op2_chat,
    "op3_shard": op3_shard,
    "op4_bpe": op4_bpe,
    "op5_language": op5_language,
    "op6_warc": op6_warc,
    "op7_tiff": op7_tiff,
    "op8_ids": op8_ids,
    "op9_quality": op9_quality,
    "op10_neardup": op10_neardup,
    "op11_resample": op11_resample,
    "op12_jaccard": op12_jaccard,
    "op13_merkle": op13_merkle,
}
