"""Proportional stratified interleaving of rows into shards.

Each source's rows are shuffled by a seeded hash and ranked; the fractional rank
(2 rank - 1) / (2 rows of the source) spreads every source evenly over (0, 1).
All rows sorted by fractional rank and cut into runs of equal count give shards
that each hold every source in its share, and whose row counts differ by one at
most (law `rows`). Both orders are total; ranks come from windows over narrow
stretches of the hash or of the fractional rank plus the counts of the stretches
before, so no source, however large, meets in one task.

Null texts have no bytes; null sources are a source of their own; repeated rows
each get a place; an empty table gives no rows. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unsigned_crc

#: Rows that a stretch of the hash, or of the fractional rank, holds about; stretches at least.
STRETCH_ROWS, LEAST_STRETCHES = 1 << 16, 1024


def _global_rank(df: DataFrame, keys: list[str], stretch: str, order: list[Column], rank: str, total: str) -> DataFrame:
    """1-based rank of each row among the rows of its keys, sorted by stretch and then by order, and the number of those rows."""
    counts = df.groupBy(*keys, stretch).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *[F.col(k).alias(f"_{k}") for k in [*keys, stretch]],
        F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"),
    )
    same = F.lit(True)
    for k in [*keys, stretch]:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    nth = F.row_number().over(Window.partitionBy(*keys, stretch).orderBy(*order))
    return df.withColumn("_nth", nth).join(counts, same).withColumn(rank, F.col("_before") + F.col("_nth")).withColumn(total, F.col("_all")).drop(*[f"_{k}" for k in [*keys, stretch]], "_before", "_all", "_nth")


def interleave(df: DataFrame, shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Returns id_col, source, size (bytes and one), text_crc32, law, shard, slot, grown_shard (null: law `rows`)."""
    # a power of two that grows with the table
    stretches = max(LEAST_STRETCHES, 1 << (df.count() // STRETCH_ROWS).bit_length())
    rows = df.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        unsigned_crc(text_col).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"),
    )
    # the top bits of the hash, shifted to be unsigned
    rows = rows.withColumn("stretch", F.shiftright("h", 64 - stretches.bit_length() + 1))
    rows = _global_rank(rows, ["source"], "stretch", [F.col("h"), F.col("id"), F.col("text_crc32"), F.col("size")], "rank", "of_source")
    rows = rows.withColumn("f", (F.col("rank") - 0.5) / F.col("of_source"))
    rows = rows.withColumn("part", F.floor(F.col("f") * stretches).cast("int")).withColumn("one", F.lit(0))
    rows = _global_rank(rows.drop("stretch"), ["one"], "part", [F.col("f"), F.col("source"), F.col("rank")], "place", "total")
    # places p * shards div total: each shard gets total div shards rows or one more
    shard = F.expr(f"(place - 1) * {shards} div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return (
        rows.withColumn("shard", shard)
        .withColumn("slot", F.col("place") - 1 - first)
        .select(F.col("id").alias(id_col), F.col("source"), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
    )
