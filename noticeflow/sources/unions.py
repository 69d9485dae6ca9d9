"""Several sources as one table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import keep_first
from ..operators.report import canonical


def union_sources(*dfs: DataFrame, aliases: Mapping[str, str] | None = None, key: str = "unique_key", seq: str = "seq") -> DataFrame:
    """All sources in their order; of a key the first row counts. Aliases of source names are folded."""
    tagged = [df.withColumn("_source_order", F.lit(k)) for k, df in enumerate(dfs)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    both = both.withColumn("source", canonical("source", aliases or {}))
    return keep_first(both, [key], ["_source_order", seq]).drop("_source_order")


def first_nonempty(df: DataFrame, priority: str = "priority", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the first source that has any, over all or per key."""
    if keys:
        # a hot key is reduced to its least priority before it is shuffled
        least = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min(priority).alias("_least"))
        same = F.col(priority) == F.col("_least")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        return df.join(least, same, "left_semi")
    least = df.agg(F.min(priority).alias("_least"))
    return df.join(F.broadcast(least), F.col(priority) == F.col("_least")).drop("_least")
