"""The register fed by a stream: every micro-batch writes its own rows, and a replayed batch changes nothing.

A folder of the register holds deltas (a batch's last row per key), bases (the register as
it stood after a batch) and a log of finished batches. Reading folds the deltas since the
last base into it, one row per key and batch; every COMPACT batches a new base is written,
so that neither a batch nor a reader works on more than its share of the history.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import keep_last
from ..operators.register import UNVERIFIED, ruled
from ..sources.sinks import exists

COMPACT = 16


def _log(spark: SparkSession, path: str) -> tuple[int, int, list[int]]:
    """Numbers of the last batch and of the last base, -1 before the first, and the batches since that base (COMPACT at most)."""
    if not exists(spark, f"{path}/done"):
        return -1, -1, []
    log = spark.read.schema("batch long, base long").json(f"{path}/done")
    last, base = log.agg(F.max("batch"), F.max("base")).first()
    if last is None:
        return -1, -1, []
    since = [r[0] for r in log.where(F.col("batch") > base).select("batch").distinct().orderBy("batch").collect()]
    return last, base, since


def folded(rows: DataFrame, rules: Mapping[str, str], key: str = "unique_key", number: str = "_batch", unverified: Sequence[str] = UNVERIFIED) -> DataFrame:
    """One row per key: its rows in the order of `number`, each merged into what was before by the rules of the register."""
    names = [c for c in rows.columns if c not in (key, number)]
    kinds = dict(rows.dtypes)
    doubt = lambda x: F.coalesce(x["resolution_method"].isin(*unverified), F.lit(False)) if "resolution_method" in names else F.lit(False)

    def merge(acc, x):
        values = [(ruled(rules[c], kinds[c], x[c], acc[c], doubt(x)) if c in rules else x[c]).cast(kinds[c]).alias(c) for c in names]
        return F.struct(x[number].alias(number), *values)

    each = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(number, *names))).alias("_r"))
    nothing = F.struct(F.lit(None).cast(kinds[number]).alias(number), *[F.lit(None).cast(kinds[c]).alias(c) for c in names])
    last = F.aggregate("_r", nothing, merge)
    return each.select(key, last.alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in names])


def _stand(spark: SparkSession, path: str, rules: Mapping[str, str], base: int, since: Sequence[int], key: str) -> DataFrame:
    parts = [spark.read.parquet(f"{path}/base-{base}").withColumn("_batch", F.lit(base).cast("long"))] if base >= 0 else []
    parts += [spark.read.parquet(f"{path}/delta-{k}").withColumn("_batch", F.lit(k).cast("long")) for k in since]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return folded(rows, rules, key) if since else rows.drop("_batch")


def register_version(spark: SparkSession, path: str, rules: Mapping[str, str], key: str = "unique_key") -> tuple[int, DataFrame | None]:
    """Number of the last batch and the register after it; -1 and None before the first."""
    last, base, since = _log(spark, path)
    return (-1, None) if last < 0 else (last, _stand(spark, path, rules, base, since, key))


def apply_batch(path: str, rules: Mapping[str, str], batch: DataFrame, number: int, key: str = "unique_key", seq: str = "seq", seen: Column | None = None) -> None:
    """Adds one batch (last row per key), unless it is done already; writes a new base when COMPACT batches have come since the last."""
    spark = batch.sparkSession
    last, base, since = _log(spark, path)
    if number <= last:
        return
    rows = keep_last(batch, [key], seq)
    rows = rows.withColumn("last_seen_at", seen) if seen is not None else rows
    rows.write.mode("overwrite").parquet(f"{path}/delta-{number}")
    since = [*since, number]
    if len(since) >= COMPACT:
        _stand(spark, path, rules, base, since, key).write.mode("overwrite").parquet(f"{path}/base-{number}")
        base = number
    spark.range(1).select(F.lit(number).cast("long").alias("batch"), F.lit(base).cast("long").alias("base")).coalesce(1).write.mode("append").json(f"{path}/done")


def stream_register(stream: DataFrame, path: str, checkpoint: str, rules: Mapping[str, str], key: str = "unique_key", seq: str = "seq") -> StreamingQuery:
    """Runs over what has landed so far and stops; the next start goes on from the checkpoint."""
    return stream.writeStream.foreachBatch(lambda df, n: apply_batch(path, rules, df, n, key, seq)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
