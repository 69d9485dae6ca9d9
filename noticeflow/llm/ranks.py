"""Places of rows in an order, counted over ranges of the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def positions(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """The rows with `pos` (from 0, in the order, within the group) and `total` (rows of the group).

    Rows are dealt by ranges of (group, order) and numbered within their range; a group's
    ranges are then shifted by the rows of those before. Only counts of ranges meet in one
    window. The rows are read twice, so they should come from a work table; rows that are
    equal in the whole order get places in any order.
    """
    cols = [F.col(group), *order]
    ordered = stored(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id()), name)
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33))
    upto = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ordered.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).withColumn("total", F.sum("_n").over(Window.partitionBy("_g")))
    placed = ordered.join(ranges, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")))
    return placed.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_g", "_p", "_first", "_n", "_before")
