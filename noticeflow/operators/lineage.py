"""Cutting lineage where a table is used several times."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written once to spark.checkpoint.dir, which all executors share.

    Where that is unset: a folder of this machine in local mode, and an error on a cluster.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As cut_lineage, compressed by columns: for long tables whose order and partitions don't count."""
    path = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, rows: int = 1_000_000) -> DataFrame:
    """A table dealt by keys to tasks of about so many rows, where the session's partitions would hold more; the rows are counted first.

    What is sorted or aggregated by these keys afterwards stays in its tasks, whose memory doesn't grow with the table.
    """
    tasks = -(-df.count() // rows)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or Path(tempfile.gettempdir(), "noticeflow-checkpoints").as_uri())
    return context.getCheckpointDir()
