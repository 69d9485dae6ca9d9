"""What is written out: notices as JSON, reports, drafts, and versions that are swapped in."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there; any other failure to read is an error."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.format("binaryFile").option("pathGlobFilter", "no-such-file").load(path).schema  # noqa: B018
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def notices_json(df: DataFrame) -> DataFrame:
    """One JSON text per notice: prices that are no finite number become null, times ISO seconds."""
    out = []
    for c, kind in df.dtypes:
        if kind in ("double", "float"):
            bad = F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
            out.append(F.when(~bad, F.col(c)).alias(c))
        elif kind.startswith("timestamp"):
            out.append(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c))
        else:
            out.append(F.col(c))
    return df.select(F.to_json(F.struct(*out), {"ignoreNullFields": "false"}).alias("value"))


def write_notices_json(df: DataFrame, path: str) -> None:
    notices_json(df).write.mode("overwrite").text(path)


def run_report(profile: str, totals: DataFrame, health: DataFrame) -> DataFrame:
    """One nested row: profile, summary, sources."""
    sources = health.agg(F.array_sort(F.collect_list(F.struct("source", "status", "found", "detail"))).alias("sources"))
    return totals.select(F.lit(profile).alias("profile"), F.struct(*totals.columns).alias("summary")).crossJoin(sources)


def write_case_csv(df: DataFrame, path: str, keep: Column, most_rows: int = 50_000) -> None:
    """Rows that satisfy the condition, with semicolons and a header; quotes are doubled, and quoted values may hold line breaks.

    A file with such values is read by one task, so it has no more than `most_rows` rows.
    """
    df.where(keep).write.mode("overwrite").options(sep=";", header=True, quote='"', escape='"', maxRecordsPerFile=most_rows).csv(path)


def _last_version(spark: SparkSession, table: str) -> tuple[int, str | None]:
    if not exists(spark, f"{table}/pointer"):
        return -1, None
    last = spark.read.schema("number long, version string").json(f"{table}/pointer").orderBy(F.desc("number"), F.desc("version")).limit(1).first()
    return (-1, None) if last is None else (last["number"], last["version"])


def publish(df: DataFrame, table: str) -> str:
    """Writes a new version beside the old ones, then points to it by the next number; readers see the old or the new version, never a part."""
    spark, version = df.sparkSession, f"version={uuid.uuid4().hex}"
    number = _last_version(spark, table)[0] + 1
    df.write.parquet(f"{table}/{version}")
    spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(version).alias("version")).coalesce(1).write.mode("append").json(f"{table}/pointer")
    return version


def current(spark: SparkSession, table: str) -> DataFrame:
    """The version that was pointed to last."""
    version = _last_version(spark, table)[1]
    if version is None:
        raise ValueError(f"{table} has no published version")
    return spark.read.parquet(f"{table}/{version}")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Zip files `archive`.zip of their members (archive, member, content) in a folder that all executors share; returns archive, members.

    The name of an archive may begin with folders.
    A file is written by one task, member by member; a task that runs again writes it anew.
    """

    def run(batches):
        import zipfile
        from itertools import groupby

        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        made = set()
        every = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for name, members in groupby(every, key=lambda r: r[0]):
            n, path = 0, f"{root}/{name}.zip"
            if (inner := path.rpartition("/")[0]) not in made:
                system.create_dir(inner, recursive=True)
                made.add(inner)
            with system.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for _, member, content in members:
                    z.writestr(zipfile.ZipInfo(member), content, zipfile.ZIP_DEFLATED)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["archive", "members"])

    ordered = rows.select("archive", "member", F.col("content").cast("binary").alias("content")).repartition("archive").sortWithinPartitions("archive", "member")
    return ordered.mapInArrow(run, "archive string, members long")
