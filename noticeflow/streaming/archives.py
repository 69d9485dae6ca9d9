"""Archives of XML notices as they land: seen once, with limits, failures kept apart for another try."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import exists

MEMBERS, BYTES, RATIO = 2000, 200_000_000, 200.0
LOOKUPS, READS = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.minPartitionNum"
ENTRY = "path string, member string, xml string, error string"


def xml_text(content: bytes) -> str:
    """XML as UTF-8, else in the encoding that it declares, else as Windows Cyrillic."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        said = re.match(rb"""<\?xml[^>]*encoding=["']([A-Za-z0-9._-]+)["']""", content.lstrip())
        try:
            return content.decode(said[1].decode() if said else "cp1251")
        except (LookupError, UnicodeDecodeError):
            return content.decode("cp1251", "replace")


def landed(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of new files, the newest first; the checkpoint remembers which were seen."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("latestFirst", "true").option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(folder)


def unpacked(files: DataFrame, members: int = MEMBERS, size: int = BYTES, ratio: float = RATIO) -> DataFrame:
    """A row per XML member, or one row with an error for a file beyond the limits or broken."""

    def one(path: str, content: bytes):
        if not zipfile.is_zipfile(io.BytesIO(content)):
            return [(path, None, xml_text(content), None)] if content.lstrip()[:1] == b"<" else [(path, None, None, "not_an_archive")]
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                infos = [i for i in z.infolist() if i.filename.lower().endswith(".xml")]
                total = sum(i.file_size for i in infos)
                if len(infos) > members or total > size:
                    return [(path, None, None, "too_large")]
                if total > ratio * max(1, len(content)):
                    return [(path, None, None, "ratio")]
                return [(path, i.filename, xml_text(z.read(i)), None) for i in infos]
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, OSError) as e:
            return [(path, None, None, f"broken: {type(e).__name__}")]

    def run(batches):
        for batch in batches:
            rows = [r for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) for r in one(p, c or b"")]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "member", "xml", "error"])

    return files.select("path", "content").mapInArrow(run, ENTRY)


def start(spark: SparkSession, folder: str, out: str, rejects: str, checkpoint: str, files_per_batch: int = 100, members: int = MEMBERS, size: int = BYTES, ratio: float = RATIO) -> StreamingQuery:
    """Starts a stream that writes the members of all files that have landed; failures go to a table from which `retry` takes them.

    A batch's files are opened once. Its failures are written where it has any, and by the first batch, so that the table is there.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows, seen, failed = unpacked(batch, members, size, ratio).persist(), Observation(), f"{rejects}/batch={number}"
        try:
            rows.observe(seen, F.count("error").alias("errors")).where("error is null").write.mode("overwrite").parquet(f"{out}/batch={number}")
            # a batch that runs again may have left failures that it no longer has
            if number == 0 or seen.get["errors"] or exists(spark, failed):
                rows.where("error is not null").select("path", "error").write.mode("overwrite").parquet(failed)
        finally:
            rows.unpersist()

    return landed(spark, folder, files_per_batch).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def _few_tasks(spark: SparkSession, streams: int) -> Iterator[None]:
    """While streams of small batches run, a batch's files are looked up by a few tasks, not by one each, and read by the stream's share of the cores; more bytes get more tasks."""
    few = {LOOKUPS: "4", READS: str(max(1, spark.sparkContext.defaultParallelism // max(1, streams)))}
    was = {k: spark.conf.get(k, None) for k in few}
    try:
        for k, v in few.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ingest(spark: SparkSession, folder: str, out: str, rejects: str, checkpoint: str, files_per_batch: int = 100, members: int = MEMBERS, size: int = BYTES, ratio: float = RATIO) -> None:
    """Writes the members of all files that have landed, by one stream, and waits for its end."""
    with _few_tasks(spark, 1):
        start(spark, folder, out, rejects, checkpoint, files_per_batch, members, size, ratio).awaitTermination()


def ingest_folders(spark: SparkSession, root: str, names: Sequence[str], out: str, rejects: str, checkpoint: str, files_per_batch: int = 100, members: int = MEMBERS, size: int = BYTES, ratio: float = RATIO) -> None:
    """`ingest` of several folders under root by streams that run side by side, as a batch of few files leaves most cores idle.

    Each stream takes the newest files of its folder first, and has folders of its own under out, rejects and checkpoint. Folders that aren't there yet are left out.
    """
    there = [name for name in names if exists(spark, f"{root}/{name}")]
    queries: list[StreamingQuery] = []
    with _few_tasks(spark, len(there)):
        try:
            for name in there:
                queries.append(start(spark, f"{root}/{name}", f"{out}/folder={name}", f"{rejects}/folder={name}", f"{checkpoint}/{name}", files_per_batch, members, size, ratio))
            for query in queries:
                query.awaitTermination()
        finally:
            for query in queries:
                query.stop()


def retry(spark: SparkSession, rejects: DataFrame, block: int = 1000, members: int = MEMBERS, size: int = BYTES, ratio: float = RATIO) -> Iterator[DataFrame]:
    """Reads all failed files again, a block of paths at a time: members, or the error that they still have.

    The driver holds the paths of one block; the caller writes each block before the next.
    """
    paths = (r["path"] for r in rejects.select("path").distinct().toLocalIterator())
    while part := list(islice(paths, block)):
        yield unpacked(spark.read.format("binaryFile").load(part).select("path", "content"), members, size, ratio)


