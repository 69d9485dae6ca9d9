"""Helpers shared by the corpus operators: inputs, work tables, summed vectors."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBC = ctypes.CDLL(None)

ROOT = Path(__file__).resolve().parents[2]

#: Entries in one block of a summed vector.
BLOCK = 4096
VECTOR_SCHEMA = "name string, blk int, body binary"


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers that do not see the repository's folder."""
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or Path.cwd() == ROOT or getattr(sc, "_noticeflow_shipped", False):
        return
    import shutil

    base = Path(tempfile.mkdtemp(prefix="noticeflow-")) / "noticeflow_src"
    sc.addPyFile(shutil.make_archive(str(base), "zip", ROOT, "noticeflow"))
    sc._noticeflow_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a folder of this machine in local mode, and an error on a cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = Path(tempfile.gettempdir(), "noticeflow-work").as_uri()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """Arrow's file system for a shared folder, and the folder's path in it."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if colon and scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    elif scheme == "file" and not rest.startswith("//"):
        uri = f"file://{rest}"
    return fs.FileSystem.from_uri(uri)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a work table and read back: computed once, and safe when executors go."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Runs of the batch whose texts hold about `most` bytes; a longer text stands alone."""
    array = batch.column(column)
    if len(array) == 0:
        return
    ends = np.frombuffer(array.buffers()[1], dtype="<i4" if array.type == pa.string() or array.type == pa.binary() else "<i8", count=len(array) + 1 + array.offset)[array.offset :].astype(np.int64)
    at = 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


def release() -> None:
    """Gives memory that arrays no longer need back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins; nulls count as empty."""
    if array.null_count:
        array = array.fill_null("")
    kind = "<i4" if array.type == pa.string() else "<i8"
    ends = np.frombuffer(array.buffers()[1], dtype=kind, count=len(array) + 1 + array.offset)[array.offset :].astype(np.int64)
    body = array.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[ends[0] : ends[-1]] if body is not None and body.size else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def vector_rows(vectors: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Blocks of the named vectors that hold anything, for `summed`."""
    names, blocks, bodies = [], [], []
    for name, v in vectors.items():
        for k in range(0, len(v), BLOCK):
            part = v[k : k + BLOCK].round().astype("<i8")
            if part.any():
                names.append(name)
                blocks.append(k // BLOCK)
                bodies.append(zlib.compress(part.tobytes(), 1))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(blocks, pa.int32()), pa.array(bodies, pa.binary())], names=["name", "blk", "body"])


def _sum_blocks(batches):
    for batch in batches:
        total: dict[tuple, np.ndarray] = {}
        for name, blk, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            v = np.frombuffer(zlib.decompress(body), dtype="<i8")
            total[name, blk] = total[name, blk] + v if (name, blk) in total else v
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())],
            names=["name", "blk", "body"],
        )


def summed(parts: DataFrame, length: int, most_names: int = 1000) -> dict[str, np.ndarray]:
    """Sums of vectors of a fixed length, added up on the executors; at most `most_names` come to the driver."""
    added = parts.repartition("name", "blk").mapInArrow(_sum_blocks, VECTOR_SCHEMA)
    # one row per name, block and batch
    out: dict[str, np.ndarray] = {}
    for row in added.collect():
        if row["name"] not in out and len(out) >= most_names:
            raise ValueError(f"more than {most_names} names")
        v = np.frombuffer(zlib.decompress(bytes(row["body"])), dtype="<i8")
        out.setdefault(row["name"], np.zeros(length, np.int64))[row["blk"] * BLOCK : row["blk"] * BLOCK + len(v)] += v
    return out


#: Cells of a set of marks, as a power of two, and of one of its blocks; tasks that mark.
MARK_BITS, MARK_BLOCK, MARK_TASKS = 22, 15, 24


def mark_cells(keys: np.ndarray) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def _mark(batches):
    seen = np.zeros(1 << MARK_BITS, bool)
    for batch in batches:
        seen[mark_cells(batch.column(0).to_numpy())] = True
    blocks = np.packbits(seen).reshape(-1, (1 << MARK_BLOCK) // 8)
    full = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([b.tobytes() for b in blocks[full]], pa.binary())], names=["blk", "body"])


def marks(df: DataFrame) -> np.ndarray:
    """Which of 2 ** MARK_BITS cells the column of large integers falls into: half a megabyte from each of MARK_TASKS tasks.

    What isn't marked isn't among the values; with very many values all cells are marked.
    """
    out = np.zeros((1 << (MARK_BITS - MARK_BLOCK), (1 << MARK_BLOCK) // 8), np.uint8)
    for row in df.coalesce(MARK_TASKS).mapInArrow(_mark, "blk int, body binary").collect():
        out[row["blk"]] |= np.frombuffer(bytes(row["body"]), np.uint8)
    return out.reshape(-1)


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cells = mark_cells(keys)
    return (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1


def unsigned_crc(column: str):
    """crc32 of a text's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(F.col(column), F.lit("")).cast("binary"))

