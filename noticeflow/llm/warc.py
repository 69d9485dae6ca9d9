"""WARC archives of pages and their two-level capture index.

Writing makes one record per page, compressed by itself, in files of about ARCHIVE
bytes in a shared folder: a response with its payload, or a revisit that names the
response with the smallest page id among equal payloads. Every record gets a capture
line (key, page id, archive, offset, length); the key is the URL with its host
reversed. Lines sorted by key and page id are cut into blocks, each compressed; the
directory holds each block's first line's key. Reading finds a capture's block by
binary search in the directory, its line by binary search in the block, and then
reads that range of the archive's file, and nothing else of it.

A task names its files by its attempt, and only the attempts that Spark commits have
capture lines: what a lost executor leaves behind is never read. Blocks grow with the
number of lines, so the directory never holds more than BLOCKS entries and may go to
every task. Null html is an empty payload; a null URL has the key `-`; a URL that
can't be split is its own key; rows without a page id are not archived; page ids are
integers; every row is a record, so rows that repeat a page id are captures of their
own, and those of the smallest page id with a payload are all responses; an empty
table gives no archives; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, slices, stored, work_path

#: Bytes of an archive, and of the stretch of it that one group of range reads covers.
ARCHIVE, STRETCH = 64 << 20, 1 << 20
#: Bytes that a task reads about.
TASK = 16 << 20
LINES, BLOCKS = 3000, 1 << 16
CAPTURE = "key string, page_id long, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """The URL with its host's labels reversed: com,example,www)/path?query."""
    if url is None:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return quote(url, safe="")
    if not host:
        return quote(url, safe="/?=&:")
    usual = {"http": 80, "https": 443}.get(parts.scheme)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != usual else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(key, safe="!$%&'()*+,-./:;=?@_~")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _packed(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None) -> bytes:
    """One record, compressed."""
    kind = "response" if refers_to is None else "revisit"
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url is not None else "-"), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}")]
    if refers_to is None:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        body = b"HTTP/1.1 200 OK\r\n\r\n"
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Refers-To-Target-URI", quote(refers_url, safe="!#$%&'()*+,/:;=?@[]~") if refers_url is not None else "-")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return _packed("WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n")


def parsed(packed: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and payload."""
    data = zlib.decompress(packed, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def write(pages: DataFrame, least_revisit: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive: int = ARCHIVE) -> tuple[str, DataFrame]:
    """Writes the archives; returns their folder and the captures: key, page_id, archive, offset, length."""
    html = F.coalesce(html_col, F.lit(""))
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    light = rows.where(F.octet_length("html") >= least_revisit).select("page_id", "url", "digest")
    firsts = light.groupBy("digest").agg(F.min_by("url", F.struct("page_id", "url")).alias("refers_url"), F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    again = light.select("page_id", "digest").join(stored(firsts, "payloads"), "digest").where("page_id > refers_to").distinct()
    planned = rows.join(stored(again, "revisits"), ["page_id", "digest"], "left")
    folder = work_path(pages.sparkSession, "warc")

    def run(batches):
        from pyspark import TaskContext

        files, top = filesystem(folder)
        files.create_dir(top)
        task, number, out, at = TaskContext.get(), 0, None, 0
        for whole in batches:
            for batch in slices(whole, "html"):
                rows = []
                for page, url, text, to, to_url in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "refers_url")), strict=True):
                    if out is None:
                        name, at = f"{task.partitionId():06d}-{number:06d}-{task.taskAttemptId()}.warc.gz", 0
                        out, number = files.open_output_stream(f"{top}/{name}", compression=None), number + 1
                    packed = record(page, url, text.encode(), to, to_url)
                    out.write(packed)
                    rows.append((url_key(url), page, name, at, len(packed)))
                    at += len(packed)
                    if at >= archive:
                        out.close()
                        out = None
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "page_id", "archive", "offset", "length"])
        if out is not None:
            out.close()

    return folder, stored(planned.select("page_id", "url", "html", "refers_to", "refers_url").mapInArrow(run, CAPTURE), "captures")


class Index:
    """Blocks of capture lines (a table) and the directory of their first keys (sorted, at most BLOCKS)."""

    def __init__(self, captures: DataFrame, lines: int = LINES):
        captures = captures.select("key", "page_id", "archive", "offset", "length")
        most = max(lines, -(-captures.count() // (BLOCKS // 2)))

        def run(batches):
            from pyspark import TaskContext

            number, rows, first = TaskContext.get().partitionId() << 32, [], None

            def close():
                nonlocal number, rows
                row = pa.RecordBatch.from_pylist([{"block": number, "key": first[0], "page_id": first[1], "body": zlib.compress("\n".join(rows).encode(), 6)}], schema=schema)
                number, rows = number + 1, []
                return row

            schema = pa.schema([("block", pa.int64()), ("key", pa.string()), ("page_id", pa.int64()), ("body", pa.binary())])
            last = None
            for batch in batches:
                for key, page, archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if len(rows) >= most and (key, page) != last:  # equal captures stay in one block
                        yield close()
                    if not rows:
                        first = (key, page)
                    last = (key, page)
                    rows.append(f"{key}\t{page}\t{archive}\t{offset}\t{length}")
            if rows:
                yield close()

        ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "archive", "offset")
        self.blocks = stored(ordered.mapInArrow(run, "block long, key string, page_id long, body binary"), "blocks")
        self.directory = sorted((r["key"], r["page_id"], r["block"]) for r in self.blocks.select("key", "page_id", "block").collect())

    def find(self, pages: DataFrame) -> DataFrame:
        """Captures of (page_id, url): page_id, archive, offset, length."""
        keys, numbers = [d[:2] for d in self.directory], [d[2] for d in self.directory]

        def to_block(batches):
            for batch in batches:
                wanted = [(url_key(u), p) for p, u in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                at = [bisect_right(keys, w) - 1 for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([numbers[k] if k >= 0 else None for k in at], pa.int64()), pa.array([w[0] for w in wanted], pa.string()), pa.array([w[1] for w in wanted], pa.int64())], names=["block", "key", "page_id"])

        def in_block(batches):
            for batch in batches:
                rows = []
                for body, wanted in zip(batch.column("body").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                    lines = [(k, int(p), a, int(o), int(n)) for k, p, a, o, n in (x.split("\t") for x in zlib.decompress(body).decode().split("\n"))]
                    for w in wanted:
                        k = bisect_left(lines, (w["key"], w["page_id"]))
                        while k < len(lines) and lines[k][:2] == (w["key"], w["page_id"]):
                            rows.append(lines[k])
                            k += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())], names=["page_id", "archive", "offset", "length"])

        # a block is asked for no more different captures than it has lines
        wanted = pages.select("page_id", "url").mapInArrow(to_block, "block long, key string, page_id long").where("block is not null").distinct()
        wanted = wanted.groupBy("block").agg(F.collect_list(F.struct("key", "page_id")).alias("wanted"))
        return wanted.join(self.blocks.select("block", "body"), "block").select("wanted", "body").mapInArrow(in_block, "page_id long, archive string, offset long, length long")


def read(folder: str, captures: DataFrame, payloads: bool = False) -> DataFrame:
    """Range reads of captures: page_id, record_type, payload_bytes, payload_digest, refers_to, and the payload if asked for."""
    names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if payloads else [])]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def run(batches):
        files, top = filesystem(folder)
        name, file, rows, size = None, None, [], 0
        for batch in batches:
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != name:
                    name, file = archive, files.open_input_file(f"{top}/{archive}")
                head, payload = parsed(file.read_at(length, offset))
                whole = head["WARC-Type"] == "response"
                to = None if whole else int(head["WARC-Refers-To"][len("<urn:page:") : -1])
                digest = payload_digest(payload) if whole else head["WARC-Payload-Digest"].removeprefix("sha1:")
                rows.append((int(head["WARC-Record-ID"][len("<urn:page:") : -1]), head["WARC-Type"], len(payload) if whole else None, digest, to, payload)[: len(names)])
                size += len(payload)
                if len(rows) >= 10_000 or payloads and size >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    # ranges of one stretch of a file are read by one task, in their order; tasks by the bytes to read, not by those of the ranges
    ranges = captures.select("archive", "offset", "length")
    tasks = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(ranges.agg(F.sum("length")).first()[0] or 0) // TASK))
    ordered = ranges.repartition(tasks, "archive", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(run, "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long" + (", payload binary" if payloads else ""))


def archived(pages: DataFrame, least_revisit: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive: int = ARCHIVE) -> DataFrame:
    """Archives all pages, then reads every page's captures through the index.

    A revisit's payload is that of the response it names; it is an error if there is none of its digest.
    """
    folder, captures = write(pages, least_revisit, id_col, url_col, html_col, archive)
    asked = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    got = stored(read(folder, stored(Index(captures).find(asked), "ranges")), "records")
    again = got.where("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers_to")
    needed = again.select("refers_to", "payload_digest").distinct()
    whole = got.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("_bytes")).join(needed, ["refers_to", "payload_digest"], "left_semi").distinct()
    again = again.join(whole, ["refers_to", "payload_digest"], "left")
    size = F.when(F.col("_bytes").isNull(), F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.col("page_id")))).otherwise(F.col("_bytes"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    out = got.where("record_type = 'response'").select(*names).union(again.select("page_id", size.cast("long"), "payload_digest", "record_type", "refers_to"))
    return out.withColumnRenamed("page_id", id_col)
