"""TIFF columns: files of 8-bit samples to one row per page, and back.

Reading walks the chain of image directories, decodes strips or tiles (none,
PackBits, LZW, deflate), undoes horizontal differencing and yields each page's
samples. A null file has no pages; a file that can't be read gives the pages before
the fault and one row with null samples and the error's text; directories that
repeat end the chain. Other columns are not read; an empty table gives no rows.

Texts are stored in one of FORMS (compression, predictor, strips or tiles), which a
checksum of the text picks, so that equal texts are equal files and a table holds
all forms.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, work_path

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: TIFF's codes of tags and the sizes of their types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
KINDS = {1: "B", 3: "H", 4: "I"}

#: Samples in a row, rows in a strip and in a page of a stored payload.
LINE, STRIP_ROWS, PAGE_ROWS = 64, 1024, 16384
#: How a text may be stored: compression, predictor, and the side of a tile (0: strips).
FORMS = [(DEFLATE, 1, 0), (LZW, 1, 0), (PACKBITS, 1, 0), (DEFLATE, 2, 0), (LZW, 1, 32), (DEFLATE, 1, 32)]
#: Samples of one page at most; a directory that claims more is taken as broken.
MOST_SAMPLES = 1 << 30


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size and at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; the width grows one code early."""
    out, words, width = [], [], 9
    last, done = None, 0
    buffer = bits = 0
    fresh = [bytes([k]) for k in range(256)] + [b"", b""]
    for byte in data:
        buffer, bits = ((buffer << 8) | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = (buffer >> bits) & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            words, width, last = fresh[:], 9, None
            continue
        if not words:
            raise ValueError("LZW data without a first clear code")
        if code > len(words) or (last is None and code > 255):
            raise ValueError(f"LZW code {code} is not known yet")
        if last is None:
            word = words[code]
        else:
            word = words[code] if code < len(words) else last + last[:1]
            words.append(last + word[:1])
            if len(words) + 1 >= 1 << width and width < 12:
                width += 1
        out.append(word)
        done += len(word)
        last = word
        if done >= size:
            break
    return b"".join(out)


def to_lzw(data: bytes) -> bytes:
    """The inverse of unlzw; the table starts anew before its codes outgrow 12 bits."""
    out = bytearray()
    buffer, bits, width, after = 256, 9, 9, 258
    table: dict[tuple[int, int], int] = {}
    code = -1
    for byte in data:
        if code < 0:
            code = byte
            continue
        longer = table.get((code, byte))
        if longer is not None:
            code = longer
            continue
        buffer, bits = (buffer << width) | code, bits + width
        if bits >= 1024:
            bits, whole = bits % 8, bits // 8
            out += (buffer >> bits).to_bytes(whole, "big")
            buffer &= (1 << bits) - 1
        table[code, byte] = after
        after += 1
        code = byte
        if after + 1 > 1 << width:  # the reader is one entry behind
            if width < 12:
                width += 1
        if after >= 4094:
            buffer, bits = (buffer << width) | 256, bits + width
            table, width, after = {}, 9, 258
    if code >= 0:
        buffer, bits = (buffer << width) | code, bits + width
        if after + 2 > 1 << width and width < 12:
            width += 1
    buffer, bits = (buffer << width) | 257, bits + width
    return bytes(out) + (buffer << (-bits % 8)).to_bytes((bits + 7) // 8, "big")


_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def to_pack_bits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as two bytes, the rest as literals."""
    out, at = [], 0

    def literal(a, b):
        for k in range(a, b, 128):
            out.append(bytes([min(128, b - k) - 1]))
            out.append(data[k : min(k + 128, b)])

    for run in _RUN.finditer(data):
        literal(at, run.start())
        out.append(bytes([257 - (run.end() - run.start()), data[run.start()]]))
        at = run.end()
    literal(at, len(data))
    return b"".join(out)


def packed(data: bytes, compression: int, level: int = 4) -> bytes:
    if compression == NONE:
        return data
    if compression == DEFLATE:
        return zlib.compress(data, level)
    if compression == PACKBITS:
        return to_pack_bits(data)
    if compression == LZW:
        return to_lzw(data)
    raise ValueError(f"compression {compression} is not known")


def _inflated(data: bytes, size: int) -> bytes:
    """The wanted bytes of a stream, however many it holds; its checksum counts if it ends there."""
    stream = zlib.decompressobj()
    out = stream.decompress(data, max(size, 1))
    if len(out) < size:
        raise ValueError(f"{len(out)} of {size} bytes")
    stream.decompress(stream.unconsumed_tail, 1)
    return out[:size]


def unpacked(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return _inflated(data, size)
    if compression == PACKBITS:
        return unpack_bits(data, size)
    if compression == LZW:
        return unlzw(data, size)
    raise ValueError(f"compression {compression} is not known")


def _directory(file: bytes, e: str, at: int) -> tuple[dict[int, tuple], int]:
    """The tags of the directory at a place, and the place of the next."""
    (n,) = struct.unpack_from(e + "H", file, at)
    tags = {}
    for k in range(n):
        where = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(e + "HHI", file, where)
        if kind in KINDS:
            size = struct.calcsize(KINDS[kind]) * count
            place = where + 8 if size <= 4 else struct.unpack_from(e + "I", file, where + 8)[0]
            if place + size > len(file):
                raise ValueError(f"values of tag {tag} lie outside the file")
            tags[tag] = struct.unpack_from(f"{e}{count}{KINDS[kind]}", file, place)
    return tags, struct.unpack_from(e + "I", file, at + 2 + 12 * n)[0]


def _page(file: bytes, tags: dict[int, tuple]) -> tuple[int, int, int, bytes]:
    def one(tag, default=0):
        return (tags.get(tag) or (default,))[0]

    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    if not width or not height or not samples or width * height * samples > MOST_SAMPLES:
        raise ValueError(f"a page of {width} x {height} x {samples} samples")
    if set(tags.get(BITS, (1,))) != {8}:
        raise ValueError("samples are not of 8 bits")
    if one(PLANAR, 1) != 1 and samples > 1:
        raise ValueError("samples in planes are not known")
    if one(PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"predictor {one(PREDICTOR)} is not known")
    tiled = TILES in tags
    wide, high = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS, height), height))
    if not wide or not high or wide * high * samples > MOST_SAMPLES:
        raise ValueError(f"strips or tiles of {wide} x {high}")
    offsets, sizes = (tags.get(t, ()) for t in ((TILES, TILE_BYTES) if tiled else (STRIPS, STRIP_BYTES)))
    across = -(-width // wide)
    if len(offsets) != len(sizes) or len(offsets) != across * -(-height // high):
        raise ValueError(f"{len(offsets)} strips or tiles with {len(sizes)} sizes don't make the page")
    image = np.zeros((height, width, samples), np.uint8)
    for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        y, x = k // across * high, k % across * wide
        rows = high if tiled else min(high, height - y)
        body = unpacked(file[offset : offset + size], one(COMPRESSION, NONE), rows * wide * samples)
        if len(body) < rows * wide * samples:
            raise ValueError(f"strip or tile {k} is too short")
        block = np.frombuffer(body, np.uint8)[: rows * wide * samples].reshape(rows, wide, samples)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        image[y : y + rows, x : x + wide] = block[: height - y, : width - x]
    return width, height, samples, image.tobytes()


def pages(file: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """Width, height, samples per pixel and samples of each page; ValueError where the file is broken."""
    if file[:4] not in (b"II*\0", b"MM\0*") or len(file) < 8:
        raise ValueError("not a TIFF file")
    e = "<" if file[:2] == b"II" else ">"
    at, seen = struct.unpack_from(e + "I", file, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        try:
            tags, at = _directory(file, e, at)
            page = _page(file, tags)
        except (struct.error, zlib.error) as error:
            raise ValueError(str(error)) from error
        yield page


def _differences(image: np.ndarray) -> np.ndarray:
    return np.diff(image, axis=1, prepend=np.zeros((len(image), 1), np.uint8)).astype(np.uint8)


def written(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS, tile: int = 0, level: int = 4) -> bytes:
    """A file of grey pages, in strips or in square tiles."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for image in images:
        height, width = image.shape
        if tile:
            full = np.pad(image, ((0, -height % tile), (0, -width % tile)))
            blocks = [full[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            blocks = [image[y : y + strip_rows] for y in range(0, height, strip_rows)]
        offsets, sizes = [], []
        for block in blocks:
            body = packed((_differences(block) if predictor == 2 else block).tobytes(), compression, level)
            offsets.append(len(out))
            sizes.append(len(body))
            out += body
        tables = []
        for values in (offsets, sizes):
            tables.append(values[0] if len(values) == 1 else len(out))
            if len(values) > 1:
                out += struct.pack(f"<{len(values)}I", *values)
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        n = len(offsets)
        shape = [(TILE_WIDTH, 4, 1, tile), (TILE_HEIGHT, 4, 1, tile), (TILES, 4, n, tables[0]), (TILE_BYTES, 4, n, tables[1])] if tile else [(STRIPS, 4, n, tables[0]), (ROWS, 4, 1, strip_rows), (STRIP_BYTES, 4, n, tables[1])]
        tags = sorted([(WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor), *shape])
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def text_media(text: bytes) -> bytes:
    """A text's bytes, with bytes 0 up to a positive multiple of LINE, as grey pages of LINE columns."""
    size = max(1, -(-len(text) // LINE)) * LINE
    image = np.zeros(size, np.uint8)
    image[: len(text)] = np.frombuffer(text, np.uint8)
    image = image.reshape(-1, LINE)
    compression, predictor, tile = FORMS[zlib.crc32(text) % len(FORMS)]
    return written([image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)], compression, predictor, tile=tile)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes texts (null: empty) as TIFF files to a work table and reads it back: id, n_bytes, media."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t.encode() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(list(map(text_media, texts)), pa.binary())], names=["id", "n_bytes", "media"])

    files = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")
    path = work_path(df.sparkSession, "media")
    files.write.option("compression", "uncompressed").parquet(path)
    return df.sparkSession.read.schema(files.schema).parquet(path)


def read_pages(files: DataFrame, carry: list[str], media_col: str = "media") -> DataFrame:
    """One row per page: the carried columns, file (its place in the partition), page, width, height, samples, pixels, error."""
    kept = [f.simpleString().replace(":", " ", 1) for f in files.select(*carry).schema]

    def run(batches):
        file = 0
        for whole in batches:
            for batch in slices(whole, "media", 8 << 20):
                rows, cells = [], []
                for i, body in enumerate(batch.column("media").to_pylist()):
                    file += 1
                    if body is None:
                        continue
                    done = 0
                    try:
                        for w, h, s, pixels in pages(body):
                            cells.append((file, done, w, h, s, pixels, None))
                            rows.append(i)
                            done += 1
                    except ValueError as error:
                        cells.append((file, done, None, None, None, None, str(error)))
                        rows.append(i)
                at = pa.array(rows, pa.int64())
                columns = list(zip(*cells, strict=True)) or [[]] * 7
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in carry), *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))], names=[*carry, "file", "page", "width", "height", "samples", "pixels", "error"])

    return files.select(*carry, F.col(media_col).alias("media")).mapInArrow(run, ", ".join([*kept, "file long, page int, width int, height int, samples int, pixels binary, error string"]))


def _feature(counts: np.ndarray) -> str:
    n = counts.sum()
    p = counts[counts > 0] / n
    mean = counts @ np.arange(256) / n
    return f"mean={mean:.4f};spread={np.sqrt(counts @ (np.arange(256) - mean) ** 2 / n):.4f};entropy={-(p * np.log2(p)).sum():.4f}"


def text_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores texts as TIFF, reads the pages back, and sums them up per file."""
    files = store_texts(df, id_col, text_col)
    files = files.select("id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        key, rows, kinds = None, [], None

        def close():
            rows.append((*head, size, sha.hexdigest(), zlib.crc32(tail), _feature(counts)))

        def flush():
            arrays = [pa.array(v, k) for v, k in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["id", "n_bytes", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

        for batch in batches:  # a file's pages follow each other
            kinds = [batch.schema.field("id").type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            for i, n, m, s, file, pixels, error in zip(*(batch.column(c).to_pylist() for c in ("id", "n_bytes", "media_bytes", "media_sha256", "file", "pixels", "error")), strict=True):
                if error is not None:
                    raise ValueError(error)
                if file != key:
                    if key is not None:
                        close()
                    key, head, size, sha, tail, counts = file, (i, n, m, s), 0, hashlib.sha256(), b"", np.zeros(256, np.int64)
                size += len(pixels)
                sha.update(pixels)
                tail = pixels[-LINE:]
                counts += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
            yield flush()
            rows.clear()
        if key is not None:
            close()
            yield flush()

    read = read_pages(files, ["id", "n_bytes", "media_bytes", "media_sha256"])
    out = read.mapInArrow(run, f"id {kind}, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
    return out.select(F.col("id").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
