"""Content-addressed media payloads in tar shards, read back by ranges."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Samples in a row of the stored picture; a payload is a positive multiple of it.
WIDTH = 192
PAD = b" "
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and header chunk: all that a metadata read takes.
HEADER_BYTES = 33
TAR_BLOCK = 512
SHARD_BYTES = 256 << 20
CATALOGUE = "digest binary, shard string, offset long, length long, media_sha256 binary"
HEADERS = "digest binary, width int, height int, bit_depth int"
FEATURES = "digest binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"


def file_system(uri: str):
    """The file system of a path or URI, and the path there; executors and driver reach the same files."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def payload(text: str | None) -> bytes:
    """The text's bytes, padded to a positive multiple of WIDTH."""
    raw = (text or "").encode()
    return raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), PAD)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes) -> bytes:
    """The samples as a grey 8-bit PNG picture of WIDTH columns: lossless, and the same for the same samples."""
    rows = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first HEADER_BYTES of a file."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", data[16:25])


def from_png(data: bytes) -> np.ndarray:
    """The samples of a picture that ``to_png`` made, by row; every chunk's checksum is verified."""
    width, height, _ = png_header(data[:HEADER_BYTES])
    at, packed = HEADER_BYTES, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not expected")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, mean and spread of the samples (thousandths), and an average hash over an 8 x 8 grid of means."""
    flat = samples.reshape(-1).astype(np.int64)
    total, squares, n = int(flat.sum()), int((flat * flat).sum()), len(flat)
    spread = (squares * n - total * total) * 1000 // (n * n)
    edges = np.arange(9) * len(samples) // 8
    bands = [samples[min(a, len(samples) - 1) : max(b, min(a, len(samples) - 1) + 1)] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    cells = np.stack([band.reshape(len(band), 8, -1).sum(axis=(0, 2), dtype=np.int64) * 1000 // (len(band) * WIDTH // 8) for band in bands]).reshape(-1)
    bits = sum(1 << k for k, cell in enumerate(cells.tolist()) if cell * n > total * 1000)
    return f"{samples.shape[1]}x{samples.shape[0]};mean={total * 1000 // n};var={spread};ahash={bits:016x}"


def write_shards(df: DataFrame, root: str, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes every different payload to tar shards under ``root``; returns the catalogue (digest, shard, offset, length, media_sha256).

    Tasks write where they read, so no payload is shuffled: an entry is ``<digest>.png``, by the SHA-256 of its samples, once per
    task. Of a payload that several tasks have stored the catalogue names the first; the others are never referenced.
    A task that is tried again writes shards of its own; only those of the attempt that ended well are in the
    catalogue, which is cut from what made it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, base = file_system(root)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        stem, count, out, seen, at, shard = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0, None, set(), 0, ""
        for batch in batches:
            rows = []
            for text in batch.column(0):
                samples = payload(text.as_py())
                key = hashlib.sha256(samples)
                if key.digest() in seen:
                    continue
                seen.add(key.digest())
                if out is None:
                    shard, at = f"shard-{stem}-{count}.tar", 0
                    out, count = files.open_output_stream(f"{base}/{shard}"), count + 1
                data = to_png(samples)
                entry = tarfile.TarInfo(f"{key.hexdigest()}.png")
                entry.size = len(data)
                fill = -len(data) % TAR_BLOCK
                out.write(entry.tobuf(tarfile.USTAR_FORMAT) + data + b"\0" * fill)
                rows.append((key.digest(), shard, at + TAR_BLOCK, len(data), hashlib.sha256(data).digest()))
                at += TAR_BLOCK + len(data) + fill
                if at >= shard_bytes:
                    out.write(b"\0" * 2 * TAR_BLOCK)
                    out.close()
                    out = None
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["digest", "shard", "offset", "length", "media_sha256"])
        if out is not None:
            out.write(b"\0" * 2 * TAR_BLOCK)
            out.close()

    C.text_batches(df.sparkSession)
    stored = C.cut(df.select(F.col(text_col).alias("text")).mapInArrow(run, CATALOGUE))
    first = stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length", "media_sha256")).alias("at"))
    return first.select("digest", "at.*")


def ranges(catalogue: DataFrame, root: str, schema: str, kinds: list, read) -> DataFrame:
    """Rows made by ``read(file, digest, offset, length, media_sha256)`` for each entry, shard by shard in order."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(root)
        name, file = None, None
        for batch in batches:
            rows = []
            for shard, *entry in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, files.open_input_file(f"{base}/{shard}")
                rows.append(read(file, *entry))
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
        if file is not None:
            file.close()

    columns = ["shard", "digest", "offset", "length", "media_sha256"]
    # a number of its own, as few bytes here stand for many in the shards
    tasks = int(catalogue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return catalogue.select(*columns).repartition(tasks, "shard").sortWithinPartitions("shard", "offset").mapInArrow(run, schema)


def headers(catalogue: DataFrame, root: str) -> DataFrame:
    """(digest, width, height, bit_depth), from reads of HEADER_BYTES only."""

    def read(file, digest, offset, length, media_sha256):
        file.seek(offset)
        return (digest, *png_header(file.read(HEADER_BYTES)))

    return ranges(catalogue, root, HEADERS, [pa.binary(), pa.int32(), pa.int32(), pa.int32()], read)


def features(catalogue: DataFrame, root: str) -> DataFrame:
    """Features and digests of the stored bytes as they are read back; damaged ones raise."""

    def read(file, digest, offset, length, media_sha256):
        file.seek(offset)
        data = file.read(length)
        found = hashlib.sha256(data).digest()
        samples = from_png(data)
        flat = samples.tobytes()
        own = hashlib.sha256(flat).digest()
        if found != media_sha256 or own != digest:
            raise ValueError(f"{digest.hex()} is damaged")
        return digest, len(flat), own, zlib.crc32(flat[-16:]), len(data), found, feature(samples)

    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    return ranges(catalogue, root, FEATURES, kinds, read)


def with_media(df: DataFrame, root: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every row's text as a media payload and gives each row its place, metadata and features.

    Equal payloads share one stored file. A null or empty text is one row of padding. Rows that repeat share a
    payload; an empty table gives no rows and writes nothing. Other columns of ``df`` are not read. ``root``: the shards' folder, which
    driver and executors share (a new one in the scratch folder if none is given).

    Returns (id, digest, n_bytes, shard, offset, width, height, bit_depth, and FEATURES).
    """
    root = root or f"{C.scratch(df.sparkSession).rstrip('/')}/media-{uuid.uuid4().hex}"
    catalogue = write_shards(df, root, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text)
    padded = F.greatest(F.lit(WIDTH), F.ceil(size / WIDTH) * WIDTH)
    samples = F.concat(text.cast("binary"), F.repeat(F.lit(PAD.decode()), (padded - size).cast("int")).cast("binary"))
    rows = df.select(F.col(id_col).alias("__id"), size.cast("long").alias("n_bytes"), F.unhex(F.sha2(samples, 256)).alias("digest"))
    known = catalogue.select("digest", "shard", "offset").join(headers(catalogue, root), "digest").join(features(catalogue, root), "digest")
    return rows.join(known, "digest").withColumnRenamed("__id", id_col)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's payload, as stored and read back."""
    found = with_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    said = {c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")}
    return found.withColumns(said).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
