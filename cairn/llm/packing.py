"""Best-fit packing of tokenised documents, planned over a histogram of lengths."""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 2048
#: The id behind each document's tokens.
END = 0
#: Ranks of a length that meet their slots under one join key; ranks in one planned interval at most.
RANKS, INTERVAL = 1024, 1 << 22
PIECES = "id {id}, piece int, start long, length int, ids_crc32 long, ids array<int>"


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """The byte-level BPE whose ranks are in ``path``; its ids are those of the tokenizers file with the same vocabulary."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def tokenised(df: DataFrame, tokenizer: tuple[str, str] | None = None, capacity: int = CAPACITY, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids): a row for each piece of at most ``capacity`` tokens.

    A document's tokens are its text's, then END; a null text has only that. Longer ones are cut so that all pieces
    but the first are full. ``ids`` is null without ``keep_ids``. ``tokenizer``: path of the ranks and the pattern.
    """
    C.text_batches(df.sparkSession)
    path, pattern = tokenizer or default_tokenizer()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode_ordinary
        for batch in batches:
            rows: list[tuple] = []
            owner: list[int] = []
            for at, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(END)
                whole = np.array(ids, dtype="<u4")
                start, end = 0, len(ids) % capacity or capacity
                piece = 0
                while start < len(ids):
                    part = whole[start:end]
                    rows.append((piece, start, len(part), crc32(part.tobytes()), part.astype("i4") if keep_ids else None))
                    owner.append(at)
                    start, end, piece = end, end + capacity, piece + 1
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
            arrays = [batch.column(0).take(pa.array(owner, pa.int32()))] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "ids_crc32", "ids"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(pieces, PIECES.format(id=kind))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: intervals (length, from rank, to rank, first sequence, offset).

    A piece of ``length`` whose rank r is in the interval goes to sequence ``first + r - from``, at ``offset``. Open
    sequences are kept as runs of numbers by the room left; one step puts as many pieces as fit into a whole run. The
    work and the plan grow with the number of different lengths and rooms, not with the documents.
    """
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def free(room: int, first: int, count: int) -> None:
        if room:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            each = room // length
            full = min(count, left // each)
            for layer in range(each if full else 0):
                out.append((length, rank, rank + full, first, capacity - room + layer * length))
                rank += full
            left -= full * each
            free(room - each * length, first, full)
            if full < count:
                some = min(left, each)
                for layer in range(some):
                    out.append((length, rank, rank + 1, first + full, capacity - room + layer * length))
                    rank += 1
                left -= some
                if some:
                    free(room - some * length, first + full, 1)
                if rest := count - full - bool(some):
                    free(room, first + full + bool(some), rest)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, seed: int = 13) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (id, piece, start, length, ...): gapless places in sequences of ``capacity``.

    Only the histogram of lengths (``capacity`` rows at most) comes to the driver. Pieces are ranked within their
    length, in two levels so that a frequent length is no task's alone, and take the planned slot of their rank by a join.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    planned = [(n, a, min(a + INTERVAL, b), s + a - r, o) for n, r, b, s, o in plan(histogram, capacity) for a in range(r, b, INTERVAL)]
    slots = spark.createDataFrame(planned or [(0, 0, 1, 0, 0)], "length int, __a long, __b long, __s long, offset long")
    slots = slots.select("*", F.explode(F.sequence(F.floor(F.col("__a") / RANKS), F.floor((F.col("__b") - 1) / RANKS))).alias("__block"))
    rows = pieces.withColumn("__bits", C.seeded(seed, "id", "piece", "ids_crc32")).withColumn("__one", F.lit(1).cast("long"))
    rows = rows.withColumn("__bucket", C.bucket_of(F.col("__bits"), C.bucket_count(sum(histogram.values()))))
    ranked = C.before(rows, ["length"], "__bucket", ["__bits", "id", "piece", "ids_crc32"], "__one", "__rank").withColumn("__block", F.floor(F.col("__rank") / RANKS))
    met = ranked.join(slots, ["length", "__block"]).filter((F.col("__rank") >= F.col("__a")) & (F.col("__rank") < F.col("__b")))
    return met.select(*pieces.columns, (F.col("__s") + F.col("__rank") - F.col("__a")).alias("sequence_id"), "offset")


def pack_documents(df: DataFrame, tokenizer: tuple[str, str] | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenises and packs all rows of ``df``: a row for each piece, with its place.

    A null or empty text is a piece of END alone. Repeated rows are packed as often as they occur. An empty table gives
    no rows. Other columns of ``df`` are not read.
    """
    return pack(C.cut(tokenised(df, tokenizer, capacity, keep_ids, id_col, text_col)), capacity)


def assemble(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed with ``keep_ids``; a sequence holds ``capacity`` tokens at most."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("__parts"))
    return parts.select("sequence_id", F.flatten(F.transform("__parts", lambda p: p["ids"])).alias("ids"))


def packed_columns(packed: DataFrame) -> DataFrame:
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces with their places in sequences."""
    return packed_columns(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
