"""Substring deduplication: fixed-block anchors, rolling probes, extension to maximal exact repeats."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Words of a window that must repeat; words of an anchor block. Any window holds a whole block of any text: 2 x 18 - 1 <= 35.
WINDOW, BLOCK = 35, 18
#: Words hashed together in a task, and hashes that meet in a slice: both bound memory.
BATCH_WORDS, SLICE_HASHES = 1 << 20, 1 << 21
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
KEY = ["k1", "k2"]
PACKED = "slice int, batch long, keys binary, places binary, k1 binary, k2 binary, starts binary, same binary"
LOCATED = "batch long, places binary, k1 binary, k2 binary, starts binary, same binary"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= BASE
        out += words[k : n + k]
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(29)
    return out


def window_digests(words: list[bytes], starts: np.ndarray, size: int) -> np.ndarray:
    """128 bits, as two numbers, of the words themselves of the windows at ``starts``: (len(starts), 2)."""
    from xxhash import xxh3_128_digest

    line = b" ".join(words)
    edges = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    places = zip(edges[starts].tolist(), (edges[starts + size] - 1).tolist(), strict=True)
    return np.frombuffer(b"".join(xxh3_128_digest(line[a:b]) for a, b in places), dtype=np.uint64).reshape(-1, 2)


def order_of(keys: np.ndarray) -> np.ndarray:
    """The order of rows of numbers."""
    return np.argsort(keys[:, 0]) if keys.shape[1] == 1 else np.lexsort(keys.T[::-1])


def firsts(keys: np.ndarray) -> np.ndarray:
    """Where a run of equal rows starts."""
    return np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else np.zeros(0, np.int64)


def spread(n: int, starts: np.ndarray, back: int, ahead: int) -> np.ndarray:
    """A mask of n places that is set from ``back`` before to ``ahead`` after (exclusive) each of ``starts``."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, np.maximum(starts - back, 0), 1)
    np.add.at(change, np.minimum(starts + ahead, n), -1)
    return np.cumsum(change[:n]) > 0


def planes(values: np.ndarray) -> bytes:
    """The values' bytes plane by plane, so that a shuffle's compression finds the high ones, which are zero or alike."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T.copy().view(kind).reshape(-1)


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, rows of numbers; those of 32 bits by their differences."""
    return planes(np.diff(keys[:, 0], prepend=keys.dtype.type(0))) if keys.itemsize == 4 else planes(np.ascontiguousarray(keys).reshape(-1))


def unpacked_keys(data: bytes, kind: type) -> np.ndarray:
    keys = from_planes(data, kind)
    return np.cumsum(keys, dtype=kind)[:, None] if np.dtype(kind).itemsize == 4 else keys.reshape(-1, 2)


def packer(size: int, slices: int, anchored: bool) -> Callable:
    """Hashes windows of ``size`` words and deals them, packed, to ``slices`` by hash.

    Takes batches (k1, k2, text) or, not ``anchored``, (k1, k2, text, places): then only windows of ``size`` words that
    contain an anchor at one of the places count, and their keys are 128 bits made of the words themselves: hashes of hashes only find candidates. Documents are gathered to BATCH_WORDS words. For each slice a batch
    gives one row with a hash's key and one of its places; further places of the same hash stay in the batch's own row (``same``),
    so a passage that very many documents share gives each slice one entry per batch only. A place is
    a word's number in the batch, followed by two bits: it occurs again in the batch; one of its occurrences is an anchor block.
    """

    def emit(held: list[tuple], ordinal: list[int]) -> pa.RecordBatch:
        from xxhash import xxh64_intdigest

        lengths = np.array([h[2] for h in held], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        k1, k2 = np.array([h[0] for h in held], dtype=np.int64), np.array([h[1] for h in held], dtype=np.int64)
        batch = xxh64_intdigest(k1.tobytes() + k2.tobytes(), ordinal[0]) >> 2
        ordinal[0] += 1
        if anchored:
            place = np.concatenate([np.arange(s, max(s, s + n - size + 1)) for s, n in zip(starts, lengths, strict=True)])
            key = window_hashes(np.concatenate([h[3] for h in held]), size)[place][:, None]
        else:
            place = np.concatenate([s + h[4] for s, h in zip(starts, held, strict=True)])
            key = np.concatenate([h[3] for h in held])
        slot = ((key[:, 0] >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
        if anchored:  # 32 bits beside the slice's number are enough to find candidates
            key = (slot[:, None] << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))
        order = order_of(key)
        key, slot, place = key[order], slot[order], place[order].astype(np.uint32)
        first = firsts(key)
        count = np.diff(np.append(first, len(key)))
        anchor = np.ones(len(key), dtype=bool)
        if anchored:
            owner = np.repeat(starts, np.maximum(lengths - size + 1, 0))[order]
            anchor = (place - owner) % BLOCK == 0
        some = np.logical_or.reduceat(anchor, first) if len(first) else np.zeros(0, bool)
        mark = (place[first] << np.uint32(2)) | ((count > 1).astype(np.uint32) << np.uint32(1)) | some.astype(np.uint32)
        again = np.ones(len(key), dtype=bool)
        again[first] = False
        same = np.stack([np.repeat(place[first], count)[again], place[again]])
        kept = key[first].astype(np.uint32) if anchored else key[first]
        edges = np.flatnonzero(np.append(True, np.diff(slot[first]) != 0)) if len(first) else np.zeros(0, np.int64)
        ends = np.append(edges[1:], len(first)).astype(np.int64)
        rows = [(int(slot[first[a]]), batch, packed_keys(kept[a:b]), planes(mark[a:b]), None, None, None, None) for a, b in zip(edges, ends, strict=False)] if len(first) else []
        rows.append((batch % slices, batch, None, None, k1.tobytes(), k2.tobytes(), starts.tobytes(), same.tobytes()))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
        names = ["slice", "batch", "keys", "places", "k1", "k2", "starts", "same"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, ordinal = [], 0, [0]
        for batch in batches:
            for scalars in zip(*batch.columns, strict=True):  # a row at a time: texts are long
                row = [v.as_py() for v in scalars]
                words = words_of(row[2])
                if len(words) < WINDOW:
                    continue
                if anchored:
                    held.append((row[0], row[1], len(words), word_hashes(words)))
                else:
                    mask = spread(len(words), np.frombuffer(row[3], dtype=np.uint32).astype(np.int64), WINDOW - BLOCK, 1)
                    starts = np.flatnonzero(mask[: len(words) - size + 1])
                    held.append((row[0], row[1], len(words), window_digests(words, starts, size), starts))
                total += len(words)
                if total >= BATCH_WORDS:
                    yield emit(held, ordinal)
                    held, total = [], 0
        if held:
            yield emit(held, ordinal)

    return run


def matcher(anchored: bool) -> Callable:
    """Of one slice: the places whose key occurs again, anywhere; for anchors, where one of the occurrences is a block."""
    kind = np.uint32 if anchored else np.uint64
    names = ["batch", "places", "k1", "k2", "starts", "same"]

    def run(table: pa.Table) -> pa.Table:
        batches = table.column("batch").to_numpy()
        keys, places = table.column("keys").to_pylist(), table.column("places").to_pylist()
        filled = [i for i, k in enumerate(keys) if k is not None]
        rows = [(int(batches[i]), None, *(table.column(c)[i].as_py() for c in names[2:])) for i, k in enumerate(keys) if k is None]
        if filled:
            own = [unpacked_keys(keys[i], kind) for i in filled]
            key = np.concatenate(own)
            mark = np.concatenate([from_planes(places[i], np.uint32) for i in filled])
            row = np.repeat(np.array(filled, dtype=np.int32), [len(k) for k in own])
            order = order_of(key)
            key, mark, row = key[order], mark[order], row[order]
            first = firsts(key)
            count = np.diff(np.append(first, len(key)))
            bits = np.bitwise_or.reduceat(mark, first)
            good = ((count > 1) | (bits & 2 > 0)) & (bits & 1 > 0)
            hit = np.repeat(good, count)
            mark, row = mark[hit] >> np.uint32(2), row[hit]
            order = np.argsort(row, kind="stable")
            mark, row = mark[order], row[order]
            edges = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else []
            for a, b in zip(edges, np.append(edges[1:], len(row)).astype(np.int64) if len(row) else [], strict=True):
                rows.append((int(batches[row[a]]), mark[a:b].tobytes(), None, None, None, None))
        kinds = [pa.int64(), *[pa.binary()] * 5]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)})

    return run


def unpack(table: pa.Table) -> pa.Table:
    """Of one batch: (k1, k2, places) of each document that has hits, places counted in its own words."""
    own = {c: next((x.as_py() for x in table.column(c) if x.is_valid), b"") for c in ("k1", "k2", "starts", "same")}
    found = [np.frombuffer(x.as_py(), dtype=np.uint32) for x in table.column("places") if x.is_valid]
    rows = []
    if found:
        hits = np.unique(np.concatenate(found))
        first, again = np.frombuffer(own["same"], dtype=np.uint32).reshape(2, -1)
        hits = np.unique(np.concatenate([hits, again[np.isin(first, hits)]])).astype(np.int64)
        starts = np.frombuffer(own["starts"], dtype=np.int64)
        k1, k2 = np.frombuffer(own["k1"], dtype=np.int64), np.frombuffer(own["k2"], dtype=np.int64)
        owner = np.searchsorted(starts, hits, side="right") - 1
        edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        for a, b in zip(edges, np.append(edges[1:], len(hits)), strict=True):
            at = owner[a]
            rows.append((int(k1[at]), int(k2[at]), (hits[a:b] - starts[at]).astype(np.uint32).tobytes()))
    kinds = [pa.int64(), pa.int64(), pa.binary()]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("k1", "k2", "places"), list(zip(*rows, strict=True)) or [()] * 3, kinds, strict=True)})


def locate(texts: DataFrame, size: int, slices: int, anchored: bool) -> DataFrame:
    """(k1, k2, places): where windows of ``size`` words that occur elsewhere too start, one row for each key at most."""
    packed = texts.mapInArrow(packer(size, slices, anchored), PACKED)
    found = C.cut(packed.groupBy("slice").applyInArrow(matcher(anchored), LOCATED))
    each = found.groupBy("batch").applyInArrow(unpack, "k1 long, k2 long, places binary")
    # rows that repeat have the same key and the same places
    return each.groupBy(*KEY).agg(F.first("places").alias("places"))


def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, places) to (id, n_words, n_removed, spans, text): without the words that the windows at the places cover."""
    for batch in batches:
        n_words, n_removed, spans, texts = [], [], [], []
        for text, places in ((t.as_py(), p.as_py()) for t, p in zip(batch.column(1), batch.column(2), strict=True)):
            words = words_of(text)
            gone = np.zeros(len(words), dtype=bool)
            if places:
                gone = spread(len(words), np.frombuffer(places, dtype=np.uint32).astype(np.int64), 0, WINDOW)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                texts.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
            else:
                spans.append([])
                texts.append(b" ".join(words).decode())
            n_words.append(len(words)), n_removed.append(int(gone.sum()))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.string())], ["id", "n_words", "n_removed", "spans", "text"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_hashes: int = SLICE_HASHES) -> DataFrame:
    """Removes each word covered by a window of 35 words that starts anywhere else too, in the same document or another.

    Non-overlapping blocks of 18 words are the index; every rolling window of 18 words of every document probes it.
    Each hit is extended to the 35-word windows around it, of which those that repeat exactly are kept: together they
    are the maximal exact repeats. Whether a window repeats is judged by 128 bits of its words, never by the hashes that found it. Windows are judged on the input, so all copies of a passage go.

    Returns (id, n_words, n_removed, spans, text) of every row: spans of removed words (from 0, end exclusive), and the
    kept words joined by one space. Null and empty texts have no words. A row that repeats repeats all its windows. An
    empty table gives no rows. Other columns of ``df`` are not read.
    """
    C.text_batches(df.sparkSession)
    docs = df.select(*C.row_keys(id_col, text_col), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    slices = max(1, -(-size // (6 * slice_hashes)))
    anchors = C.cut(locate(docs.select(*KEY, "text"), BLOCK, slices, True))
    met = C.stored(docs.join(anchors, KEY, "left"))
    some = met.filter(F.col("places").isNotNull())
    windows = C.cut(locate(some.select(*KEY, "text", "places"), WINDOW, slices, False))
    again = some.drop("places").join(windows, KEY, "left").select("id", "text", "places")
    rest = met.filter(F.col("places").isNull()).select("id", "text", "places")
    kind = df.select(id_col).schema[0].dataType.simpleString()
    out = f"id {kind}, n_words long, n_removed long, spans array<struct<start: long, end: long>>, text string"
    return rest.mapInArrow(strip, out).unionByName(again.mapInArrow(strip, out)).withColumnRenamed("id", id_col)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words, those removed, and the digest of the rest."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
