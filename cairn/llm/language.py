"""Language identification by rank-order profiles of frequent n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Most frequent n-grams of a document and of a language; labelled documents per language that profiles are learned from, at most.
DOCUMENT_GRAMS, PROFILE_GRAMS, SAMPLE_DOCS = 300, 400, 2000
#: Up to so many languages their counts are broadcast; more meet the rows by a shuffle.
MOST_LANGS = 10_000
#: Documents and characters that are counted together: both bound memory.
CHUNK_DOCS, CHUNK_CHARS = 1 << 12, 1 << 18
#: Entries of a table of documents by languages.
TABLE = 1 << 21
UNKNOWN = "und"
POINT, EDGE = np.uint64(21), 1


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, n-gram, count) of all 1- to 3-grams, by text, then n-gram.

    Texts are lower-cased; other characters than letters part words, whose edges count as a character of their own (EDGE). An
    n-gram is a number with 21 bits a character.
    """
    lowered = [t.lower() for t in texts]
    line = " " + "".join(t + " " for t in lowered)
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = [len(t) + 1 + (not k) for k, t in enumerate(lowered)]
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
    points = np.where(letters()[np.minimum(points, 0x10FFFF)], points, 0)
    known, code = np.unique(points, return_inverse=True)
    if known[0]:
        known, code = np.append(np.uint32(0), known), code + 1
    code = code.astype(np.uint64)
    keep = (code > 0) | np.append(True, code[:-1] > 0) | np.append(True, owner[1:] != owner[:-1])
    code, owner = code[keep], owner[keep]
    bits = np.uint64(max(1, int(len(known) - 1).bit_length()))
    a, b = code[:-1], code[1:]
    pair_of = np.where(a > 0, owner[:-1], owner[1:])
    pairs = (a > 0) | (b > 0)
    middle = (code[1:-1] > 0) & (owner[:-2] <= owner[1:-1])
    grams = [code[code > 0], ((a << bits) | b)[pairs], ((a[:-1] << bits | b[:-1]) << bits | b[1:])[middle]]
    owners = [owner[code > 0], pair_of[pairs], owner[1:-1][middle]]
    # the n-gram's length goes first, as the edge's code is 0
    width = np.uint64(3) * bits + np.uint64(2)
    if int(width) + len(texts).bit_length() > 64 and len(texts) > 1:  # too many different letters to count so many texts at once
        half = len(texts) // 2
        (o1, g1, n1), (o2, g2, n2) = gram_counts(texts[:half]), gram_counts(texts[half:])
        return np.concatenate([o1, o2 + half]), np.concatenate([g1, g2]), np.concatenate([n1, n2])
    key = np.concatenate([(o << width) | (np.uint64(n) << (np.uint64(3) * bits)) | g for n, g, o in zip((1, 2, 3), grams, owners, strict=True)])
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    mask, size = (np.uint64(1) << bits) - np.uint64(1), (key >> (np.uint64(3) * bits)) & np.uint64(3)
    wide = known.astype(np.uint64)
    wide[0] = EDGE
    parts = [np.where(size > k, wide[(key >> np.uint64(k * int(bits))) & mask], np.uint64(0)) for k in range(3)]
    gram = (parts[2] << (POINT + POINT)) | (parts[1] << POINT) | parts[0]
    return (key >> width).astype(np.int64), gram, count


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts that are counted together, with the number of the first."""
    start, size, held = 0, 0, []
    for at, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if size >= CHUNK_CHARS or len(held) >= CHUNK_DOCS:
            yield start, held
            start, size, held = at + 1, 0, []
    if held:
        yield start, held


def ranked(owner: np.ndarray, gram: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, rank) of each owner's ``most`` most frequent n-grams; of equally frequent ones the smaller is first."""
    order = np.lexsort((gram, -count, owner))
    owner, gram = owner[order], gram[order]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    rank = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    top = rank < most
    return owner[top], gram[top], rank[top]


def held_out(id_col: str) -> Column:
    """Documents that are never learned from: a fifth by CRC-32 of the id as text; and those without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, profile_grams: int = PROFILE_GRAMS, seed: int = 17) -> dict[str, list[int]]:
    """The most frequent n-grams of each language, most frequent first.

    Learns from whole texts of ``sample_docs`` rows per language at most, chosen by a seeded hash of the id, with a text
    and a language and not held out. Empty if there are none.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(~held_out("id") & F.col("text").isNotNull() & F.col("lang").isNotNull()).withColumn("bits", C.seeded(seed, "id"))
    counts = C.cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    # a threshold first, so that few texts are moved; then exactly the smallest
    few = counts.limit(MOST_LANGS + 1).count() <= MOST_LANGS
    likely = rows.join(F.broadcast(counts) if few else counts, "lang").filter(F.col("bits") * F.col("n").cast("double") <= F.lit(2.0**53 * (1.5 * sample_docs + 50)))
    first = Window.partitionBy("lang").orderBy("bits", "id")
    sample = likely.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= sample_docs).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                for _, some in chunks([t for k, t in zip(langs, texts, strict=True) if k == lang]):
                    _, gram, n = gram_counts(some)
                    grams, at = np.unique(gram, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(np.bincount(at, n, len(grams)).astype(np.int64))], ["lang", "gram", "n"])

    C.text_batches(df.sparkSession)
    totals = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    out: dict[str, list[int]] = {}
    for row in totals.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= profile_grams).orderBy("lang", "rank").collect():
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


def predictor(profiles: dict[str, list[int]], document_grams: int = DOCUMENT_GRAMS):
    """A function from texts to (language, score): the nearest profile by out-of-place distance."""
    langs = sorted(profiles)
    worst = max(map(len, profiles.values()), default=0)
    # for each n-gram the languages that have it and its rank there: as many entries as the profiles have
    gram_of = np.array([g for lang in langs for g in profiles[lang]], dtype=np.uint64)
    lang_of = np.repeat(np.arange(len(langs)), [len(profiles[lang]) for lang in langs])
    rank_of = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(profiles[lang])) for lang in langs]])
    order = np.argsort(gram_of, kind="stable")
    gram_of, lang_of, rank_of = gram_of[order], lang_of[order], rank_of[order]

    def saved(doc: np.ndarray, gram: np.ndarray, rank: np.ndarray, docs: int) -> np.ndarray:
        """(docs, languages): how far each distance is below that of a text without a common n-gram."""
        low, high = np.searchsorted(gram_of, gram), np.searchsorted(gram_of, gram, side="right")
        size = high - low
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        less = worst - np.minimum(np.abs(rank_of[at] - np.repeat(rank, size)), worst)
        return np.bincount(np.repeat(doc, size) * len(langs) + lang_of[at], less, docs * len(langs)).reshape(docs, len(langs))

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not langs:
            return names, scores
        for start, some in chunks(texts):
            owner, gram, rank = ranked(*gram_counts(some), document_grams)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
            ends = np.append(first[1:], len(owner)).astype(np.int64)
            step = max(1, TABLE // len(langs))
            for a in range(0, len(first), step):
                b = min(a + step, len(first))
                rows, size = slice(first[a], ends[b - 1]), ends[a:b] - first[a:b]
                less = saved(np.repeat(np.arange(b - a), size), gram[rows], rank[rows], b - a)
                best = less.argmax(axis=1)
                near = 1.0 - (size * worst - less[np.arange(b - a), best]) / (size * worst)
                for k, doc in enumerate(owner[first[a:b]]):
                    names[start + doc], scores[start + doc] = langs[best[k]], float(near[k])
        return names, scores

    return predict


def identify(df: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``df`` with the predicted language of each row's whole text and a score from 0 (no n-gram in place) to 1 (all).

    A text that is null or has no letter is ``und`` with score 0, and so is any if there are no profiles. At equal
    distance the language first by name wins. Columns of ``df`` with the names of the new ones are replaced.
    """
    C.text_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in (lang_out, score_out)]
    at = kept.index(text_col)
    # one column of all, as names may be such that they can't be told apart from paths
    rows = df.select(F.struct(*[C.column(c) for c in kept]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(profiles)
        for batch in batches:
            names, scores = predict(batch.column(0).field(at).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["row", "lang", "score"])

    new = [T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]
    found = rows.mapInArrow(run, T.StructType([*rows.schema.fields, *new]))
    return found.select("row.*", F.col("lang").alias(lang_out), F.col("score").alias(score_out))


def accepted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df``, all columns whatever their names, whose text is in a language that its own labels teach. Texts that are null or have no letter (``und``) go, and all rows go
    if no label teaches a language; a text in another language is given the nearest one that is taught and stays. Rows that repeat stay; an empty table gives none."""
    lang, score = C.fresh(df, "lang_pred"), C.fresh(df, "score")
    found = identify(df, learn(df, id_col, text_col, lang_col), text_col, lang, score)
    return found.filter(C.column(lang) != UNKNOWN).drop(lang, score)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
