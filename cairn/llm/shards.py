"""Sharding by proportional stratified interleaving (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C


def interleave(df: DataFrame, shards: int = 8, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Deals all rows into ``shards`` so that each shard has the corpus's mixture of sources.

    Rows are shuffled by a seeded hash and ranked within their source; row r of n gets the fractional rank
    (r + u) / n, where u (0 to 1) is a seeded hash of the source: so sources of few rows don't all fall on the same fractions, however many
    there are. All rows sorted by it are cut into shards whose row counts differ by one at most, and a source's
    rows up to any fraction are its share of them, less than one row more or less.

    Returns (id, size, text_crc32, source, fraction, shard, slot): ``size`` is the text's bytes plus 1, slots run
    from 0 in each shard. A null text has no bytes (CRC 0). Null is a source of its own. Rows that repeat get
    places of their own. An empty table gives no rows. Other columns of ``df`` are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("__id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("__size"),
        F.crc32(text.cast("binary")).alias("__crc"),
        F.col(source_col).alias("__source"),
        C.nullable_key(source_col).alias("__key"),
    )
    rows = C.cut(rows.withColumn("__bits", C.seeded(seed, "__id", "__crc", "__key")).withColumn("__one", F.lit(1).cast("long")))
    n = rows.count()
    buckets = C.bucket_count(n)
    rows = rows.withColumn("__bucket", C.bucket_of(F.col("__bits"), buckets))
    ranked = C.before(rows, ["__key"], "__bucket", ["__bits", "__id", "__crc"], "__one", "__rank", "__n")
    offset = C.seeded(seed + 1, "__key") / F.lit(float(2**53))
    ranked = ranked.withColumn("__fraction", (F.col("__rank") + offset) / F.col("__n").cast("double"))
    bucket = F.least(F.floor(F.col("__fraction") * buckets), F.lit(buckets - 1)).cast("int")
    ranked = C.cut(ranked.withColumn("__bucket", bucket).withColumn("__every", F.lit(0)))
    placed = C.before(ranked, ["__every"], "__bucket", ["__fraction", "__key", "__bits", "__id", "__crc"], "__one", "__place")
    last = F.lit(max(n, 1)).cast("long")
    shard = F.floor(F.col("__place") * shards / last) if n * shards < 2**52 else F.expr(f"(__place * {shards}L) div {n}L")
    placed = placed.withColumn("__shard", shard.cast("int"))
    first = F.floor((F.col("__shard") * last + (shards - 1)) / F.lit(shards)) if n * shards < 2**52 else F.expr(f"(__shard * {n}L + {shards - 1}L) div {shards}L")
    return placed.select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.col("__source").alias("source"),
        F.col("__fraction").alias("fraction"),
        F.col("__shard").alias("shard"),
        (F.col("__place") - first).cast("long").alias("slot"),
    )


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by the law of rows."""
    placed = interleave(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
