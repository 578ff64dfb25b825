"""Exact deduplication by a tree merge of sorted digest runs (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Runs that one merge of a round brings together.
FAN_IN = 8


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A narrow row for each row of ``df``: its run (the partition it was read in), digest, check and length.

    The digest is SHA-256 of the text without ASCII white space; the check (a second hash and the normalised
    length) verifies it: digests only count as equal together with their checks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        df.select(F.col(id_col).alias("__id"), *C.row_keys(id_col, text_col), F.length(text).cast("long").alias("__chars"), F.regexp_replace(text, C.SPACE, "").alias("__norm"))
        .select("__id", "k1", "k2", "__chars", F.sha2(F.col("__norm"), 256).alias("__digest"), F.xxhash64("__norm").alias("__check"), F.octet_length("__norm").alias("__bytes"))
        .withColumn("__run", F.spark_partition_id())
        .withColumn("__row", F.monotonically_increasing_id())
    )


def tree_merge(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Merges runs of digests in rounds until one is left; returns (digest, check, bytes, best, rows), best first.

    ``runs`` has a row for each (run, digest). In a round, ``fan_in`` neighbouring runs meet: they are dealt out by
    (merged run, digest range), each range of a merged run is sorted, and equal digests next to each other become
    one row that keeps the verified smallest identifier and the sum of the rows. A digest has one row in a run at
    most, so in any round at most ``fan_in`` rows of it meet, however many copies there are. The digest ranges keep
    the last runs spread over all tasks.
    """
    key = ["__digest", "__check", "__bytes"]
    last = runs.agg(F.max("__run")).first()[0] or 0
    while last:
        last //= fan_in
        runs = runs.withColumn("__run", F.floor(F.col("__run") / fan_in).cast("int"))
        dealt = runs.repartition("__run", *key).sortWithinPartitions("__run", *key)
        # grouped as dealt and sorted: rows that follow each other are merged, nothing is moved again
        runs = dealt.groupBy("__run", *key).agg(F.min("__best").alias("__best"), F.sum("__rows").alias("__rows"))
    return runs.select(*key, "__best", "__rows")


def grouped(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The digests with ``__keep`` and ``__size`` of their group, and ``kept``."""
    key = ["__digest", "__check", "__bytes"]
    rows = C.cut(digests(df, id_col, text_col))
    best = F.struct((-F.col("__chars")).alias("less"), F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    runs = C.cut(rows.groupBy("__run", *key).agg(F.min(best).alias("__best"), F.count(F.lit(1)).alias("__rows")))
    found = tree_merge(runs).select(*key, F.col("__best").alias("__keep"), F.col("__rows").alias("__size"))
    # back down the same way: first to each run's row of a digest, then to the rows of that run
    at_runs = runs.select("__run", *key).join(found, key)
    return rows.join(at_runs, ["__run", *key]).withColumn("kept", F.col("__row") == F.col("__keep.row"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds texts that are equal without their ASCII white space.

    Returns a row for each row of ``df``: (id, keep_id, group_size, kept, text_sha256). The row of a group with the
    most code points in its original text stays, then the one with the smallest id (a null id is the largest). A null
    text counts as empty, and empty texts are equal. Of rows that repeat with the same id and text exactly one
    is kept. An empty table gives no rows. Other columns of ``df`` are not read.
    """
    return grouped(df, id_col, text_col).select(
        F.col("__id").alias(id_col),
        F.col("__keep.id").alias("keep_id"),
        F.col("__size").alias("group_size"),
        "kept",
        F.col("__digest").alias("text_sha256"),
    )


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns whatever their names, that stay by ``exact_groups``; nulls, empty texts, rows that repeat and empty tables as there."""
    found = C.cut(grouped(df, id_col, text_col).select("k1", "k2", "kept"))
    return C.keep_rows(df, found.filter("kept").select("k1", "k2"), found, id_col, text_col)


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document of its group that stays."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm
  FROM documents),
g AS (SELECT norm, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
