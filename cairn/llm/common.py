"""What several operators share: lineage cuts, skew-safe running sums, seeded hashes."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, or the folder already set for checkpoints. Where neither is
    there, one is made, but only for a local master: on a cluster a machine's own folder would lose what other machines need."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            where = tempfile.mkdtemp(prefix="cairn-")
        context.setCheckpointDir(where)
    return context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()


#: Rows of an Arrow batch where the session has Spark's default, which is made for short rows.
ARROW, DEFAULT_ROWS, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def text_batches(spark: SparkSession) -> None:
    """Texts are long: Python workers get a thousand rows at a time, unless the session has a number of its own."""
    if spark.conf.get(ARROW) == DEFAULT_ROWS:
        spark.conf.set(ARROW, TEXT_ROWS)


#: Narrow rows in a file of a checkpoint.
FILE_ROWS = 1 << 14


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a reliable checkpoint, so a lost executor repeats nothing before it. The shuffle files that led to it are removed."""
    scratch(df.sparkSession)
    out = df.checkpoint()
    # of this plan alone: other frames that share steps with ``df`` have shuffles of their own
    df._jdf.queryExecution().toRdd().cleanShuffleDependencies(False)
    return out


def cut_narrow(df: DataFrame) -> DataFrame:
    """``cut`` for narrow rows that may be few in many tasks: computed in all tasks, then kept in a file for each FILE_ROWS rows. A file costs an executor
    four processes on a local file system (chmod of the file and of its checksum), so a table of a few rows shouldn't have hundreds. Until
    the checkpoint is written the rows are cached with their lineage, so a lost executor repeats what it held."""
    scratch(df.sparkSession)
    df.persist()
    rows = df.select("*")  # planned after persist, so it reads what is cached
    try:
        out = rows.coalesce(max(1, -(-rows.count() // FILE_ROWS))).checkpoint()
        made = rows._jdf.queryExecution().toRdd()
    finally:
        df.unpersist()
    # not before: the cleaner stops at what is cached
    made.cleanShuffleDependencies(False)
    return out


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and reread: for wide rows, of which later steps read a few columns."""
    path = f"{scratch(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits of a row's id and text, nulls told apart: rows that agree in both are copies of the same row."""
    parts = [x for c in (id_col, text_col) for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(1), *parts).alias("k1"), F.xxhash64(F.lit(2), *parts).alias("k2")]


def keep_rows(df: DataFrame, kept: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df``, all columns, whose keys are in ``kept`` (k1, k2, each pair once): of rows that repeat the one whose other columns have the smallest hash.

    ``rows`` has (k1, k2) of every row of ``df``. Columns of ``df`` may have any names. Rows that repeat are merged where they were read, before they are shuffled, so one that is a third of the table does no harm.
    """
    times = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("times"))
    kept = cut_narrow(kept.select("k1", "k2").join(times, ["k1", "k2"]))
    keyed = df.select(*row_keys(id_col, text_col), F.struct(*[column(c) for c in df.columns]).alias("row"))
    out = keyed.join(kept.filter("times = 1").select("k1", "k2"), ["k1", "k2"]).select("row.*")
    again = kept.filter("times > 1").select("k1", "k2")
    if again.limit(1).count():
        met = cut(keyed.join(again, ["k1", "k2"], "left_semi"))
        one = met.withColumn("bits", F.xxhash64("row")).groupBy("k1", "k2").agg(F.min_by("row", "bits").alias("row"))
        out = out.union(one.select("row.*"))
    return out


def bucket_count(rows: int) -> int:
    """Buckets so that both their number and their size grow with the square root of the rows."""
    return max(1, int(math.sqrt(rows) / 4))


def seeded(seed: int, *cols: str) -> Column:
    """53 pseudorandom bits of the given columns, as a non-negative long."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]), 11)


def bucket_of(bits53: Column, buckets: int) -> Column:
    """A bucket for ``seeded`` bits that grows with them, so that order by bucket and bits is order by bits."""
    return F.floor(bits53 / F.lit(float(2**53)) * F.lit(buckets)).cast("int")


def nullable_key(name: str) -> Column:
    """A string key that is never null; by code point null comes last."""
    return F.when(F.col(name).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(name).cast("string")))


def before(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str, total: str | None = None, extra: DataFrame | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``keys`` that come earlier by ``bucket`` and ``order``.

    Two levels: a window inside each (keys, bucket), and a window over the buckets' sums. No task gets more than
    one bucket of a key, so a key that holds a third of all rows does no harm. ``keys`` must not be null.
    With ``total``, that column gets the sum over all rows of the keys. ``extra`` has a row for each of the keys, whose
    columns are added: it meets the buckets' sums, not the rows. Sums are longs.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy(bucket)
    sums = (
        df.groupBy(*keys, bucket)
        .agg(F.sum(value).alias("__sum"))
        .withColumn("__base", F.coalesce(F.sum("__sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__all", F.sum("__sum").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .drop("__sum")
    )
    if extra is not None:
        sums = sums.join(extra, keys)
    local = df.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = local.join(sums, [*keys, bucket]).withColumn(out, F.col("__in") + F.col("__base"))
    if total:
        joined = joined.withColumn(total, F.col("__all"))
    return joined.drop("__in", "__base", "__all")
