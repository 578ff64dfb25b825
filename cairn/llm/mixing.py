"""Mixing sources to target weights in fixed-length blocks (DataFrame functions only)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Words in a block, slots in an output shard, rounds of the index permutations.
BLOCK_WORDS, SHARD_SLOTS, ROUNDS = 64, 4096, 24
#: Weights by the place of a source in code point order, repeating; the share of all words that the mix takes; the most epochs of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Slots or blocks made from one row at a time; such rows in a task.
CHUNK, CHUNKS_IN_TASK = 4096, 64


@dataclass
class Mix:
    """``rows``: (__row, id, __key, __size, __start, source_size, target) of each row; ``slots``: (__key, epoch, block, shard, slot)."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``weight`` and ``target`` to (__key, source_size): a row for each source, keys in code point order.

    The sources share ``share`` of all words by weight, none more than ``most`` times its size; the excess is shared
    again. That has a level at which each takes the smaller of its cap and weight x level; sorted by cap / weight,
    the level is the largest of (total - caps before) / (weights from here on).
    """
    over, all_rows = Window.orderBy("__key"), Window.partitionBy()
    fit = Window.orderBy("__ratio", "__key")
    place = F.row_number().over(over) - 1
    sized = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    sized = sized.withColumn("__cap", most * F.col("source_size").cast("double")).withColumn("__ratio", F.col("__cap") / F.col("weight"))
    caps = F.coalesce(F.sum("__cap").over(fit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(fit.rowsBetween(0, Window.unboundedFollowing))
    total = share * F.sum("source_size").over(all_rows)
    level = sized.withColumn("__level", (total - caps) / rest)
    level = level.withColumn("__level", F.max("__level").over(all_rows))
    return level.withColumn("target", F.least("__cap", F.col("weight") * F.col("__level"))).select("__key", "source_size", "weight", "target")


def permuted(index: Column, n: Column, seeds: Column) -> Column:
    """The place of ``index`` in a pseudorandom permutation of 0 to n - 1: a swap-or-not network, which needs no table
    and fits any n. ``seeds``: a long for each round. A round pairs x with (seed - x) mod n, and a hash of the pair
    says whether they swap."""

    def round_(x: Column, seed: Column) -> Column:
        other = F.transform(F.array(F.pmod(seed - x, n)), lambda y: F.when(F.xxhash64(seed, F.greatest(x, y)) % 2 == 0, x).otherwise(y))
        return F.element_at(other, 1)

    return F.aggregate(seeds, index, round_)


def seeds_of(seed: int, *what: Column) -> Column:
    """Round seeds of one permutation, small enough that seed - index can't overflow."""
    return F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda r: F.shiftrightunsigned(F.xxhash64(F.lit(seed), r, *what), 2))


def mix(df: DataFrame, seed: int = 11, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> Mix:
    """Plans a mix of all rows' words.

    The words of a source's rows, in seeded order, are one stream cut into blocks of ``block`` words (the last may be
    shorter). The mix has a slot for each block it takes. Which source fills which slot is drawn so that the counts of
    an output shard are multinomial, given that the whole mix meets the targets: the sources' slots are dealt to the
    shards by a pseudorandom permutation of all slots. Slot i of a source takes the block at place i mod n of the
    source's own permutation, a new one for each epoch, so that a block is taken ``most`` times at most and its uses
    differ by one at most. A source's words come to its target within one block.

    A null text has no words, a null source is a source of its own (the last one). Repeated rows are rows like others.
    An empty table, or one without words, gives no slots. Other columns of ``df`` are not read. ``row_col``: a unique
    long of ``df`` to take as the row's number.
    """
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = df.select(
        number.alias("__row"),
        F.col(id_col).alias("__id"),
        C.nullable_key(source_col).alias("__key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(C.WORD)), F.lit(0)).cast("long").alias("__size"),
    )
    rows = C.cut(rows.withColumn("__bits", C.seeded(seed, "__id", "__size")))
    buckets = C.bucket_count(rows.count())
    sources = C.cut(targets(rows.groupBy("__key").agg(F.sum("__size").alias("source_size")), weights, share, most))
    rows = rows.withColumn("__bucket", C.bucket_of(F.col("__bits"), buckets))
    rows = C.cut(C.before(rows, ["__key"], "__bucket", ["__bits", "__id", "__row"], "__size", "__start", extra=sources).drop("__bits", "__bucket", "weight"))

    epochs = F.floor(F.col("target") / F.col("source_size"))
    part = F.floor((F.col("target") - epochs * F.col("source_size")) / block + 0.5)
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    filled = sources.filter("source_size > 0").withColumn("__blocks", blocks).withColumn("__slots", (epochs * blocks + F.least(part, blocks)).cast("long"))
    filled = filled.withColumn("__slots", F.least(F.col("__slots"), F.col("__blocks") * most))
    filled = filled.withColumn("__first", F.coalesce(F.sum("__slots").over(Window.orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    filled = filled.withColumn("__total", F.sum("__slots").over(Window.partitionBy())).filter("__slots > 0")
    chunks = filled.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__slots") - 1) / CHUNK).cast("long"))).alias("__chunk"))
    chunks = chunks.withColumn("__all_seeds", seeds_of(seed, F.lit("slots"))).withColumn("__seeds", F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: seeds_of(seed, F.col("__key"), e)))
    # a chunk is a small row that becomes many: a fixed number of tasks, as small partitions would be put together
    count = sources.agg(F.sum("target")).first()[0] or 0
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(count / block / CHUNK / CHUNKS_IN_TASK))
    index = chunks.repartition(tasks, "__key", "__chunk").select("*", F.explode(F.sequence(F.col("__chunk") * CHUNK, F.least(F.col("__chunk") * CHUNK + (CHUNK - 1), F.col("__slots") - 1))).alias("__i"))
    epoch = F.floor(F.col("__i") / F.col("__blocks")).cast("int")
    place = permuted(F.col("__first") + F.col("__i"), F.col("__total"), F.col("__all_seeds"))
    slots = index.withColumn("epoch", epoch).select(
        "__key",
        "epoch",
        permuted(F.col("__i") - F.col("epoch") * F.col("__blocks"), F.col("__blocks"), F.element_at(F.col("__seeds"), F.col("epoch") + 1)).alias("block"),
        place.alias("__place"),
    )
    slots = slots.select("__key", "epoch", "block", F.floor(F.col("__place") / SHARD_SLOTS).cast("long").alias("shard"), (F.col("__place") % SHARD_SLOTS).cast("int").alias("slot"))
    return Mix(rows, sources, slots)


def shard_counts(plan: Mix) -> DataFrame:
    """(shard, __key, slots): how many slots of each output shard each source fills, by the plan's one draw."""
    return plan.slots.groupBy("shard", "__key").agg(F.count(F.lit(1)).alias("slots"))


def parts(rows: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """A row for each block that a row of ``Mix.rows`` has words in: ``block``, ``__from`` (the row's word there, from 0), ``__words``."""
    first, last = F.floor(F.col("__start") / block), F.floor((F.col("__start") + F.col("__size") - 1) / block)
    spread = rows.filter("__size > 0").withColumn("__b0", first).withColumn("__b1", last)
    spread = spread.select("*", F.explode(F.sequence("__b0", "__b1", F.lit(CHUNK).cast("long"))).alias("__b"))
    spread = spread.select("*", F.explode(F.sequence(F.col("__b"), F.least(F.col("__b") + (CHUNK - 1), F.col("__b1")))).alias("block"))
    low = F.greatest(F.col("block") * block - F.col("__start"), F.lit(0).cast("long"))
    high = F.least((F.col("block") + 1) * block - F.col("__start"), F.col("__size"))
    return spread.withColumn("__from", low).withColumn("__words", high - low).drop("__b0", "__b1", "__b")


def taken(plan: Mix, block: int = BLOCK_WORDS) -> DataFrame:
    """(__row, id, __size, source_size, target, taken, first_shard) of each row: the words that the mix takes of it, repeats counted."""
    uses = plan.slots.groupBy("__key", "block").agg(F.count(F.lit(1)).alias("__times"), F.min("shard").alias("__shard"))
    keep = ["__row", "__id", "__size", "source_size", "target"]
    met = parts(plan.rows, block).select("__key", "block", *keep, "__words").join(uses, ["__key", "block"], "left")
    some = met.groupBy(*keep).agg(F.sum(F.col("__words") * F.coalesce("__times", F.lit(0))).cast("long").alias("taken"), F.min("__shard").alias("first_shard"))
    none = plan.rows.filter("__size = 0").select(*keep, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_shard"))
    return some.unionByName(none)


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """The mix as rows like those of ``df``: for each row and epoch, the text of the words that the mix takes there.

    A text keeps the white space in front of its words. A row of which the mix takes nothing in an epoch gives no row
    for it, so null and wordless texts give none, nor does an empty table; rows that repeat are mixed each for itself. ``length_col``, where ``df`` has it, becomes the new
    text's code points; other columns stay as they are, whatever their names.
    """
    own = lambda c: f"row.`{c.replace('`', '``')}`"
    kept = C.stored(df.select(F.monotonically_increasing_id().alias("__row"), F.struct(*[C.column(c) for c in df.columns]).alias("row")))
    plan = mix(kept, id_col=own(id_col), text_col=own(text_col), source_col=own(source_col), row_col="__row")
    # slots and parts come out of few rows by the thousand, which Spark's estimate of their size leaves out: it would send them all through the driver
    slots = plan.slots.select("__key", "block", "epoch").hint("merge")
    met = parts(plan.rows).select("__key", "block", "__row", "__from", "__words").join(slots, ["__key", "block"])
    cuts = met.groupBy("__row", "epoch").agg(F.array_sort(F.collect_list(F.struct(F.col("__from").alias("f"), F.col("__words").alias("w")))).alias("__cuts"))
    cuts = cuts.groupBy("__row").agg(F.collect_list(F.struct("epoch", "__cuts")).alias("__epochs"))
    tokens = F.regexp_extract_all(F.col(own(text_col)), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))

    def texts(t: Column) -> Column:
        return F.transform("__epochs", lambda e: F.array_join(F.flatten(F.transform(e["__cuts"], lambda c: F.slice(t, (c["f"] + 1).cast("int"), c["w"].cast("int")))), ""))

    # the tokens are a lambda's argument, so that they are made once for all cuts of a row
    out = kept.join(cuts, "__row").withColumn("__text", F.explode(F.element_at(F.transform(F.array(tokens), texts), 1)))
    columns = [F.col("__text").alias(c) if c == text_col else F.length("__text").cast("long").alias(c) if c == length_col else F.col(own(c)).alias(c) for c in df.columns]
    return out.select(*columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of them."""
    plan = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return taken(plan).select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", "taken", "first_shard")
