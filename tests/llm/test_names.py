"""Columns with the names that operators use themselves, nulls anywhere, rows that repeat and empty tables: every operator keeps to its own columns."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import cairn.llm
from cairn.llm import exact, language, media, mixing, packing, repeats, secrets, shards, simhash, toolcalls

SOURCE = "\n".join(p.read_text() for p in Path(cairn.llm.__file__).parent.glob("*.py"))
OWN = {"doc_id", "text", "lang", "source", "n_chars"}
NAMES = sorted({n.lower() for n in re.findall(r'"(__\w+)"', SOURCE)} | {"k1", "k2", "id", "row", "times", "size", "label", "node", "key", "part", "blocks", "first", "least", "found", "bits", "a.b", "lang_pred", "score", "kept", "shard", "slot", "epoch", "block", "piece", "length"})
PASSAGE = " ".join(f"word{k}" for k in range(80))
ROWS = [
    (1, PASSAGE, "en", "s"), (2, PASSAGE + " end", "en", "s"), (2, PASSAGE + " end", "en", "s"), (3, None, None, None), (None, None, "en", None), (None, "the cat", None, "t"), (4, "", "en", "t"),
    (5, "the cat and the dog", "en", None), (6, " \n", None, "t"), (7, "token=abcdefgh123 " + PASSAGE.upper(), "en", "s"),
]


def plain(spark, rows=ROWS):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def crowded(spark, rows=ROWS):
    return plain(spark, rows).select("*", *[F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in NAMES])


ROW_OPERATORS = {
    "accepted": language.accepted,
    "exact": exact.deduplicated,
    "near": simhash.deduplicated,
    "mixed": mixing.mixed_documents,
}
OTHERS = {
    "op1": lambda df: secrets.scan(df)[1].select("kind", "start", "end", "value"),
    "op3": lambda df: media.with_media(df).select("doc_id", "digest", "n_bytes", "feature"),
    "op4": lambda df: mixing.taken(mixing.mix(df)).select(F.col("__id").alias("doc_id"), "__size", "source_size", "target", "taken"),
    "op5": lambda df: packing.pack_documents(df).select("id", "piece", "length"),
    "op6": lambda df: language.identify(df, {"en": [97, 98, 99]}).select("doc_id", "text", "lang_pred", "score"),
    "op7": exact.exact_groups,
    "op8": lambda df: shards.interleave(df, 3),
    "op9": lambda df: repeats.remove_repeats(df).select("doc_id", "n_words", "n_removed", "text"),
    "op10": simhash.near_groups,
}


def said(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", sorted(ROW_OPERATORS))
def test_rows_keep_their_columns(spark, name):
    run = ROW_OPERATORS[name]
    df, bare = crowded(spark), plain(spark)
    got = run(df)
    assert got.columns == df.columns
    rows = got.collect()
    for r in rows:
        assert all(r[n] == f"{n} {'none' if r['doc_id'] is None else r['doc_id']}" for n in NAMES)
    assert sorted(str(tuple(r)[:5]) for r in rows) == sorted(str(tuple(r)) for r in run(bare).collect())
    assert run(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_results_do_not_depend_on_other_columns(spark, name):
    run = OTHERS[name]
    assert said(run(crowded(spark))) == said(run(plain(spark)))
    assert said(run(crowded(spark).limit(0))) == []


def test_calls_with_other_columns(spark):
    calls = spark.createDataFrame([(1, "a", None, 0, "t", "{}"), (2, None, "a", None, None, None)], "uid long, id string, after string, at long, name string, arguments string")
    results = spark.createDataFrame([(3, "a", 1, "x"), (4, None, None, None)], "uid long, id string, at long, content string")
    taken = {"uid", "id", "after", "at", "name", "arguments", "content", "scope"}
    wide = lambda df: df.select("*", *[F.lit("x").alias(n) for n in NAMES if n not in taken | set(df.columns)], F.lit("y").alias("kind"), F.lit("z").alias("link"), F.lit(1).alias("parent"))
    assert said(toolcalls.link_calls(wide(calls), wide(results), {})) == said(toolcalls.link_calls(calls, results, {}))
    assert said(toolcalls.link_calls(calls.limit(0), results.limit(0), {})) == []


def test_single_rows_of_many_sources_are_spread(spark):
    """Sources of one row each don't all take the same fraction, so no bucket of the order holds them all; the law of rows holds."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("s"), F.col("id") % 15_000).alias("source"))
    got = shards.interleave(df).select("shard", "slot", F.floor(F.col("fraction") * 50).alias("bin")).toPandas()
    assert got.groupby("bin").size().max() < 2 * 20_000 / 50 and got.groupby("shard").size().tolist() == [2500] * 8
    assert all(sorted(g) == list(range(2500)) for _, g in got.groupby("shard")["slot"])
